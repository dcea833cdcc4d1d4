"""Every passage of a labelled text is learned from; the forward pass and its gradient against plain loops."""

import math

import numpy as np
from pyspark.sql import functions as F

from chronofold.llm import quality as Q


def bags(seed, n=5):
    rng = np.random.default_rng(seed)
    return [rng.normal(size=(k, Q.WIDTH)) for k in (1, 4, 2, 30, 3)[:n]]


def model(seed=1):
    return Q.AttentionModel.fit(bags(seed), np.array([0.0, 1, 0, 1, 1]), epochs=2)


def plain_score(m, bag):
    hs, es = [], []
    for x in bag:
        x = (x - m.mean) / m.scale
        h = [math.tanh(sum(x[i] * m.p["E"][i][j] for i in range(Q.WIDTH))) for j in range(Q.HIDDEN)]
        t = [math.tanh(sum(h[i] * m.p["V"][i][j] for i in range(Q.HIDDEN))) for j in range(Q.GATE)]
        s = [1 / (1 + math.exp(-sum(h[i] * m.p["U"][i][j] for i in range(Q.HIDDEN)))) for j in range(Q.GATE)]
        hs.append(h)
        es.append(math.exp(sum(t[j] * s[j] * m.p["w"][j] for j in range(Q.GATE))))
    z = [sum(e * h[j] for e, h in zip(es, hs)) / sum(es) for j in range(Q.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, m.p["c"])) + m.p["b"][0])))


def test_scores_match_loops():
    m = model()
    assert np.allclose(m.score(bags(7)), [plain_score(m, b) for b in bags(7)])


def test_gradient_matches_differences():
    m, xs, y = model(), [(b - 0.1) / 2 for b in bags(9)], np.array([1.0, 0, 0, 1, 0])
    rng = np.random.default_rng(4)

    def loss():
        s = m._forward(xs)[-1]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s)) + 5e-5 * sum((v ** 2).sum() for v in m.p.values())

    g = m._gradient(xs, y)
    for name, values in m.p.items():
        for _ in range(4):
            at = tuple(rng.integers(n) for n in values.shape)
            kept = values[at]
            values[at] = kept + 1e-5
            up = loss()
            values[at] = kept - 1e-5
            slope = (up - loss()) / 2e-5
            values[at] = kept
            assert abs(slope - g[name][at]) < 1e-6 + 1e-4 * abs(slope), (name, at)


def test_all_passages_and_repeated_rows(spark, monkeypatch):
    seen = []
    fit = Q.AttentionModel.fit.__func__
    monkeypatch.setattr(Q.AttentionModel, "fit", classmethod(lambda cls, bags, labels, **k: seen.append((bags, labels)) or fit(cls, bags, labels, epochs=1)))
    long = "good words. " * 10_000
    rows = [(1, long, 1)] + [(2, "short", 1)] * 50 + [(3, "bad BAD !!", 0), (4, None, 0), (5, "x", None), (None, "no id", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").withColumn("place", F.lit("clash")).withColumn("x", F.lit(1))
    Q.fit(df, sample=1000)
    got, labels = seen[-1]
    assert sorted(len(b) for b in got) == [1, 1, 1, 120] and sorted(labels) == [0, 0, 1, 1]
    Q.fit(df, sample=1000, fit_bytes=100)  # whole texts, one of each label at least
    got, labels = seen[-1]
    assert set(labels) == {0, 1} and all(len(b) in (1, 120) for b in got)
    assert Q.fit(df.limit(0)) == 0.0
