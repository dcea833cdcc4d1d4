import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from chronofold.llm import lexical_search as S


def terms(text):
    return re.findall(S.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, most=10):
    found = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    queries = {}
    for i, t in items:
        if i is not None:
            queries.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in queries.items():
        scores = []
        for d, c in found:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in q.items() if c[t])
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(i, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scores)[:most])]
    return sorted(out)


def corpus(seed, n=150):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "Ünï", "漢字", "x1", "É", "a", "ab", "abc", "b", "𝔸b", "naïve", *(f"w{i}" for i in range(60))]
    text = lambda k: "".join(rnd.choice(vocabulary) + rnd.choice([" ", "  ", ", ", "\n", "-", "_", "\x00", "'"]) for _ in range(k))
    docs = [(i, text(rnd.choice((0, 1, 5, 40, 200)))) for i in range(n)]
    docs += [(500 + i, docs[7 + i][1].upper()) for i in range(20)] + [(600, None), (601, ""), (602, "?!"), (None, text(30)), (7, text(30)), (8, docs[8][1])]
    items = [(i, text(rnd.choice((1, 4, 30)))) for i in range(12)] + [(20, None), (21, ""), (22, "nowhere"), (None, "the of"), (3, "x1 x1 ab"), (3, "x1 x1 ab")]
    return docs, items


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(a, b, "t", 1) for a, b in docs], "doc_id long, text string, term string, rank int")
    i = spark.createDataFrame([(a, b, 5, 6) for a, b in items], "item_id long, text string, doc_id int, score int")
    out = S.search(d, i, **options)
    assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"block_bytes": 600}), (3, {"most": 3}), (4, {"most": 1000})])
def test_matches_brute_force(spark, seed, options):
    docs, items = corpus(seed)
    assert run(spark, docs, items, **options) == brute(docs, items, options.get("most", 10))


def test_terms_are_whole():
    found = lambda t, words: sorted(v for p in S.pieces(t.encode()) for _, v in S.automaton(words).iter(p.decode()))
    assert found("ab abc AB,a b", ["ab", "a", "b", "bc"]) == [0, 0, 1, 2]
    assert found("ab", ["a"]) == found("", ["a"]) == found("éa", ["a"]) == []
    assert found("a a a", ["a"]) == [0, 0, 0]


def test_long_texts_in_pieces(monkeypatch, spark):
    monkeypatch.setattr(S, "PIECE", 50)
    rnd = random.Random(5)
    text = " ".join("w" * rnd.choice((1, 2, 3, 90)) for _ in range(300))
    parts = list(S.pieces(text.encode()))
    assert len(parts) > 100 and sum(len(p.split()) for p in parts) == 300
    assert Counter(w for p in parts for w in p.split()) == Counter(text.encode().split())
    assert list(S.pieces(b"x" * 300)) == [b" " + b"x" * 300 + b" "]


def test_very_long_document(spark):
    docs = [(1, "needle " + "hay " * 600_000 + "needle"), (2, "needle hay"), (3, "hay")]
    items = [(1, "needle"), (2, "hay hay needle")]
    assert run(spark, docs, items) == brute(docs, items)


def test_exact_beyond_doubles():
    rows = [(0, 0, 3), (0, 1, 1), (1, 0, 2)]
    small, large = S.Postings([5, 9], rows, np.array([7, 11])), S.Postings([5, 9], rows, np.array([7, 11]))
    large.small = False
    args = np.array([0, 1, 0]), np.array([10, 100, 3]), np.array([2, 0, 1])
    assert small.small and (small.scores(*args) == large.scores(*args)).all()
    assert small.scores(*args).tolist() == [[10 * 21 + 100 * 22, 70], [0, 0], [63, 21]]
    huge = S.Postings([5], [(0, 0, 1), (1, 0, 1)], np.array([1 << 40, 1]))
    assert not huge.small and huge.scores(np.array([0, 1]), np.array([1 << 20, 1]), np.array([2])).tolist() == [[(1 << 60) + 1]]


def test_empty_tables(spark):
    docs, items = corpus(6, 40)
    assert run(spark, [], items) == run(spark, docs, []) == run(spark, [(1, None)], items) == run(spark, docs, [(1, None)]) == []
