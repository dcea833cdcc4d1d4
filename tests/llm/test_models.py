import random
import zlib
from heapq import heapify, heappop, heappush

import numpy as np

from chronofold.llm import language_id, quality
from chronofold.llm.sharding import deal, shard
from chronofold.llm.vector_search import nearest

LANGUAGES = {"en": "the and that with this have from they would there", "de": "der und nicht eine auch sich werden über schön groß",
             "fr": "les des une dans pour que être été où déjà", "es": "los las una que por año niño más también está"}


def texts(n, seed):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(LANGUAGES[lang].split()) for _ in range(rnd.randrange(3, 60))), lang)
            for i, lang in ((i, rnd.choice(list(LANGUAGES))) for i in range(n))]


def test_language(spark):
    model = language_id.fit(spark.createDataFrame([*texts(300, 1), (900, None, "en"), (901, "x y", None)], "doc_id long, text string, lang string"))
    assert set(model.families) == {"germanic", "romance"} and set(model.of_pair) == {("de", "en"), ("es", "fr")}
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 :-) 34", "fr"), (None, "the and that", "de"), (1003, "the and that with " * 200_000, "en")]
    df = spark.createDataFrame([*texts(200, 2), *odd], "doc_id long, text string, lang string")
    rows = language_id.identify(df, model).collect()
    assert len(rows) == 205
    by = {r.doc_id: r for r in rows}
    assert sum(by[i].lang_pred == lang for i, _, lang in texts(200, 2)) >= 196
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[None].lang_pred == "en" and by[1003].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows)
    empty = df.limit(0)
    assert language_id.fit(empty) is None and language_id.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(df, None).collect()} == {"und"}
    one = language_id.fit(df.where("lang = 'en'"))
    assert {r.lang_pred for r in language_id.identify(df.where("doc_id < 200"), one).collect()} == {"en"}


def test_quality(spark):
    rnd = random.Random(4)

    def good(n):
        return " ".join(rnd.choice("time year people way day man thing woman life child".split()) for _ in range(n)).capitalize() + "."

    def bad(n):
        return " | ".join(rnd.choice(["BUY", "$$$", "!!", "%%"]) + str(rnd.randrange(9)) for _ in range(n))

    rows = [(i, good(400) if i % 3 else good(60) + bad(300), int(i % 3 > 0)) for i in range(240)]
    model = quality.fit(spark.createDataFrame([*rows, (900, None, 1), (901, "x", None)], "doc_id long, text string, quality int"))
    new = [(i, good(300) if i % 2 else bad(300), i % 2) for i in range(100)] + [(1000, None, 0), (1001, "", 0), (None, "x", 0), (1002, good(200_000), 1)]
    df = spark.createDataFrame(new, "doc_id long, text string, quality int")
    out = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert len(out) == 104 and all(0 <= s <= 1 for s in out.values())
    assert sum((out[i] >= 0.3) == bool(i % 2) for i in range(100)) >= 95
    assert out[1000] == out[1001] and out[1002] >= 0.3
    assert quality.fit(df.where("quality = 1")) == 1.0 and quality.fit(df.limit(0)) == 0.0
    assert quality.score(df.limit(0), model).count() == 0


def brute_nearest(rows, ask, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in fine:
        if ask(q):
            near = sorted((-float(x @ y), i) for i, y in fine if i != q and len(y) == len(x))[:k]
            out[q] = [i for _, i in near]
    return out


def test_search(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.2, 3)).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # one very common vector
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [None, 1.0]), (2060, [float("nan")] * 8), (None, rows[1][1]), (2080, []), (2100, [1.0, 2.0]), (2120, [2.0, 1.0]), (2101, [3.0, 1.0])]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "vec_id long, embedding array<double>, score double")
    want = brute_nearest(rows, lambda q: q % 20 == 0, 20)
    exact, loose = {}, {}
    for relax, got in ((1.0, exact), (0.8, loose)):
        for r in nearest(df, df.where("vec_id % 20 = 0"), relax=relax, shard_rows=150, query_block=20).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
    assert exact == want
    hit = sum(len(set(loose[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert hit >= 0.9
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_deal_is_longest_processing_time():
    rnd = random.Random(5)
    for _ in range(60):
        shards = rnd.randrange(1, 9)
        sizes = [rnd.choice((1, 2, 3, 7, 50, 51, 400)) for _ in range(rnd.randrange(200))] + rnd.choice(([], [3000]))
        heap = [(0, s) for s in range(shards)]
        heapify(heap)
        for x in sorted(sizes, reverse=True):
            load, s = heappop(heap)
            heappush(heap, (load + x, s))
        plan = deal([(x, sizes.count(x), x * sizes.count(x)) for x in set(sizes)], shards)
        loads = [0] * shards
        for x, a, b, s in plan:
            loads[s] += x * (b - a)
        assert sorted(loads) == sorted(load for load, _ in heap)


def test_shard(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice(["common text", "x" * rnd.randrange(3000), "é" * rnd.randrange(90), "", None])) for i in range(1500)] + [(None, "q"), (3, "twice"), (3, "twice")]
    out = shard(spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, slot int"), shards=7).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in out) == sorted(
        (d is None, d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    for s in range(7):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    home = {}
    for r in out:
        home.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(x) <= 2 for x in home.values())  # null and empty texts are two groups
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
