import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from chronofold.llm import prefix_trie as T
from chronofold.llm.queries import TRIE_SQL
from chronofold.runtime import Work

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    convs = {c: [(r, t) for *_, r, _, t in sorted(ts)] for c, ts in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        mine = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in mine) if mine else 1
        saved[k] = sum(saved[x] for x in mine) + ((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0)
    digest = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(nodes[k]) if len(convs[c]) == len(k)).encode()).hexdigest()
    return sorted(((min(cs), len(k), min(nodes[k[:-1]]) if k else None, len(cs), len(children.get(k, [])), leaves[k], saved[k], digest(k))
                   for k, cs in nodes.items()), key=lambda r: tuple(x if x is not None else -1 for x in r))


def got(df):
    assert df.dtypes == [("conv_id", "bigint"), ("depth", "bigint"), ("parent_conv_id", "bigint"), ("n_convs", "bigint"), ("n_children", "bigint"),
                         ("n_leaves", "bigint"), ("saved_tokens", "bigint"), ("ends_sha256", "string")]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(x if x is not None else -1 for x in r))


def sample(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["hé", "yes", "no", "漢字", "a b", "", "ok 𝔸"])
    rows = []
    for c in [*range(0, 12), *range(100, 130), 205, 207, 399, *range(-104, -98), 10**12 + 7]:
        for t in range(rnd.choice((1, 2, 3, 5, 9))):
            rows.append((c, t * 3, rnd.choice(["user", "bot"]), word()))
    rows += [(3, 1, None, None), (3, None, "user", "first"), (3, None, "user", "first"), (3, 1, "", ""), (None, 0, "user", "lost"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("seed,piece", [(1, 1024), (2, 2)])
def test_conversations(spark, monkeypatch, seed, piece):
    monkeypatch.setattr(T, "PIECE", piece)
    monkeypatch.setattr(T, "NUMBERS", 3)
    rows = sample(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", pos int, path string")
    want = brute(rebuilt(rows))
    assert got(T.conversation_trie(df)) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(TRIE_SQL).fetchall(), key=lambda r: tuple(x if x is not None else -1 for x in r)) == want


def tree_of(spark, convs, few=T.HANDLES):
    turns = [(c, i + 1, r, hashlib.md5(t.encode()).hexdigest(), len(t)) for c, ts in convs.items() for i, (r, t) in enumerate(ts)]
    turns = spark.createDataFrame(turns, "conv_id long, pos long, role string, digest string, points long")
    return got(T.prefix_tree(spark.createDataFrame([(c,) for c in convs], "conv_id long"), turns, Work(spark, "test"), few))


def shapes():
    """Several hard shapes in one tree, each under a first turn of its own."""
    rnd = random.Random(11)
    spine = [("u", f"t{i}") for i in range(40)]
    forest = {
        "chain": [spine[:i] for i in range(40)],  # each the opening of the next
        "comb": [spine[:i] + [("u", f"own {i}")] for i in range(30)],
        "copies": [spine[:3]] * 30 + [[], spine[:2], spine[:3] + [("v", "t3")]],
        "bushy": [[("u", rnd.choice("ab")) for _ in range(rnd.randrange(9))] for _ in range(150)],
    }
    convs = [[("u", name), *turns] for name, many in forest.items() for turns in many]
    rnd.shuffle(convs)
    return {**{3 * i: c for i, c in enumerate(convs)}, 5000: [], 5001: []}


@pytest.mark.parametrize("piece,few", [(1024, T.HANDLES), (8, 0)])
def test_shapes(spark, monkeypatch, piece, few):
    monkeypatch.setattr(T, "PIECE", piece)
    assert tree_of(spark, shapes(), few) == brute(shapes())


def test_very_long_conversation(spark):
    long = [("u", f"t{i % 7}") for i in range(3 * T.PIECE + 5)]
    convs = {1: long, 2: long[:2 * T.PIECE], 3: long[:2 * T.PIECE] + [("u", "else")], 4: long[:T.PIECE + 1], 5: [("v", "t0")]}
    assert tree_of(spark, convs) == brute(convs)


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", T.fattest(F.col("a"), F.col("b")).alias("f"))
    for r in df.collect():
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x)


def test_empty_table(spark):
    assert T.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert T.conversation_trie(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)).collect() == []
