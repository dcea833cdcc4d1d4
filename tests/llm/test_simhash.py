import random
import re
from math import comb

import numpy as np
import pytest
import xxhash

from chronofold.llm import simhash as S
from chronofold.runtime import Work


def plain_fingerprint(text, n=4):
    words = re.findall(r"[^ \t\n\x0b\f\r]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_classes(fps, distance=4):
    """fps: (id, fingerprint); the smallest id reachable."""
    parent = {i: i for i, _ in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(fps):
        for b, y in fps[:k]:
            if (x ^ y).bit_count() <= distance:
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: root(i) for i in parent}


@pytest.mark.parametrize("block", [S.GOLAY, S.HAMMING, S.BIT])
def test_blocks_are_perfect(block):
    assert sum(comb(block.bits, w) for w in range(block.radius + 1)) == 1 << block.checks
    words, checks, _ = block.patterns(0)
    assert len(set(checks.tolist())) == len(words) == 1 << block.checks  # each syndrome has one pattern within the radius


@pytest.mark.parametrize("blocks", S.CODES)
def test_pairs_meet_at_a_home(blocks):
    rnd, c = random.Random(3), S.code(blocks, 2)
    assert c.replicas == pytest.approx({4096: 21.75, 65536: 40.1, 1 << 21: 105.6}[c.anchors], abs=0.1)
    for _ in range(300):
        x = rnd.getrandbits(64)
        y = x
        for bit in rnd.sample(range(64), 4):
            y ^= 1 << bit
        met = False
        for half in (0, 32):
            rows, anchors, home = c.places(np.array([x >> half & 0xFFFFFFFF, y >> half & 0xFFFFFFFF]))
            assert home[rows == 0].sum() == home[rows == 1].sum() == 1
            met |= bool(np.isin(anchors[(rows == 0) & home], anchors[rows == 1]).any())
        assert met


def test_fingerprints():
    rnd = random.Random(1)
    words = ["a", "B", "ÀÉ", "漢字", "x y", "It", "the", "zz"]
    texts = [None, "", " \n", "One", "one two THREE", "a\tb\x0bc\x0cd\re", "𝔸 É é e"] + [
        rnd.choice([" ", "\n", "  ", "\t "]).join(rnd.choice(words) for _ in range(n)) for n in (3, 4, 5, 254, 255, 256, 257, 1100)]
    for t in texts:
        assert S.fingerprint((t or "").encode()) == plain_fingerprint(t), t


def test_very_long_text():
    rnd = random.Random(4)
    text = "\n ".join(f"W{rnd.randrange(5000)}" for _ in range(200_000))
    assert len(text) > S.LONG
    assert S.fingerprint(text.encode()) == plain_fingerprint(text)


def fingerprints(seed, centres=20, near=15):
    rnd, out = random.Random(seed), set()
    for _ in range(centres):
        x = rnd.getrandbits(64)
        for _ in range(near):
            for bit in rnd.sample(range(64), rnd.randrange(7)):
                x ^= 1 << bit
            out.add(x)
    out |= {0, 1, (1 << 64) - 1, 31, 0b111111}
    return sorted(out)


@pytest.mark.parametrize("blocks,members,hubs", [(S.CODES[0], S.MEMBERS, S.HUBS), (S.CODES[1], 7, 2), (S.CODES[0], 5, 1), (S.CODES[2], 9, 3)])
def test_links_match_brute_force(spark, blocks, members, hubs):
    fps = fingerprints(len(blocks) + members)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    pairs = S.fingerprint_links(df, 4, Work(spark, "test"), blocks, members, hubs).collect()
    back = dict(zip(signed, fps))
    for u, v in pairs:
        assert 0 < (back[u] ^ back[v]).bit_count() <= 4
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in pairs:
        parent[root(u)] = root(v)
    want = plain_classes(list(zip(signed, fps)))
    groups = {}
    for x in signed:
        groups.setdefault(want[x], set()).add(root(x))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_one_crowded_anchor():
    # Thousands of fingerprints in one small ball: few links tie them together.
    rnd = random.Random(9)
    fps = {0}
    while len(fps) < 3000:
        x = 0
        for bit in rnd.sample(range(20), rnd.randrange(1, 6)):
            x ^= 1 << bit
        fps.add(x)
    fps = np.array(sorted(fps), np.int64)
    us, vs = S.links(fps, np.full(len(fps), S.BOTH), 4)
    assert len(us) == len(fps) - 1


def corpus():
    rnd = random.Random(8)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one"), (7, "É one"), (8, "a b c d e")]
    for _ in range(5):
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice((200, 900)))]
        for _ in range(10):
            rows.append((len(rows) + 1, " ".join(words)))
            words[rnd.randrange(len(words))] = f"n{rnd.randrange(10**6)}"
    return rows


def test_classes_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(a, b, "x", 7, "k") for a, b in rows], "doc_id long, text string, fp string, id int, rep string")
    out = S.near_duplicates(df).collect()
    assert {r.doc_id: r.fingerprint for r in out} == {a: f"{plain_fingerprint(b):016x}" for a, b in rows}
    assert {r.doc_id: r.component_id for r in out} == plain_classes([(a, plain_fingerprint(b)) for a, b in rows])


def test_nulls_repeats_and_empty(spark):
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(None, text), (None, None), (9, text), (9, text), (4, other), (9, other), (12, text), (20, "alone"), (3, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect())
    a, b, c = (f"{plain_fingerprint(t):016x}" for t in (text, other, "alone"))
    zero = "0" * 16
    assert out == sorted([(-1, a, None), (-1, zero, None), (9, a, 4), (9, a, 4), (9, b, 4), (4, b, 4), (12, a, 4), (20, c, 20), (3, zero, 2), (2, zero, 2)], key=lambda r: (r[0], r[1], r[2] or 0))
    assert S.near_duplicates(df.limit(0)).collect() == []
