import random

import numpy as np

from chronofold.llm import kernels as K, linking
from chronofold.llm.line_dedup import BY_LENGTH, _ends, _mark, _may_link, _normal_lines, _placed, dedup_lines, normal

WORDS = "stone river under winter the of and market little ships carried between nine quiet harbour long a green paper lantern".split()


def one_changed(rnd, x):
    i = rnd.randrange(1, len(x) - 1)
    return x[:i] + rnd.choice([c for c in "abcdefghijklmnopqrstuvwxyz" if c != x[i]]) + x[i + 1:]


def planted(rnd, n):
    """Lines of 20 to 80 characters without repeated pairs of characters, and a copy of each with one character changed."""
    out = []
    while len(out) < n:
        size, x = rnd.randrange(20, 81), ""
        x = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(size))
        y = one_changed(rnd, x)
        if all(normal(z) == z and len({z[i:i + 2] for i in range(size - 1)}) == size - 1 for z in (x, y)):
            out.append((x, y))
    return out


def brute(lines, percent=80):
    group = list(range(len(lines)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for w in BY_LENGTH:
        at = [i for i, x in enumerate(lines) if w.least <= len(x) < w.most]
        sets = {i: {lines[i][k:k + w.shingle] for k in range(max(1, len(lines[i]) - w.shingle + 1))} for i in at}
        for i in at:
            for j in at:
                if j < i and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    a, b = root(i), root(j)
                    group[max(a, b)] = min(a, b)
    return {i for i in range(len(lines)) if root(i) != i}


def test_one_edit_copies_of_ordinary_lines_go(spark):
    pairs = planted(random.Random(5), 150)
    rows = [(i, x) for i, (x, _) in enumerate(pairs)] + [(1000 + i, y) for i, (_, y) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r.doc_id for r in dedup_lines(df, dropped="gone", widths=BY_LENGTH).collect() if r.gone}
    assert gone == {1000 + i for i in range(len(pairs))}


def test_widths_match_brute_force(spark):
    rnd = random.Random(6)
    lines = []
    for size in (*range(1, 120, 3), *range(180, 260, 8)):
        x = ""
        while len(x) < size:
            x += rnd.choice(WORDS) + " "
        x = normal(x[:size]) or "a"
        lines.append(x)
        for _ in range(2):
            for _ in range(rnd.randrange(1, 4)):
                if len(x) > 3:
                    x = one_changed(rnd, x)
            lines.append(normal(x))
        lines.append(normal(x + " and")[:size + 3])
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {r.doc_id for r in dedup_lines(df, dropped="gone", widths=BY_LENGTH).collect() if r.gone}
    assert gone == brute(lines) and len(gone) > 40


def syllables(rnd, size):
    x = ""
    while len(x) < size:
        x += rnd.choice(["the ", "and ", "er", "in", "th", "re", "on ", "at", "en", "sh", "nd ", "ou", "ing ", "ti", "es "])
    return normal(x[:size])


def test_lines_of_common_shingles_are_not_fetched_to_be_compared(spark, monkeypatch):
    """Short lines of a few syllables share band keys by chance; their marks tell them apart before texts are read."""
    rnd = random.Random(8)
    rows = [(i, "\n".join(syllables(rnd, rnd.randrange(36, 80)) for _ in range(40))) for i in range(100)]
    compared, verified = [], linking.verified
    monkeypatch.setattr(linking, "verified", lambda needs, *rest: compared.append(needs.count()) or verified(needs, *rest))
    gone = [r.gone for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), dropped="gone", widths=BY_LENGTH).collect()]
    assert sum(map(len, gone)) < 20 and sum(compared) < 200


def test_marks_rule_out_no_near_pair():
    rnd = random.Random(9)
    lines = [syllables(rnd, rnd.randrange(16, 99)) for _ in range(300)]
    lines += [one_changed(rnd, x) for x in lines]
    for width in (2, 3):
        c = _placed(lines, width)
        marks = _mark(c, _ends(c, len(lines)))
        sets = [{x[k:k + width] for k in range(len(x) - width + 1)} for x in lines]
        x, y = np.triu_indices(len(lines), 1)
        may = _may_link(marks[x], marks[y], 80)
        near = np.array([100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for i, j in zip(x, y)])
        assert near.sum() > 100 and may[near].all() and may.mean() < .1


def test_windows_meet_at_the_similarity():
    """Of sets of 64 and more at 0.8 or just above, all but a few in ten thousand share a key; equal places, not order, decide."""
    rng = np.random.default_rng(3)
    missed = 0
    for n in (64, 90, 235, 600):
        for bands, rows in ((20, 5), (12, 3)):
            sets, owners = [], []
            for pair in range(500):
                union, gone = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(K.U64) * K.U64(2), n // 5
                at = rng.permutation(n)
                for k, drop in enumerate((at[:gone // 2], at[gone // 2:gone])):
                    sets.append(np.delete(union, drop))
                    owners.append(np.full(len(sets[-1]), 2 * pair + k, K.U64))
            c = K.placed(np.concatenate(sets), np.concatenate(owners), np.zeros(0, np.int64))
            keys = K.Windows(bands, rows).keys(c, np.arange(1000))
            missed += (~(keys[::2] == keys[1::2]).any(axis=1)).sum()
    assert missed <= 4


def test_normal_lines_of_a_text():
    for text in ("a  B\n c \tD", "\u0391\u03a3\n\u03a3 \u0391\u03a3.\nx", "\n\n", "a\x85b\n\u3000c", "A B\n C ", "a\x1cb", ""):
        assert _normal_lines(text) == [normal(x) for x in text.split("\n")]


def test_small_sets_in_long_lines(spark):
    """Lines of the long widths with few distinct shingles: these meet by MinHash, at the border by both ways."""
    rnd = random.Random(10)
    lines = ["-" * 120, "-" * 150, "ab" * 60, "ab" * 60 + "a", "abcde" * 50, "abcde" * 49 + "abcdf"]
    for size in range(50, 110, 3):
        unit = syllables(rnd, size).replace(" ", ".")
        lines += [unit * 4, one_changed(rnd, unit) * 4, unit * 4 + syllables(rnd, 12).replace(" ", ".")]
    lines = list(dict.fromkeys(map(normal, lines)))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {r.doc_id for r in dedup_lines(df, dropped="gone", widths=BY_LENGTH).collect() if r.gone}
    assert gone == brute(lines) and len(gone) > 15


def test_crowded_buckets(spark):
    """More near copies in a bucket than pairs are made for."""
    rnd = random.Random(11)
    base = [syllables(rnd, size) for size in (60, 150, 300)]
    lines = list(dict.fromkeys(normal(one_changed(rnd, x)) for x in base for _ in range(120)))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {r.doc_id for r in dedup_lines(df, dropped="gone", widths=BY_LENGTH).collect() if r.gone}
    assert gone == brute(lines) and len(gone) > 300
