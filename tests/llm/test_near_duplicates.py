import random
import re

from chronofold.llm.near_duplicates import near_duplicates, one_of_each

SCHEMA = "doc_id long, text string, id string, n long, keys string"


def sets(text, n):
    words = re.findall(r"[^ \t\n\x0b\f\r]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def classes(rows, n, percent=80):
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    s = [(r[0], sets(r[1], n)) for r in rows]
    for i, (a, x) in enumerate(s):
        for b, y in s[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {a: root(a) for a in parent}


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("alpha beta gamma delta É ß kilo mike 漢字 x".split()) + str(rnd.randrange(300))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one"), (7, "É one"), (8, "é one")]
    for base in range(4):
        words = [word() for _ in range(rnd.choice((12, 60, 400)))]
        for _ in range(14):  # copies that drift apart, so that links make chains
            rows.append((len(rows) + 1, " ".join(words)))
            for _ in range(rnd.randrange(3)):
                words[rnd.randrange(len(words))] = word()
    rows += [(len(rows) + 1 + i, " ".join(word() for _ in range(30))) for i in range(20)]
    return rows


def test_classes_match_brute_force(spark):
    rows = corpus(5)
    out = near_duplicates(spark.createDataFrame([(a, b, "x", 1, "k") for a, b in rows], SCHEMA), words=4).collect()
    assert {r.doc_id: r.component_id for r in out} == classes(rows, 4)
    assert {r.doc_id: r.n_shingles for r in out} == {a: len(sets(b, 4)) for a, b in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_many_hubs(spark):
    # Star of drifting copies around one text: most pairs are just too far apart.
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(330):
        words = list(base)
        for _ in range(rnd.randrange(1, 4)):
            words[rnd.randrange(80)] = f"n{rnd.randrange(10**6)}"
        rows.append((i + 1, " ".join(words)))
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == classes(rows, 5)


def test_nulls_and_repeats(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, "a", 1, "k"), (7, text, "b", 2, None), (7, text, "c", 3, "k"), (9, text, None, None, None), (5, None, "d", 4, "k")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_duplicates(df).collect())
    assert out == [(-1, -1, True), (5, 5, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    left = one_of_each(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 5, 7]
    assert one_of_each(df.limit(0)).count() == 0
