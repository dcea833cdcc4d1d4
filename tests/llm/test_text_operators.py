import random

import numpy as np
import pytest

from chronofold.llm import bpe
from chronofold.llm.decontamination import contaminated, decontaminate, nearest, letter_masks, normal as plain
from chronofold.llm.licenses import align, longest_rise, scan
from chronofold.llm.line_dedup import dedup_lines, normal
from chronofold.llm.quotations import link_quotations

PATH = bpe.__name__ and pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def keep(text, dropped):
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in dropped)


def brute_lines(rows, percent=80):
    lines = [(d, i, normal(x)) for d, t in rows if t is not None and d is not None for i, x in enumerate(t.split("\n")) if normal(x)]
    sets = [{x[i:i + 8] for i in range(len(x) - 7)} if len(x) >= 8 else {x} for *_, x in lines]
    group = list(range(len(lines)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    first = {}
    for i, (d, n, _) in enumerate(lines):
        first[root(i)] = min(first.get(root(i), (d, n)), (d, n))
    gone = {}
    for i, (d, n, _) in enumerate(lines):
        if first[root(i)] != (d, n):
            gone.setdefault(d, set()).add(n)
    return {d: None if t is None else keep(t, gone.get(d, ())) for d, t in rows}


def test_line_dedup_matches_brute_force(spark):
    rnd = random.Random(4)
    pool = [" ".join(rnd.choice(["lorem", "ipsum", "dolor", "Über", "amet", "漢字"]) + str(rnd.randrange(50)) for _ in range(rnd.choice((1, 6, 20, 40)))) for _ in range(30)]

    def edit(x):
        x = list(x)
        for _ in range(rnd.randrange(3)):
            x[rnd.randrange(len(x))] = rnd.choice("abcXYZ ")
        return "".join(x)

    rows = [(i, "\n".join(edit(rnd.choice(pool)) if rnd.random() < .8 else rnd.choice(["", "  ", "ok", "yes"]) for _ in range(rnd.randrange(8)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "x" * 5000 + "\n" + "x" * 4999 + "y")]
    df = spark.createDataFrame([(a, b, 1, "g") for a, b in rows], "doc_id long, text string, keys int, id string")
    out = dedup_lines(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == brute_lines(rows)


def test_line_dedup_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "same line here\nother"), (1, "same line here\nother"), (2, "SAME  line here"), (None, "same line here")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text, r.gone) for r in dedup_lines(df, dropped="gone").collect())
    assert got == [(0, "same line here", []), (1, "same line here\nother", []), (1, "same line here\nother", []), (2, "", [0])]
    assert dedup_lines(df.limit(0)).count() == 0


def edit_distance_inside(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination_matches_brute_force(spark):
    rnd = random.Random(9)
    say = lambda n: " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 8))) for _ in range(n))
    items = [(i, say(rnd.choice((4, 12, 40)))) for i in range(12)] + [(50, "short"), (51, None), (52, ""), (53, "?!")]
    docs = [(1, None), (2, ""), (3, "Short!"), (4, "short and more")]
    for i in range(40):
        item = list(rnd.choice(items[:12])[1])
        for _ in range(rnd.randrange(0, max(1, len(item) // 6))):
            item[rnd.randrange(len(item))] = rnd.choice(["", "z", "!", "ab"])
        docs.append((10 + i, say(rnd.randrange(30)) + ", " + "".join(item).upper() + "... " + say(rnd.randrange(30))))
    want = set()
    for d, t in docs:
        for i, x in items:
            a, b = plain(x or ""), plain(t or "")
            if len(a) >= 16 and b:
                e = edit_distance_inside(a, b)
                if e <= int(len(a) * 0.08):
                    want.add((d, i, e))
            elif a and a == b:
                want.add((d, i, 0))
    D = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, item_id int")
    B = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in contaminated(D, B).collect()} == want
    clean = decontaminate(D, B)
    assert clean.columns == D.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, *_ in want}
    assert contaminated(D, B.limit(0)).count() == 0 and contaminated(D.limit(0), B).count() == 0
    assert decontaminate(D, B.limit(0)).count() == len(docs)


def test_myers_distance():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 90))) for _ in range(2))
        assert nearest(letter_masks(a), len(a), b) == edit_distance_inside(a, b)


def test_bpe_like_the_library(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(PATH)
    rnd = random.Random(3)
    run = lambda n: "".join(rnd.choice(["the", "ing", "a", "zz", "é", "漢"]) for _ in range(n))
    texts = [None, "", " ", "Hello  world's\n\n test<|endoftext|>x", "漢字 \x1c 😀", run(4000), "pre " + run(5000) + " mid " + run(6000), "a" * 9000,
             " " * 9000 + "x", "!?" * 4500 + "'s", "\n" * 5000, "9" * 5000 + "ab" * 3000, "<|endoftext|>" * 500, run(3000) + "<|endoftext|>" + run(3000)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "x", 1), (3, texts[3], 2)], "doc_id long, text string, ids int")
    out = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        t = "x" if r.doc_id is None else texts[r.doc_id] or ""
        ids = library.encode(t, add_special_tokens=False).ids
        assert r.ids == ids, r.doc_id
        assert r.text == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_patience():
    rnd = random.Random(8)
    for _ in range(100):
        v = [rnd.randrange(30) for _ in range(rnd.randrange(25))]
        kept = [v[i] for i in longest_rise(v)]
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        assert all(a < b for a, b in zip(kept, kept[1:])) and len(kept) == max(best, default=0)
    pairs = align(list("xxabcyydezz"), list("abcde"))
    assert [j for _, j in pairs] == [0, 1, 2, 3, 4] and all(a < b for (a, _), (b, _) in zip(pairs, pairs[1:]))


def test_license_scan(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    templates = [("MIT", mit), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("MIT", "Licensed under the MIT License.")]
    docs = [(1, "x y\nLicensed under the Apache License, Version 2.0.\nz"), (2, "the license of a person"), (3, None), (4, ""),
            (5, "a b " + mit.replace("hereby", "now").upper() + " and licensed under the apache license version 2 0 c"), (None, "Licensed under the MIT License")]
    rows = scan(spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, license string"), templates).collect()
    got = {(r.doc_id, r.license, round(r.coverage or 0, 3), r.first_word, r.last_word) for r in rows}
    n = len(mit.split())
    assert got == {(1, "Apache-2.0", 1.0, 2, 9), (2, None, 0, None, None), (3, None, 0, None, None), (4, None, 0, None, None),
                   (5, "MIT", round((n - 1) / n, 3), 2, n + 1), (5, "Apache-2.0", 1.0, n + 3, n + 10), (None, "MIT", 1.0, 0, 4)}


def test_quotations(spark):
    rows = [(1, 0, "a", "Hello there.\nSecond line"), (1, 1, "b", "> Hello there.\n> Second line\nI agree"), (1, 2, "c", "> > Hello there.\n> I agree\nMe too"),
            (1, 3, "d", "Unrelated"), (1, 3, "d", "Unrelated"), (1, 4, "e", ">second   LINE\nYes"), (1, 5, "f", "> nothing known\nhm"), (1, 6, "g", ">me too\n ok"),
            (None, 1, "x", "> q"), (2, None, "x", None), (2, 0, None, None), (2, 1, "v", "")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn int, role string, text string, h string")
    got = {(r.conv_id, r.turn): (r.text, r.n_quotes, r.max_depth, r.n_linked, r.parent_turn, r.root_turn) for r in link_quotations(df).collect()}
    assert got[1, 0] == ("Hello there.\nSecond line", 0, 0, 0, None, 0)
    assert got[1, 1] == ("I agree", 1, 1, 1, 0, 0)
    assert got[1, 2] == ("Me too", 2, 2, 2, 1, 0)
    assert got[1, 4] == ("Yes", 1, 1, 1, 0, 0)
    assert got[1, 5] == ("hm", 1, 1, 0, None, 5)
    assert got[1, 6] == (" ok", 1, 1, 1, 2, 0)
    assert got[2, 0] == (None, 0, 0, 0, None, 0) and got[None, 1][4:] == (None, 1) and got[2, None][5] is None
    order = [r.turn for r in link_quotations(df).where("conv_id = 1").orderBy("reply_order").collect()]
    assert order == [0, 1, 2, 4, 6, 3, 3, 5]
    assert link_quotations(df.limit(0)).count() == 0


def test_long_chain_of_replies(spark):
    rows = [(1, i, "u", (f"> message {i - 1}\n" if i else "") + f"message {i}") for i in range(700)]
    out = link_quotations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert all(r.root_turn == 0 and r.reply_order == r.turn for r in out)
    assert np.all([r.parent_turn == (r.turn - 1 if r.turn else None) for r in out])


def test_quotations_match_sql(spark):
    import duckdb
    from chronofold.llm.queries import ORACLES
    rnd = random.Random(11)
    said = ["Good morning all", "I agree\nwith   this", "One\n\ntwo\nthree", "no", "The plan is fine", ""]
    rows = []
    for conv in range(6):
        texts = []
        for turn in range(14):
            parts = []
            for _ in range(rnd.randrange(3)):
                if texts:
                    mark = rnd.choice([">", "> ", ">> ", "> > "])
                    parts.append("\n".join(mark + x for x in rnd.choice(texts).split("\n")))
                parts.append(rnd.choice(said))
            parts.append(f"message {turn % 9} " + rnd.choice(said))
            texts.append("\n".join(parts))
            rows.append((conv, turn, rnd.choice("ab"), texts[-1]))
    rows += [(None, 1, "a", "> x"), (9, None, "a", "y"), (9, 0, None, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn INT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cur = con.execute(ORACLES["op9_quotations"])
    names = [x[0] for x in cur.description]
    want = sorted(map(repr, (dict(zip(names, r)) for r in cur.fetchall())))
    df = link_quotations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = sorted(map(repr, ({n: r[n] for n in names} for r in df.collect())))
    assert got == want
    assert sum("'parent_turn': None" not in x for x in got) > 20
