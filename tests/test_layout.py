"""Packers against a plain reading of the same rules."""

import random

import pytest

from chronofold.operators.layout import pack_rows, pack_tracks

SCHEMA = "lane string, id long, s int, e int"


def rows(seed, n, years, spans):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.randrange(years)
        out.append((r.choice("ab"), i, s, s + r.choice(spans)))
    return out


def plain_rows(data, pad, gap, most):
    out, ends = {}, {}
    for lane, i, s, e in sorted(data, key=lambda x: (x[0], x[2], x[1])):
        row_ends = ends.setdefault(lane, [])
        row = next((k for k, x in enumerate(row_ends) if x <= s - pad), None)
        if row is None:
            row = len(row_ends)
            if row >= most:
                row = most - 1
            else:
                row_ends.append(None)
        row_ends[row] = max(e, s + pad) + gap
        out[lane, i] = row
    return out


def plain_tracks(data):
    out = {}
    for lane in {d[0] for d in data}:
        active, placed = [None, None], {}
        for _, i, s, e in sorted((d for d in data if d[0] == lane), key=lambda x: (x[2], x[1])):
            active = [None if a and a[0] <= s else a for a in active]
            if None in active:
                t = active.index(None)
            else:
                t = 0 if active[0][0] <= active[1][0] else 1
                if e <= active[t][0]:
                    continue
                del placed[active[t][1]]
            active[t] = (e, i)
            placed[i] = t
        out.update({(lane, i): t for i, t in placed.items()})
    return out


@pytest.mark.parametrize("seed,n,years", [(1, 300, 400), (2, 600, 20), (3, 200, 5000)])
def test_pack_rows(spark, seed, n, years):
    data = rows(seed, n, years, [0, 0, 1, 5, 40, 120])
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r[0], r[1]): r[2] for r in pack_rows(df, "lane", "id", "s", "e", 2, 3).collect()}
    assert got == plain_rows(data, 2, 3, 8)


def test_pack_rows_never_overlap_below_the_cap(spark):
    data = rows(7, 400, 900, [0, 3, 60])
    got = {(r[0], r[1]): r[2] for r in pack_rows(spark.createDataFrame(data, SCHEMA), "lane", "id", "s", "e", 1, 2).collect()}
    by_row = {}
    for lane, i, s, e in sorted(data, key=lambda x: (x[2], x[1])):
        if got[lane, i] < 7:
            assert by_row.get((lane, got[lane, i]), -1e9) <= s - 1
            by_row[lane, got[lane, i]] = max(e, s + 1) + 2


@pytest.mark.parametrize("seed,n,years,spans", [
    (1, 300, 300, [0, 1, 5, 40]), (2, 500, 15, [0, 0, 1, 2, 3, 9, 30]), (3, 100, 2000, [0, 10, 500]), (4, 400, 3, [0, 1, 2, 3, 4])])
def test_pack_tracks(spark, seed, n, years, spans):
    data = rows(seed, n, years, spans)
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r[0], r[1]): r[2] for r in pack_tracks(df, "lane", "id", "s", "e").collect()}
    assert got == plain_tracks(data)
