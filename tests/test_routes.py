"""Way networks and journeys."""

import random

from pyspark.sql import functions as F

from chronofold.operators import facts, routes

SCHEMA = "line long, points array<struct<lat:double,lng:double>>"


def lines(spark, ends):
    return spark.createDataFrame([(i, [{"lat": float(a), "lng": 0.0}, {"lat": float(b), "lng": 0.0}]) for i, (a, b) in enumerate(ends)], SCHEMA)


def walk(ends):
    """The walk as the rule states it, over place names."""
    used, out = set(), {}
    at = lambda place: [(i, side) for i, e in enumerate(ends) for side in (0, 1) if e[side] == place and i not in used]
    for first in range(len(ends)):
        if first in used:
            continue
        used.add(first)
        chain, tail, head = [(first, False)], ends[first][1], ends[first][0]
        while at(tail):
            i, side = at(tail)[0]
            used.add(i)
            chain.append((i, side == 1))
            tail = ends[i][1 - side]
        while at(head):
            i, side = at(head)[0]
            used.add(i)
            chain.insert(0, (i, side == 0))
            head = ends[i][1 - side]
        out.update({i: (first, n, turned) for n, (i, turned) in enumerate(chain)})
    return out


def got(df):
    return {r.line: (r.chain, r.seq, r.turned) for r in df.collect()}


def test_merge_with_junctions(spark):
    for seed, places, n in ((5, 25, 60), (6, 40, 60), (7, 70, 60), (8, 6, 20)):
        r = random.Random(seed)
        ends = [(r.randrange(places), r.randrange(places)) for _ in range(n)] + [(100, 101), (200, 200)]
        assert got(routes.merge_lines(lines(spark, ends))) == walk(ends), seed


def test_long_strands_between_junctions(spark):
    # Rings and paths of many lines hung on a few junctions, in any order and direction.
    r = random.Random(4)
    ends, free = [], 1000
    for _ in range(9):
        stops = [r.randrange(4), *range(free, free + r.randrange(6)), r.randrange(4)]
        free += 10
        ends += [(a, b) if r.random() < 0.5 else (b, a) for a, b in zip(stops, stops[1:])]
    r.shuffle(ends)
    assert got(routes.merge_lines(lines(spark, ends))) == walk(ends)


def test_merge_without_junctions(spark):
    # Strips, some lines turned, a ring of seven, a ring of one, a single line.
    ends = [(i, i + 1) if i % 3 else (i + 1, i) for i in range(30) if i != 12]
    ends += [(100 + i, 100 + (i + 1) % 7) if i % 2 else (100 + (i + 1) % 7, 100 + i) for i in range(7)]
    ends += [(300, 300), (400, 401)]
    random.Random(3).shuffle(ends)
    assert got(routes.merge_lines(lines(spark, ends))) == walk(ends)


def test_chain_points_and_lengths(spark):
    df = lines(spark, [(1, 0), (1, 2), (3, 2)])
    c = routes.merge_lines(df)
    p = routes.chain_points(df, c).collect()
    assert [[q.lat for q in x.points] for x in p] == [[3.0, 2.0, 1.0, 0.0]]
    n = routes.chain_lengths(df, c).first()
    assert n.n_lines == 3 and abs(n.length_km - 3 * 111.19492664) < 1e-3


def test_reach_with_cycles_is_idempotent(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (4, 3), (9, 8)], "child long, parent long")
    roots = spark.createDataFrame([(1,), (8,)], "root long")
    once = facts.descendants(edges, roots)
    assert {tuple(r) for r in once.collect()} == {(1, 1), (1, 2), (1, 3), (1, 4), (8, 8), (8, 9)}
    again = facts.descendants(edges, once.filter("root = 1").select(F.col("type").alias("root")))
    assert {r.type for r in again.collect()} == {1, 2, 3, 4}


def test_dates_are_the_same_for_any_block_size(spark):
    r = random.Random(2)
    data = [(p, i, r.choice([None, 1, 2, 6, 11]), 1800 + r.randrange(9) if r.random() < .12 else None) for p in range(4) for i in range(120)]
    df = spark.createDataFrame(data, "path int, pos int, stated_month int, stated_year int").withColumns({
        "stated_day": F.lit(5), "has_fragment": F.col("stated_month").isNotNull() | F.col("stated_year").isNotNull()})
    one = sorted(map(tuple, routes.carry_dates(df, "path", "pos", 10_000).select("path", "pos", "year", "month").collect()), key=lambda x: x[:2])
    for block in (1, 3, 17):
        more = sorted(map(tuple, routes.carry_dates(df, "path", "pos", block).select("path", "pos", "year", "month").collect()), key=lambda x: x[:2])
        assert more == one
    # And the same as reading row by row.
    for p in range(4):
        year = month = None
        for (path, pos, m, y), (_, _, gy, gm) in zip([d for d in data if d[0] == p], [o for o in one if o[0] == p]):
            if y:
                year = y
            elif m and month is not None and m < month and year is not None:
                year += 1
            if m:
                month = m
            want = (year, month) if (m or y) and year is not None and month is not None else (None, None)
            assert (gy, gm) == want, (path, pos)
