"""Polygons against a plain even-odd test."""

import random

from pyspark.sql import functions as F

from chronofold.operators import spatial as sp

SHAPE = "k int, slug string, part int, rings array<array<struct<lng:double,lat:double>>>"


def ring(points):
    return [{"lng": float(x), "lat": float(y)} for x, y in points]


BOW = [(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)]                # crosses itself
SQUARE, HOLE = [(-20, -20), (30, -20), (30, 30), (-20, 30)], [(2, 2), (8, 2), (8, 8), (2, 8), (2, 2)]
WEST, EAST = [(170, -5), (180, -5), (180, 5), (170, 5), (170, -5)], [(-180, -5), (-170, -5), (-170, 5), (-180, 5), (-180, -5)]
WORLD = [(-180, -90), (180, -90), (180, 90), (-180, 90), (-180, -90)]
POLYGONS = [(0, "bow", 0, [ring(BOW)]), (1, "square", 0, [ring(SQUARE), ring(HOLE)]), (2, "dateline", 0, [ring(WEST)]),
            (2, "dateline", 1, [ring(EAST)]), (3, "world", 0, [ring(WORLD)])]


def odd(x, y, r):
    inside = False
    for i in range(len(r)):
        a, b = r[i], r[i - 1]
        xi, yi, xj, yj = a["lng"], a["lat"], b["lng"], b["lat"]
        if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
            inside = not inside
    return inside


def holds(x, y, rings):
    return odd(x, y, rings[0]) and not any(odd(x, y, h) for h in rings[1:])


def points(spark):
    r = random.Random(4)
    data = [(i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(300)] + [(300 + i, r.uniform(-22, 32), r.uniform(-22, 32)) for i in range(300)]
    data += [(600 + i, float(r.randrange(-20, 31)), float(r.randrange(-20, 31))) for i in range(200)] + [(900, 175.0, 0.0), (901, -175.0, 0.0), (902, 180.0, 90.0)]
    return data, spark.createDataFrame(data, "entry_id int, lng double, lat double")


def test_containing(spark):
    data, df = points(spark)
    polygons = spark.createDataFrame(POLYGONS, SHAPE)
    want = {(i, s) for i, x, y in data for _, s, _, rings in POLYGONS if holds(x, y, rings)}
    for size in (4.0, 1.0, 60.0):
        got = {(r.entry_id, r.slug) for r in sp.containing(df, polygons, ["slug"], size).collect()}
        assert got == want


def test_first_containing_both_ways(spark, monkeypatch):
    data, df = points(spark)
    polygons = spark.createDataFrame(POLYGONS, SHAPE).withColumn("all", F.lit(1))
    want = {}
    for i, x, y in data:
        hit = [s for _, s, _, rings in POLYGONS if holds(x, y, rings)]
        if hit:
            want[i] = hit[0]
    run = lambda: {r.entry_id: r.slug for r in sp.first_containing(df, polygons, ["entry_id"], ["all"], "k", "slug").collect()}
    assert run() == want
    monkeypatch.setattr(sp, "PIECE_BYTES", 0)
    assert run() == want


def test_inside_and_outside_are_everything(spark):
    _, df = points(spark)
    entries = df.select(F.col("entry_id").alias("id")).unionAll(spark.createDataFrame([(5000,)], "id int"))
    b = spark.createDataFrame(POLYGONS, SHAPE).filter("slug = 'square'")
    inside, outside = sp.inside_boundary(entries, df, b), sp.outside_boundary(entries, df, b)
    assert inside.count() + outside.count() == entries.count() and inside.intersect(outside).isEmpty()
    assert outside.filter("id = 5000").count() == 1


def test_representative_point_is_inside(spark):
    shapes = spark.createDataFrame([(s, [rings]) for _, s, _, rings in POLYGONS] + [("u", [[ring([(0, 0), (30, 0), (30, 30), (20, 30), (20, 10), (10, 10), (10, 30), (0, 30), (0, 0)])]])],
                                   "slug string, polygons array<array<array<struct<lng:double,lat:double>>>>")
    for r in shapes.select("slug", "polygons", sp.representative_point(F.col("polygons")).alias("p")).collect():
        assert any(holds(r.p.lng, r.p.lat, rings) for rings in r.polygons), r.slug


def test_ring_clean_and_simplify(spark):
    df = spark.createDataFrame([(1, ring([(0.005, -0.005), (5, .1), (10, 0), (10, 10), (0, 10)])), (2, ring([(0, 0), (1, 1), (0, 0)]))],
                               "i int, ring array<struct<lng:double,lat:double>>")
    c = {r.i: r.c for r in df.select("i", sp.clean_ring(F.col("ring")).alias("c")).collect()}
    # Halves go up: 0.005 to 0.01, -0.005 to 0.
    assert [(p.lng, p.lat) for p in c[1]] == [(0.01, 0.0), (5.0, 0.1), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.01, 0.0)]
    assert c[2] is None
    s = {r.i: len(r.ring) for r in sp.simplify_rings(df, "ring", 0.4).collect()}
    assert s == {1: 4, 2: 3}


def test_crowded_cells_are_cut(spark, monkeypatch):
    """Small cells and large ones agree with the plain rule, on lattice points, level edges and holes too."""
    data, df = points(spark)
    r = random.Random(12)
    lattice = [(r.randrange(-20, 31), r.randrange(-20, 31)) for _ in range(60)]
    steps = [(-10, -10), (4, -10), (4, 0), (12, 0), (12, 4), (0, 4), (0, 8), (8, 8), (8, 12), (-10, 12)]  # level and upright edges on borders
    shapes = [*POLYGONS, (4, "wild", 0, [ring(lattice), ring(HOLE), ring(BOW)]), (5, "steps", 0, [ring(steps)])]
    polygons = spark.createDataFrame(shapes, SHAPE)
    want = {(i, s) for i, x, y in data for _, s, _, rings in shapes if holds(x, y, rings)}
    for crowded in (3,):
        monkeypatch.setattr(sp, "CROWDED", crowded)
        assert len(sp.pieces(polygons, ["slug"])[1]) > 2
        assert {(r.entry_id, r.slug) for r in sp.containing(df, polygons, ["slug"]).collect()} == want
    assert sorted(r.entry_id for r in sp.points_inside(df, polygons.filter("k in (4, 5)")).collect()) == sorted({i for i, s in want if s in ("wild", "steps")})
    first = sp.first_containing(df, polygons.withColumn("all", F.lit(1)), ["entry_id"], ["all"], "k", "slug").collect()
    order = {s: k for k, s, _, _ in shapes}
    assert {r.entry_id: r.slug for r in first} == {i: min((s for j, s in want if j == i), key=order.get) for i in {i for i, _ in want}}


def test_a_ring_of_100000_vertices(spark):
    import math
    n = 100_000
    at = lambda i: (20 * math.cos(2 * math.pi * i / n) * (1 + 0.1 * math.sin(300 * math.pi * i / n)), 15 * math.sin(2 * math.pi * i / n))
    coast = spark.range(1).select(F.lit("coast").alias("slug"), F.array(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
        (20 * F.cos(2 * math.pi * i / n) * (1 + 0.1 * F.sin(300 * math.pi * i / n))).alias("lng"), (15 * F.sin(2 * math.pi * i / n)).alias("lat")))).alias("rings"))
    cells, levels, _ = sp.pieces(coast, ["slug"])
    stored, most = cells.select(F.size(F.get("rings", F.lit(0))["edges"]).alias("e")).agg(F.sum("e"), F.max("e")).first()
    assert len(levels) > 3 and most <= sp.CROWDED
    assert stored < 1.2 * n  # an edge is in the cells it crosses, of which there is mostly one
    r = random.Random(3)
    data = [(i, r.uniform(-23, 23), r.uniform(-16, 16)) for i in range(15)] + [(100 + i, at(i * 6311)[0] + d, at(i * 6311)[1]) for i in range(15) for d in [1e-4 * (-1) ** i]]
    rings = [[{"lng": x, "lat": y} for x, y in map(at, range(n))]]
    got = {x.entry_id for x in sp.containing(spark.createDataFrame(data, "entry_id int, lng double, lat double"), coast, ["slug"]).collect()}
    assert got == {i for i, x, y in data if holds(x, y, rings)}
