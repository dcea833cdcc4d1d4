"""Points and polygons.

Polygons are rows with `rings`: an array of rings, each an array of
struct(lng, lat); ring 0 is the outside, the others are holes.  A feature with
several polygons has one row per `part`.

The join cuts every polygon into cells, and crowded cells into quarters.  A cell row keeps only the edges that cross
the cell, and for each ring whether a ray from the cell's south-east corner to the east crosses the rest of it an odd number of
times.  So a world-sized polygon is many small rows, and a point meets only the pieces of its own cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from chronofold.functions.text import let
from chronofold.operators.scans import Running, running
from chronofold.runtime import cut, keep_if

CELL_DEGREES = 4.0
# Bytes of edges in the pieces that may be broadcast; an edge is four doubles.
PIECE_BYTES = 64 << 20
# Edges of a ring in a cell above which it is cut into quarters, and how often that is done at most.
CROWDED, DEEPEST = 64, 10
# What an edge may be off a cell's border, in degrees, to be stored in the cell.
NEAR = 1e-9
VERTEX = "struct<lng:double,lat:double>"
EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0


# -- rings ------------------------------------------------------------------

def to_rings(coordinates: Column) -> Column:
    """[[[lng, lat], ...], ...] to rings of named points."""
    return F.transform(coordinates, lambda ring: F.transform(
        ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("lng"), F.get(p, F.lit(1)).alias("lat"))))


def all_edges(ring: Column) -> Column:
    """Edges from each vertex (x, y) to the one before it (px, py)."""
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: let(
        F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + n - 1) % n).alias("b")),
        lambda e: F.struct(e["a"]["lng"].cast("double").alias("x"), e["a"]["lat"].cast("double").alias("y"),
                           e["b"]["lng"].cast("double").alias("px"), e["b"]["lat"].cast("double").alias("py"))))
    return F.when(n > 0, edges).otherwise(F.array().cast("array<struct<x:double,y:double,px:double,py:double>>"))


def ring_edges(ring: Column) -> Column:
    """The same, level ones left out."""
    return F.filter(all_edges(ring), lambda e: e["y"] != e["py"])


def crossing_x(e: Column, lat: Column) -> Column:
    return (e["px"] - e["x"]) * (lat - e["y"]) / (e["py"] - e["y"]) + e["x"]


def odd_crossings(edges: Column, lng: Column, lat: Column) -> Column:
    """Even-odd rule: the ray to the east crosses the ring an odd number of times."""
    hit = F.filter(edges, lambda e: ((e["y"] > lat) != (e["py"] > lat)) & (lng < crossing_x(e, lat)))
    return F.size(hit) % 2 == 1


def rings_from_vertices(vertices: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Vertex rows of one-ring polygons to polygon rows."""
    v = F.struct(F.col(order), F.struct(F.col("lng").cast("double").alias("lng"),
                                        F.col("lat").cast("double").alias("lat")).alias("v"))
    return vertices.groupBy(*keys).agg(F.sort_array(F.collect_list(v)).alias("vs")).select(
        *keys, F.lit(0).alias("part"), F.array(F.col("vs.v")).alias("rings"))


# -- grid -------------------------------------------------------------------

def cell(c: Column, size: float = CELL_DEGREES) -> Column:
    return F.floor(c / F.lit(size)).cast("int")


def _straddles(e: Column, lat: Column) -> Column:
    return (e["y"] > lat) != (e["py"] > lat)


def _east_of(e: Column, lat: Column, east: Column) -> Column:
    """Whether the edge is east of a meridian at a latitude, or at the end of it that is nearest to the latitude."""
    up = e["y"] >= e["py"]
    high, low = F.when(up, e["x"]).otherwise(e["px"]), F.when(up, e["px"]).otherwise(e["x"])
    return F.when(_straddles(e, lat), crossing_x(e, lat) > east).when(F.greatest(e["y"], e["py"]) <= lat, high > east).otherwise(low > east)


def ring_holds(ring: Column, lng: Column, lat: Column, east: Column, south: Column) -> Column:
    """The even-odd rule for a point of a cell, by the ring's edges in the cell alone.

    The ray from the point to the east crosses edges as far as the cell's border.  Beyond it, it crosses as many as the ray from
    the corner (east, south) does, but for one each time an edge crosses the border between the two.
    """
    change = lambda e: _east_of(e, lat, east) != _east_of(e, south, east)
    meets = lambda e: _straddles(e, lat) & (lng < crossing_x(e, lat)) & (crossing_x(e, lat) <= east)
    n = F.size(F.filter(ring["edges"], lambda e: change(e) != meets(e)))
    return ring["odd"] != (n % 2 == 1)


def in_piece(rings: Column, lng: Column, lat: Column, level: Column, cx: Column, cy: Column, size: float) -> Column:
    """In the first ring and in none of the others."""
    width = _width(level, size)
    east, south = (cx + 1) * width, cy * width
    holds = lambda r: ring_holds(r, lng, lat, east, south)
    return holds(F.get(rings, F.lit(0))) & ~F.exists(F.slice(rings, 2, F.size(rings)), holds)


def _width(level: Column, size: float) -> Column:
    return F.lit(size) / F.pow(F.lit(2.0), level)


def _touches(e: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether an edge comes into a cell, borders included."""
    low, high = south - NEAR, north + NEAR
    bottom, top = F.greatest(F.least(e["y"], e["py"]), low), F.least(F.greatest(e["y"], e["py"]), high)
    level = e["y"] == e["py"]
    a = F.when(level, e["x"]).otherwise(crossing_x(e, bottom))
    b = F.when(level, e["px"]).otherwise(crossing_x(e, top))
    return (bottom <= top) & (F.least(a, b) <= east + NEAR) & (F.greatest(a, b) >= west - NEAR)


def _worth_keeping(df: DataFrame) -> DataFrame:
    """Cells that hold a part of the polygon, without the holes that do not reach them."""
    first = F.get("rings", F.lit(0))
    some = lambda r: r["odd"] | (F.size(r["edges"]) > 0)
    return df.filter(some(first)).withColumn("rings", F.concat(F.array(first), F.filter(F.slice("rings", 2, F.size("rings")), some)))


def _crowded() -> Column:
    return F.exists("rings", lambda r: F.size(r["edges"]) > CROWDED)


def _cells(polygons: DataFrame, keys: list[str], size: float) -> DataFrame:
    """(keys, level, cx, cy, rings): the polygons cut to the cells of the grid, row by row."""
    df = polygons.select(*keys, F.transform("rings", lambda r: F.filter(all_edges(r), lambda e: (e["x"] != e["px"]) | (e["y"] != e["py"]))).alias("rings"))
    df = df.withColumn("ys", F.transform(F.get("rings", F.lit(0)), lambda e: e["y"])).filter(F.size("ys") > 0)
    df = df.withColumn("cy", F.explode(F.sequence(cell(F.array_min("ys"), size), cell(F.array_max("ys"), size))))
    south, north = F.col("cy") * F.lit(size), (F.col("cy") + 1) * F.lit(size)
    df = df.withColumn("rings", F.transform("rings", lambda r: F.filter(
        r, lambda e: (F.least(e["y"], e["py"]) <= north + NEAR) & (F.greatest(e["y"], e["py"]) >= south - NEAR))))
    crossed = lambda r: F.transform(F.filter(r, lambda e: _straddles(e, south)), lambda e: crossing_x(e, south))
    df = df.withColumn("crossed", F.transform("rings", crossed))
    outer = F.get("rings", F.lit(0))
    df = df.withColumn("xs", F.concat(F.transform(outer, lambda e: e["x"]), F.transform(outer, lambda e: e["px"]))).filter(F.size("xs") > 0)
    df = df.withColumn("cx", F.explode(F.sequence(cell(F.array_min("xs"), size), cell(F.array_max("xs"), size))))
    west, east = F.col("cx") * F.lit(size), (F.col("cx") + 1) * F.lit(size)
    rings = F.transform("rings", lambda r, i: F.struct(
        (F.size(F.filter(F.get("crossed", i), lambda x: x > east)) % 2 == 1).alias("odd"),
        F.filter(r, lambda e: _touches(e, west, south, east, north)).alias("edges")))
    return _worth_keeping(df.select(*keys, F.lit(0).alias("level"), "cx", "cy", rings.alias("rings")))


def _quarters(df: DataFrame, keys: list[str], size: float) -> DataFrame:
    width = _width(F.col("level"), size)
    df = df.withColumns({"__east": (F.col("cx") + 1) * width, "__south": F.col("cy") * width})
    side = lambda n: F.explode(F.array(F.lit(0), F.lit(1))).alias(n)
    df = df.select("*", side("__dx")).select("*", side("__dy"))
    x, y, half = F.col("cx") * 2 + F.col("__dx"), F.col("cy") * 2 + F.col("__dy"), width / 2
    rings = F.transform("rings", lambda r: F.struct(
        ring_holds(r, (x + 1) * half, y * half, F.col("__east"), F.col("__south")).alias("odd"),
        F.filter(r["edges"], lambda e: _touches(e, x * half, y * half, (x + 1) * half, (y + 1) * half)).alias("edges")))
    # New names first: within the lambdas an alias of the same list would stand before the column.
    df = df.select(*keys, (F.col("level") + 1).alias("__level"), x.alias("__x"), y.alias("__y"), rings.alias("__rings"))
    return _worth_keeping(df.select(*keys, F.col("__level").alias("level"), F.col("__x").alias("cx"), F.col("__y").alias("cy"), F.col("__rings").alias("rings")))


def pieces(polygons: DataFrame, keys: list[str], size: float = CELL_DEGREES) -> tuple[DataFrame, list[int], bool]:
    """(keys, level, cx, cy, rings), the levels there are, and whether the edges are few enough to broadcast.

    A polygon's cells, those of many edges cut into quarters: a cell of a level is half as wide as one of the level above.  An edge is
    stored in the cells it crosses.  Each level is cut once and written out.
    """
    out, levels, total, cells = None, [], 0, _cells(polygons, keys, size)
    edges = F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r["edges"]))
    for level in range(DEEPEST + 1):
        cells = cut(cells, "pieces")
        crowded, plain = cells.filter(_crowded()), cells.filter(~_crowded())
        n, size_ = cells.agg(F.count_if(_crowded()), F.coalesce(F.sum(F.when(~_crowded(), edges * 32 + 64)), F.lit(0))).first()
        done = not n or level == DEEPEST
        held = cells if done else plain
        out = held if out is None else out.unionByName(held)
        levels, total = [*levels, level], total + size_
        if done:
            break
        cells = _quarters(crowded, keys, size)
    return out, levels, total <= PIECE_BYTES


def on_grid(points: DataFrame, size: float = CELL_DEGREES, levels: list[int] | None = None) -> DataFrame:
    """Points with their cell, one row for each of the levels."""
    if levels in (None, [0]):
        return points.withColumns({"level": F.lit(0), "cx": cell(F.col("lng"), size), "cy": cell(F.col("lat"), size)})
    at = F.array(*[F.struct(F.lit(n).alias("level"), cell(F.col("lng"), size / 2**n).alias("cx"), cell(F.col("lat"), size / 2**n).alias("cy")) for n in levels])
    return points.withColumn("__at", F.explode(at)).select(*points.columns, "__at.*")


CELL = ["level", "cx", "cy"]


def points_inside(points: DataFrame, polygons: DataFrame, size: float = CELL_DEGREES) -> DataFrame:
    """Points in at least one of the polygons, each once, by a semi join.

    The pieces are broadcast when their bytes are few; otherwise both sides shuffle
    by cell and adaptive execution splits a crowded cell.
    """
    p, levels, small = pieces(polygons, [], size)
    p = F.broadcast(p) if small else p
    b = p.alias("b")
    here = in_piece(F.col("b.rings"), F.col("a.lng"), F.col("a.lat"), F.col("b.level"), F.col("b.cx"), F.col("b.cy"), size)
    if levels == [0]:
        a = on_grid(points, size).alias("a")
        cond = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & here
        return a.join(b, cond, "left_semi").drop(*CELL)
    # A point has a row for each level; different polygons may hold it at different ones.
    keyed = points.withColumn("__point", F.struct(*[F.col(f"`{c}`") for c in points.columns]))
    a = on_grid(keyed, size, levels).alias("a")
    cond = (F.col("a.level") == F.col("b.level")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & here
    hits = a.join(b, cond, "left_semi").select("__point").distinct()
    return keyed.join(hits, "__point", "left_semi").drop("__point")


def containing(points: DataFrame, polygons: DataFrame, keys: list[str], size: float = CELL_DEGREES) -> DataFrame:
    """Every (point, polygon) where the polygon holds the point; parts count once each."""
    p, levels, small = pieces(polygons, keys, size)
    hit = on_grid(points, size, levels).join(F.broadcast(p) if small else p, CELL)
    return hit.filter(in_piece(F.col("rings"), F.col("lng"), F.col("lat"), *map(F.col, CELL), size)).drop(*CELL, "rings")


def inside_boundary(entries: DataFrame, primary: DataFrame, boundary: DataFrame) -> DataFrame:
    """Entries whose primary point lies in the boundary; no boundary, no rows."""
    ids = points_inside(primary, boundary).select(F.col("entry_id").alias("id"))
    return entries.join(ids, "id", "left_semi")


def outside_boundary(entries: DataFrame, primary: DataFrame, boundary: DataFrame) -> DataFrame:
    """The rest: entries with no point, and all entries when the boundary is unknown."""
    ids = points_inside(primary, boundary).select(F.col("entry_id").alias("id"))
    return entries.join(ids, "id", "left_anti")


def first_containing(points: DataFrame, polygons: DataFrame, point_keys: list[str], group: list[str],
                     order: str, name: str, size: float = CELL_DEGREES) -> DataFrame:
    """(point keys, group, name): for each point and group the first polygon, by
    `order`, that holds it.

    With few pieces, none of them crowded, each cell carries its polygons in order, and a point reads
    its one cell row: no shuffle.  Otherwise the matches are cut down by a
    partial minimum per point.
    """
    p, levels, small = pieces(polygons, [*group, order, name], size)
    grid = on_grid(points, size, levels)
    at = [F.col(c) for c in CELL]
    if small and levels == [0]:
        cells = p.groupBy(*CELL, *group).agg(F.sort_array(F.collect_list(F.struct(order, name, "rings"))).alias("c"))
        hit = grid.join(F.broadcast(cells), CELL).select(*point_keys, *group, F.get(F.filter(
            "c", lambda c: in_piece(c["rings"], F.col("lng"), F.col("lat"), *at, size)), F.lit(0))[name].alias(name))
        return keep_if(hit, F.col(name).isNotNull())
    hit = grid.join(F.broadcast(p) if small else p, CELL).filter(in_piece(F.col("rings"), F.col("lng"), F.col("lat"), *at, size))
    return (hit.groupBy(*point_keys, *group).agg(F.min(F.struct(order, name)).alias("m"))
            .select(*point_keys, *group, F.col(f"m.{name}").alias(name)))


# -- single geometries ------------------------------------------------------

def bbox(polygons: Column) -> Column:
    """struct(lng_min, lat_min, lng_max, lat_max) over all vertices of
    array<rings of struct(lng, lat)>."""
    v = F.flatten(F.flatten(polygons))
    return F.struct(F.array_min(v["lng"]).alias("lng_min"), F.array_min(v["lat"]).alias("lat_min"),
                    F.array_max(v["lng"]).alias("lng_max"), F.array_max(v["lat"]).alias("lat_max"))


def ring_area(ring: Column) -> Column:
    """Area by the shoelace sum, in square degrees."""
    return F.abs(F.aggregate(ring_edges(ring), F.lit(0.0),
                             lambda s, e: s + (e["px"] + e["x"]) * (e["y"] - e["py"]))) / 2


def representative_point(polygons: Column) -> Column:
    """A point inside: on the largest part, at half height, the middle of the
    widest span that lies inside."""
    largest = F.array_max(F.transform(polygons, lambda rings, i: F.struct(
        ring_area(F.get(rings, F.lit(0))).alias("area"), (-i).alias("n"))))
    rings = F.get(polygons, -largest["n"])

    def at(edges: Column) -> Column:
        ys = F.transform(edges, lambda e: e["y"])
        return let((F.array_min(ys) + F.array_max(ys)) / 2, lambda lat: let(
            F.array_sort(F.transform(F.filter(edges, lambda e: (e["y"] > lat) != (e["py"] > lat)),
                                     lambda e: crossing_x(e, lat))),
            lambda xs: F.when(F.size(xs) >= 2, let(
                F.array_max(F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / 2).cast("int") - 1), lambda i: F.struct(
                    (F.get(xs, i * 2 + 1) - F.get(xs, i * 2)).alias("width"),
                    ((F.get(xs, i * 2 + 1) + F.get(xs, i * 2)) / 2).alias("mid")))),
                lambda best: F.struct(best["mid"].alias("lng"), lat.alias("lat"))))))

    return let(F.flatten(F.transform(rings, ring_edges)), at)


def filter_point(kind: Column, lng: Column, lat: Column, polygons: Column) -> Column:
    """Point used by filters: itself, a circle's centre, a point inside a polygon; none for a path."""
    return (F.when(kind.isin("point", "circle"), F.struct(lng.alias("lng"), lat.alias("lat")))
            .when(kind.isin("polygon", "multipolygon"), representative_point(polygons)))


def layout_point(kind: Column, lng: Column, lat: Column, polygons: Column, waypoints: Column) -> Column:
    """Point used by lanes: a polygon's first vertex, a path's first waypoint."""
    first = F.get(F.get(F.get(polygons, F.lit(0)), F.lit(0)), F.lit(0))
    way = F.get(waypoints, F.lit(0))
    return (F.when(kind.isin("point", "circle"), F.struct(lng.alias("lng"), lat.alias("lat")))
            .when(kind.isin("polygon", "multipolygon"), F.struct(first["lng"].alias("lng"), first["lat"].alias("lat")))
            .when(kind == "path", F.struct(way["lng"].alias("lng"), way["lat"].alias("lat"))))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    h = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0))
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0)))
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def polyline_km(points: Column) -> Column:
    """Length of array<struct(lng, lat)>."""
    legs = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points)),
                      lambda a, b: haversine_km(a["lat"], a["lng"], b["lat"], b["lng"]))
    return F.when(F.size(points) < 2, F.lit(0.0)).otherwise(F.aggregate(legs, F.lit(0.0), lambda s, k: s + k))


def vertex_row_lengths(vertices: DataFrame, line: str, pos: str, block: int = 100_000) -> DataFrame:
    """(line, n_points, length_km) from vertex rows, however long a line is."""
    df = vertices.select(line, pos, "lng", "lat", F.floor(F.col(pos) / block).alias("__block"))
    df = running(df, [line], "__block", [pos], {"before": Running("last", F.struct("lng", "lat"), False)})
    leg = haversine_km(F.col("before.lat"), F.col("before.lng"), F.col("lat"), F.col("lng"))
    return df.groupBy(line).agg(F.count(F.lit(1)).alias("n_points"),
                                F.coalesce(F.sum(leg), F.lit(0.0)).alias("length_km"))


def round_half_up(c: Column, places: int = 2) -> Column:
    """Halves go up, also below zero."""
    k = float(10 ** places)
    return F.floor(c * k + 0.5) / k


def clean_ring(ring: Column, places: int = 2) -> Column:
    """Rounded and closed ring; null under four points."""
    r = F.transform(ring, lambda p: F.struct(round_half_up(p["lng"], places).alias("lng"),
                                             round_half_up(p["lat"], places).alias("lat")))

    def close(x: Column) -> Column:
        first, last = F.get(x, F.lit(0)), F.get(x, F.size(x) - 1)
        return F.when((first["lng"] != last["lng"]) | (first["lat"] != last["lat"]),
                      F.concat(x, F.array(first))).otherwise(x)

    return F.when(F.size(ring) >= 4, let(r, close))


def _keep(xs: np.ndarray, ys: np.ndarray, eps: float) -> np.ndarray:
    """Which vertices a Ramer-Douglas-Peucker pass keeps."""
    keep = np.zeros(len(xs), dtype=bool)
    keep[[0, -1]] = True
    spans = [(0, len(xs) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        dx, dy = xs[b] - xs[a], ys[b] - ys[a]
        x, y = xs[a + 1:b] - xs[a], ys[a + 1:b] - ys[a]
        if dx == 0 and dy == 0:
            d = np.hypot(x, y)
        else:
            t = (x * dx + y * dy) / (dx * dx + dy * dy)
            d = np.hypot(x - t * dx, y - t * dy)
        i = int(np.argmax(d))
        if d[i] > eps:
            keep[a + 1 + i] = True
            spans += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


def simplify_rings(df: DataFrame, ring: str, eps: float = 0.4) -> DataFrame:
    """Ramer-Douglas-Peucker on one ring per row, in Arrow batches."""

    @F.pandas_udf(f"array<{VERTEX}>")
    def simplify(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys):
            x, y = np.asarray(x, float), np.asarray(y, float)
            k = _keep(x, y, eps) if len(x) >= 3 else np.ones(len(x), bool)
            out.append([{"lng": a, "lat": b} for a, b in zip(x[k], y[k])])
        return pd.Series(out)

    return df.withColumn(ring, simplify(F.col(ring)["lng"], F.col(ring)["lat"]))


def rectangle(lng_min: Column, lat_min: Column, lng_max: Column, lat_max: Column) -> Column:
    """One polygon (rings) with a closed five-point ring."""
    def p(x, y):
        return F.struct(x.cast("double").alias("lng"), y.cast("double").alias("lat"))
    return F.array(F.array(p(lng_min, lat_min), p(lng_max, lat_min), p(lng_max, lat_max),
                           p(lng_min, lat_max), p(lng_min, lat_min)))


def circle_degrees(radius_km: Column) -> Column:
    return radius_km / KM_PER_DEGREE
