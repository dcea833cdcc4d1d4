"""Queries over points, polygons and lanes."""

from pyspark.sql import Window as W, functions as F

from chronofold.operators import lanes as L, spatial as sp
from chronofold.plans import fixtures as v
from chronofold.plans.registry import query

RING = ["laneset_id", "ordinal", "slug"]


def polygons(spark, sf):
    return sp.rings_from_vertices(v.ring_vertices(spark, sf), RING, "vtx")


def shapes(spark, sf):
    return sp.rings_from_vertices(v.shape_vertices(spark, sf), RING, "vtx")


def some_boundary(spark, sf):
    return polygons(spark, sf).filter(F.col("slug").isin("lane-7", "lane-12"))


@query("inside_boundary", """
SELECT e.id, e.title FROM v_entries e WHERE EXISTS (SELECT 1 FROM v_hit h WHERE h.entry_id=e.id AND h.slug IN ('lane-7','lane-12'))""",
       ("v_entries", "v_hit"))
def inside_boundary(spark, sf):
    return sp.inside_boundary(v.entries(spark, sf), v.primary_points(spark, sf), some_boundary(spark, sf)).select("id", "title")


@query("outside_boundary", """
SELECT e.id, e.title FROM v_entries e WHERE NOT EXISTS (SELECT 1 FROM v_hit h WHERE h.entry_id=e.id AND h.slug IN ('lane-7','lane-12'))""",
       ("v_entries", "v_hit"))
def outside_boundary(spark, sf):
    return sp.outside_boundary(v.entries(spark, sf), v.primary_points(spark, sf), some_boundary(spark, sf)).select("id", "title")


@query("unknown_boundary", """SELECT 'inside' AS side, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'outside', count(*) FROM v_entries""", ("v_entries",))
def unknown_boundary(spark, sf):
    """An unknown boundary has nothing inside and everything outside."""
    none = polygons(spark, sf).filter(F.col("slug") == "no-such-boundary")
    e, p = v.entries(spark, sf), v.primary_points(spark, sf)
    n = F.count(F.lit(1)).alias("n")
    return sp.inside_boundary(e, p, none).agg(n).select(F.lit("inside").alias("side"), "n").unionAll(
        sp.outside_boundary(e, p, none).agg(n).select(F.lit("outside").alias("side"), "n"))


@query("point_in_polygon", "SELECT entry_id, slug FROM v_hit", ("v_hit",))
def point_in_polygon(spark, sf):
    """Every polygon that holds an entry's primary point."""
    return sp.containing(v.primary_points(spark, sf), polygons(spark, sf), ["slug"]).select("entry_id", "slug")


@query("point_in_polygon_with_hole", """
WITH hole AS (SELECT slug, p.entry_id, 1 AS h FROM v_locations p JOIN (SELECT slug, min(lng) x, min(lat) y FROM v_ring GROUP BY slug) r
  ON p.ordinal=0 AND p.lng>=r.x+10 AND p.lng<r.x+30 AND p.lat>=r.y+5 AND p.lat<r.y+25)
SELECT h.entry_id, h.slug FROM v_hit h LEFT JOIN hole o ON o.slug=h.slug AND o.entry_id=h.entry_id WHERE o.h IS NULL""", ("v_hit", "v_ring"))
def point_in_polygon_with_hole(spark, sf):
    """Each ring gets a rectangular hole; points in the hole are not inside."""
    p = polygons(spark, sf).withColumn("b", sp.bbox(F.array("rings")))
    x, y = F.col("b.lng_min"), F.col("b.lat_min")
    hole = F.get(sp.rectangle(x + 10, y + 5, x + 30, y + 25), F.lit(0))
    holed = p.withColumn("rings", F.concat("rings", F.array(hole)))
    return sp.containing(v.primary_points(spark, sf), holed, ["slug"]).select("entry_id", "slug")


@query("lane_assignment", """
SELECT entry_id, laneset_id, min_by(slug, ordinal) AS lane FROM v_hit GROUP BY entry_id, laneset_id""", ("v_hit",))
def lane_assignment(spark, sf):
    """First lane in order that holds the entry, for every laneset at once."""
    return L.assign_lanes(v.primary_points(spark, sf), polygons(spark, sf), ["entry_id"])


@query("lane_or_none", """
WITH one AS (SELECT entry_id, min_by(slug, ordinal) AS lane FROM v_hit WHERE laneset_id=2 GROUP BY entry_id)
SELECT e.id, o.lane, CASE WHEN p.entry_id IS NOT NULL THEN 'all' END AS lane_without_set FROM v_entries e
LEFT JOIN one o ON o.entry_id=e.id LEFT JOIN (SELECT DISTINCT entry_id FROM v_locations) p ON p.entry_id=e.id""", ("v_entries", "v_hit", "v_locations"))
def lane_or_none(spark, sf):
    """One laneset; entries in no lane, or with no point, keep a null."""
    e, p = v.entries(spark, sf), v.primary_points(spark, sf)
    lane = L.assign_lanes(p, polygons(spark, sf).filter("laneset_id = 2"), ["entry_id"])
    every = L.assign_all(p, ["entry_id"]).withColumnRenamed("lane", "lane_without_set")
    return (e.select("id").join(lane.select(F.col("entry_id").alias("id"), "lane"), "id", "left")
            .join(every.withColumnRenamed("entry_id", "id"), "id", "left"))


@query("era_lanes", """
WITH era AS (SELECT id, CASE WHEN id%36=6 THEN 'world-history' WHEN id%5=0 THEN 'china-history' ELSE 'rome-history' END AS source FROM v_entries
  WHERE category='historical_period' AND tag LIKE '%-history'),
lane AS (SELECT DISTINCT laneset_id, lane_id AS ordinal, slug FROM v_ring),
src AS (SELECT laneset_id, -1 AS ordinal, 'global' AS slug, 'world-history' AS source FROM (SELECT DISTINCT laneset_id FROM lane)
 UNION ALL SELECT laneset_id, ordinal, slug, 'rome-history' FROM lane WHERE ordinal%2=0 UNION ALL SELECT laneset_id, ordinal, slug, 'china-history' FROM lane WHERE ordinal%3=0)
SELECT e.id, e.source, s.laneset_id, min_by(s.slug, s.ordinal) AS lane FROM era e JOIN src s ON s.source=e.source GROUP BY e.id, e.source, s.laneset_id""",
       ("v_entries", "v_ring"))
def era_lanes(spark, sf):
    from chronofold.operators.entries import eras
    era = eras(v.entries_with_tags(spark, sf)).select("id").withColumn(
        "source", F.when(F.col("id") % 36 == 6, "world-history").when(F.col("id") % 5 == 0, "china-history").otherwise("rome-history"))
    o = F.col("ordinal")
    lanes = v.ring_vertices(spark, sf).select(*RING).distinct().withColumn("era_sources", F.concat(
        F.when(o % 2 == 0, F.array(F.lit("rome-history"))).otherwise(F.array().cast("array<string>")),
        F.when(o % 3 == 0, F.array(F.lit("china-history"))).otherwise(F.array().cast("array<string>"))))
    return L.assign_eras(era, lanes).select("id", "source", "laneset_id", "lane")


@query("laneset_nested", """
SELECT laneset_id, count(*) AS n_lanes, string_agg(slug, ',' ORDER BY ordinal) AS lanes, min(x0) AS west, max(y1) AS north FROM (
 SELECT laneset_id, ordinal, slug, CAST(min(lng) AS DOUBLE) x0, CAST(max(lat) AS DOUBLE) y1 FROM v_shape GROUP BY ALL) GROUP BY laneset_id""", ("v_shape",))
def laneset_nested(spark, sf):
    p = shapes(spark, sf).withColumn("bbox", sp.bbox(F.array("rings"))).withColumn("era_sources", F.array(F.lit("rome-history")))
    sets = v.table(spark, sf, "customer").select(F.col("c_nationkey").alias("laneset_id")).distinct()
    n = L.nested_lanes(sets, p)
    return n.select("laneset_id", F.size("lanes").cast("long").alias("n_lanes"), F.array_join(F.col("lanes.slug"), ",").alias("lanes"),
                    F.array_min(F.transform("lanes", lambda x: F.get(x["bbox"], F.lit(0)))).alias("west"),
                    F.array_max(F.transform("lanes", lambda x: F.get(x["bbox"], F.lit(3)))).alias("north"))


@query("laneset_list", """
SELECT laneset_id, slug, last_updated FROM (SELECT r_regionkey AS laneset_id, lower(r_name) AS slug, (SELECT max(o_orderdate) FROM orders WHERE o_orderkey%5=r_regionkey) AS last_updated FROM region) ORDER BY slug""")
def laneset_list(spark, sf):
    o = v.table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 5).cast("int").alias("r_regionkey")).agg(F.max("o_orderdate").alias("last_updated"))
    r = v.table(spark, sf, "region").join(o, "r_regionkey")
    return L.laneset_list(r.select(F.col("r_regionkey").alias("laneset_id"), F.lower("r_name").alias("slug"), "last_updated"))


@query("active_laneset", """
SELECT 'set-17' AS asked, CAST(17 AS BIGINT) AS laneset_id, 'set-17' AS slug UNION ALL SELECT 'set-none', min(c_custkey), concat('set-',CAST(min(c_custkey) AS STRING)) FROM customer""")
def active_laneset(spark, sf):
    """The asked-for laneset, or the first one when there is none of that name."""
    i = F.col("c_custkey")
    sets = v.table(spark, sf, "customer").select(i.alias("laneset_id"), F.concat(F.lit("set-"), i.cast("string")).alias("slug"), i.alias("ordinal"))
    return L.active_laneset(sets, "set-17").withColumn("asked", F.lit("set-17")).unionByName(
        L.active_laneset(sets, "set-none").withColumn("asked", F.lit("set-none")))


@query("lanes_from_countries", """
SELECT laneset_id, concat('nation-',CAST(laneset_id AS STRING)) AS slug, count(*) AS n_polygons, min(x0) AS lng_min, min(y0) AS lat_min, max(x1) AS lng_max, max(y1) AS lat_max, min_by(x1, ordinal) AS first_polygon_east
FROM (SELECT ordinal, laneset_id, CAST(min(lng) AS DOUBLE) x0, CAST(min(lat) AS DOUBLE) y0, CAST(max(lng) AS DOUBLE) x1, CAST(max(lat) AS DOUBLE) y1 FROM v_shape GROUP BY ALL) GROUP BY laneset_id""", ("v_shape",))
def lanes_from_countries(spark, sf):
    """Polygons gathered into lanes by a membership table, in source order."""
    countries = shapes(spark, sf).select(F.col("ordinal").alias("source_order"), F.col("laneset_id").cast("string").alias("continent"),
                                         F.lit("none").alias("subregion"), F.array("rings").alias("polygons"))
    k = F.col("n_nationkey")
    member = v.table(spark, sf, "nation").select(k.alias("laneset_id"), F.lit(0).alias("ordinal"), F.concat(F.lit("nation-"), k.cast("string")).alias("slug"),
                                                 F.lit("continent").alias("key_kind"), k.cast("string").alias("key_value"))
    g = L.group_into_lanes(countries, member)
    east = sp.bbox(F.slice("polygons", 1, 1))["lng_max"]
    return g.select("laneset_id", "slug", F.size("polygons").cast("long").alias("n_polygons"), "bbox.*", east.alias("first_polygon_east"))


@query("geometry_bbox", """
SELECT slug, CAST(min(lng) AS DOUBLE) AS lng_min, CAST(min(lat) AS DOUBLE) AS lat_min, CAST(max(lng) AS DOUBLE) AS lng_max, CAST(max(lat) AS DOUBLE) AS lat_max FROM v_shape GROUP BY slug""", ("v_shape",))
def geometry_bbox(spark, sf):
    return shapes(spark, sf).select("slug", sp.bbox(F.array("rings")).alias("b")).select("slug", "b.*")


@query("representative_point", """
WITH b AS (SELECT slug, (min(lat)+max(lat))/2.0 AS lat FROM v_shape GROUP BY slug),
x AS (SELECT e.slug, b.lat, (x1-x2)*(b.lat-y2)/(y1-y2)+x2 AS x, row_number() OVER (PARTITION BY e.slug ORDER BY (x1-x2)*(b.lat-y2)/(y1-y2)+x2) AS i
 FROM v_shape_edge e JOIN b ON b.slug=e.slug WHERE (y1>b.lat) <> (y2>b.lat)),
s AS (SELECT a.slug, a.lat, c.x-a.x AS width, (a.x+c.x)/2 AS mid FROM x a JOIN x c ON c.slug=a.slug AND c.i=a.i+1 AND a.i%2=1)
SELECT slug, CAST(lat AS DOUBLE) AS lat, round(max_by(mid, width),6) AS lng FROM s GROUP BY slug, lat""", ("v_shape", "v_shape_edge"))
def representative_point(spark, sf):
    """A point that is certainly inside each polygon."""
    p = shapes(spark, sf).select("slug", sp.filter_point(F.lit("polygon"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.array("rings")).alias("p"))
    return p.select("slug", F.col("p.lat").alias("lat"), F.round("p.lng", 6).alias("lng"))


@query("primary_points", """
SELECT l.entry_id, CASE WHEN l.entry_id%3=0 THEN CAST(r.lng AS DOUBLE) ELSE l.lng END AS layout_lng, CASE WHEN l.entry_id%3=1 THEN NULL WHEN l.entry_id%3=0 THEN CAST(r.lng+36 AS DOUBLE) ELSE l.lng END AS filter_lng
FROM v_locations l JOIN v_ring r ON r.vtx=0 AND r.lane_id=l.entry_id%25 WHERE l.ordinal=0""", ("v_locations", "v_ring"))
def primary_points(spark, sf):
    """Lane point and filter point differ: a polygon's first vertex against a
    point inside, and a path has only the former."""
    p = v.primary_points(spark, sf).withColumn("lane_id", (F.col("entry_id") % 25).cast("int"))
    kind = F.when(F.col("entry_id") % 3 == 0, "polygon").when(F.col("entry_id") % 3 == 1, "path").otherwise("point")
    r = polygons(spark, sf).select(F.col("ordinal").alias("lane_id"), sp.rectangle(
        sp.bbox(F.array("rings"))["lng_min"], sp.bbox(F.array("rings"))["lat_min"],
        sp.bbox(F.array("rings"))["lng_min"] + 72, sp.bbox(F.array("rings"))["lat_min"] + 30).alias("rings"))
    df = p.join(r, "lane_id")
    ways = F.array(F.struct("lng", "lat"))
    lng, lat, poly = F.col("lng"), F.col("lat"), F.array("rings")
    return df.select("entry_id", sp.layout_point(kind, lng, lat, poly, ways)["lng"].alias("layout_lng"),
                     sp.filter_point(kind, lng, lat, poly)["lng"].alias("filter_lng"))


@query("polyline_length", """
SELECT entry_id, count(*) AS n_points, round(coalesce(sum(2*6371*asin(sqrt(pow(sin(radians(lat-plat)/2),2)+cos(radians(plat))*cos(radians(lat))*pow(sin(radians(lng-plng)/2),2)))),0),4) AS length_km
FROM (SELECT *, lag(lat) OVER (PARTITION BY entry_id ORDER BY ordinal) plat, lag(lng) OVER (PARTITION BY entry_id ORDER BY ordinal) plng FROM v_locations) GROUP BY entry_id""", ("v_locations",))
def polyline_length(spark, sf):
    """Great-circle length of each entry's locations taken as a line."""
    return sp.vertex_row_lengths(v.locations(spark, sf), "entry_id", "ordinal").withColumn("length_km", F.round("length_km", 4))


@query("ring_clean", """
SELECT slug, vtx, floor((lng+lat/7.0)*100+0.5)/100 AS lng, floor((lat-lng/7.0)*100+0.5)/100 AS lat FROM v_shape""", ("v_shape",))
def ring_clean(spark, sf):
    """Rounded to two places, halves up; the last vertex is put back by closing."""
    vtx = v.shape_vertices(spark, sf).filter("vtx < 5").select(*RING, "vtx", (F.col("lng") + F.col("lat") / 7.0).alias("lng"), (F.col("lat") - F.col("lng") / 7.0).alias("lat"))
    r = sp.rings_from_vertices(vtx, RING, "vtx").select("slug", sp.clean_ring(F.get("rings", F.lit(0))).alias("ring"))
    return r.select("slug", F.posexplode("ring").alias("vtx", "p")).select("slug", "vtx", "p.lng", "p.lat")


@query("ring_simplify", """
SELECT slug, vtx, CAST(lng AS DOUBLE) AS lng, CAST(lat AS DOUBLE) AS lat FROM v_shape WHERE vtx<5
UNION ALL SELECT a.slug, 5, a.lng+(b.lng-a.lng)*3/4.0+0.1, a.lat+(b.lat-a.lat)*3/4.0 FROM v_shape a JOIN v_shape b ON b.slug=a.slug AND a.vtx=4 AND b.vtx=5""", ("v_shape",))
def ring_simplify(spark, sf):
    """Rings with three extra points near each edge; the pass drops them again."""
    x = v.shape_vertices(spark, sf)
    w = W.partitionBy("slug").orderBy("vtx")
    x = x.withColumns({"nx": F.lead("lng").over(w), "ny": F.lead("lat").over(w)}).filter("nx IS NOT NULL")
    steps = F.explode(F.array(*[F.lit(i) for i in range(4)]))
    x = x.withColumn("k", steps).select(*RING, (F.col("vtx") * 4 + F.col("k")).alias("vtx"),
                                        (F.col("lng") + (F.col("nx") - F.col("lng")) * F.col("k") / 4 + F.when(F.col("k") == 0, 0.0).otherwise(0.1)).alias("lng"),
                                        (F.col("lat") + (F.col("ny") - F.col("lat")) * F.col("k") / 4).alias("lat"))
    r = sp.rings_from_vertices(x, RING, "vtx").select("slug", F.get("rings", F.lit(0)).alias("ring"))
    return sp.simplify_rings(r, "ring", 0.4).select("slug", F.posexplode("ring").alias("vtx", "p")).select("slug", "vtx", "p.lng", "p.lat")


@query("rectangle_lanes", """
SELECT c_custkey, k AS vtx, CAST(CASE WHEN k IN (0,3,4) THEN c_custkey%50*7-180 ELSE c_custkey%50*7-173 END AS DOUBLE) AS lng, CAST(CASE WHEN k IN (0,1,4) THEN c_custkey%50*3-90 ELSE c_custkey%50*3-80 END AS DOUBLE) AS lat
FROM customer JOIN (SELECT unnest([0,1,2,3,4]) AS k) ON true""")
def rectangle_lanes(spark, sf):
    n = F.col("c_custkey") % 50
    r = v.table(spark, sf, "customer").select("c_custkey", sp.rectangle(n * 7 - 180, n * 3 - 90, n * 7 - 173, n * 3 - 80).alias("rings"))
    return r.select("c_custkey", F.posexplode(F.get("rings", F.lit(0))).alias("vtx", "p")).select("c_custkey", "vtx", "p.lng", "p.lat")


@query("circle_extent", "SELECT s_suppkey, round((s_suppkey*3.5)/111,6) AS degrees FROM supplier")
def circle_extent(spark, sf):
    return v.table(spark, sf, "supplier").select("s_suppkey", F.round(sp.circle_degrees(F.col("s_suppkey") * F.lit(3.5)), 6).alias("degrees"))
