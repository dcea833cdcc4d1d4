"""The given tables in the shapes the operators work on.

Each view exists twice: as a DataFrame for the Spark queries and as SQL text
for the check tool.  All are integer arithmetic on whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chronofold.operators.scans import ordinals
from chronofold.runtime import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, dealt out over the cores for work that is heavy per text."""
    return spread(table(spark, sf_dir, "documents"))


def _pick(c: Column, names: list[str], last: str) -> Column:
    out = None
    for i, n in enumerate(names):
        out = F.when(c == i, n) if out is None else out.when(c == i, n)
    return out.otherwise(last)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    year = ((F.col("o_orderkey") * 7919) % 5000).cast("int") - 3000
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("slug"),
        F.concat("c_name", F.lit(" "), "c_mktsegment").alias("title"),
        year.alias("start_year"),
        (year + (F.col("o_custkey") % 120).cast("int")).alias("end_year"),
        _pick(F.col("o_orderkey") % 9,
              ["person", "event", "place", "artifact", "pol_mil_organization",
               "business", "historical_period", "concepts"], "other").alias("category"),
        F.concat("o_orderpriority", F.lit(" "), "o_orderstatus").alias("description"),
        F.when(F.col("o_orderkey") % 18 == 6, "rome-history")
        .when(F.col("o_orderkey") % 18 == 15, "no-coords-found").otherwise("").alias("tag"),
        F.col("o_orderdate").alias("last_updated"),
    )


def entries_with_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).withColumn(
        "tags", F.when(F.col("tag") == "", F.array().cast("array<string>"))
        .otherwise(F.array("tag")))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as points; those of every thirteenth order belong to no entry, so some entries have none."""
    k = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        F.when(k % 13 != 0, k).otherwise(-k - 1).alias("entry_id"), "l_linenumber", "l_partkey", "l_suppkey",
        (((F.col("l_partkey") * 104729 + F.col("l_orderkey") * 31) % 36001).cast("int")
         / F.lit(100.0) - 180).alias("lng"),
        (((F.col("l_suppkey") * 7907 + F.col("l_orderkey") * 17) % 18001).cast("int")
         / F.lit(100.0) - 90).alias("lat"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, lng, lat) of all locations, for work that does not ask for their place in the list."""
    listed = F.col("entry_id").isNotNull() & F.col("l_linenumber").isNotNull() & F.col("l_partkey").isNotNull()
    return _points(spark, sf_dir).filter(listed).select("entry_id", "lng", "lat")


def locations(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """Point locations with their place in the entry's list, of the given entries only if asked for."""
    points = _points(spark, sf_dir)
    points = points if ids is None else points.join(ids, "entry_id", "left_semi")
    chunk = F.col("l_linenumber").cast("long") * 1_000_000_000 + F.floor(F.col("l_partkey") / 4096)
    out = ordinals(points, ["entry_id"], chunk,
                   ["l_linenumber", "l_partkey", "l_suppkey"])
    return out.select("entry_id", F.col("ordinal").cast("int").alias("ordinal"),
                      F.lit("point").alias("kind"), "lng", "lat")


def primary_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first location of each entry, by a partial aggregate."""
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "lng", "lat"))
    return (_points(spark, sf_dir).groupBy("entry_id").agg(first.alias("p"))
            .select("entry_id", F.lit(0).alias("ordinal"), F.lit("point").alias("kind"),
                    F.col("p.lng").alias("lng"), F.col("p.lat").alias("lat")))


def ring_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 concave closed rings, five per laneset, as vertex rows."""
    n = table(spark, sf_dir, "nation")
    corner = F.array(*[F.struct(F.lit(k).alias("vtx"), F.lit(x).alias("dx"), F.lit(y).alias("dy"))
                       for k, (x, y) in enumerate([(0, 0), (80, 0), (40, 20), (80, 40), (0, 40), (0, 0)])])
    return n.withColumn("c", F.explode(corner)).select(
        F.col("n_nationkey").alias("lane_id"),
        F.concat(F.lit("lane-"), F.col("n_nationkey").cast("string")).alias("slug"),
        F.col("n_regionkey").alias("laneset_id"),
        F.col("n_nationkey").alias("ordinal"),
        F.col("c.vtx").alias("vtx"),
        (F.col("n_nationkey") % 5 * 72 - 180 + F.col("c.dx")).alias("lng"),
        (F.floor(F.col("n_nationkey") / 5).cast("int") * 36 - 90 + F.col("c.dy")).alias("lat"),
    )


def shape_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ring in seven sizes, one per customer, as vertex rows."""
    corner = F.array(*[F.struct(F.lit(k).alias("vtx"), F.lit(x).alias("dx"), F.lit(y).alias("dy"))
                       for k, (x, y) in enumerate([(0, 0), (80, 0), (40, 20), (80, 40), (0, 40), (0, 0)])])
    i = F.col("c_custkey")
    size = (1 + i % 7) / F.lit(8.0)
    return table(spark, sf_dir, "customer").withColumn("c", F.explode(corner)).select(
        F.col("c_nationkey").alias("laneset_id"), i.alias("ordinal"), F.concat(F.lit("shape-"), i.cast("string")).alias("slug"),
        F.col("c.vtx").alias("vtx"), (i % 5 * 50 - 180 + F.col("c.dx") * size).alias("lng"), (i % 4 * 30 - 90 + F.col("c.dy") * size).alias("lat"))


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = texts(spark, sf_dir), F.col("doc_id")

    def s(c):
        return c.cast("string")

    kind = _pick(i % 6, ["person", "military conflict", "settlement", "Ship begin", "officeholder"], "album")
    field = _pick(i % 6, ["birth_date", "date", "founded", "launched", "birth_date"], "released")
    date = (F.when(i % 5 == 0, F.concat(F.lit("{{birth date|"), s(1500 + i % 400), F.lit("|"),
                                        s(1 + i % 12), F.lit("|"), s(1 + i % 28), F.lit("}}")))
            .when(i % 5 == 1, F.concat(F.lit("c. "), s(100 + i % 900), F.lit(" BC")))
            .when(i % 5 == 2, F.concat(s(1000 + i % 300), F.lit("-"), s(1400 + i % 300)))
            .when(i % 5 == 3, F.concat(s(1 + i % 28), F.lit(" May "), s(1600 + i % 300)))
            .otherwise(F.concat(s(4 + i % 16), F.lit("th century BC"))))
    coord = F.when(i % 3 == 0, "").otherwise(F.concat(
        F.lit("\n| coordinates = {{coord|"), s(i % 90), F.lit("|"), s(i % 60),
        F.when(i % 2 == 0, "|N|").otherwise("|S|"), s(i % 180), F.lit("|30|E|display=title}}")))
    return d.select(
        i.alias("page_id"), F.concat(F.lit("Doc "), s(i)).alias("title"),
        F.concat(F.lit("{{Infobox "), kind, F.lit("\n| "), field, F.lit(" = "), date, coord,
                 F.lit("\n}}\n"), "text").alias("wikitext"))


def type_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_partkey > 1").select(
        F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).alias("parent"))


def type_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_partkey > 0").select(
        F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("type_id"))


def waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered month/year fragments with gaps, one path per user."""
    e = table(spark, sf_dir, "events")
    day = F.unix_seconds(F.col("ts").cast("timestamp")) / 86400
    out = ordinals(e.select("event_id", "ts", "user_id"), ["user_id"], F.floor(day),
                   ["ts", "event_id"], "pos", 1)
    i = F.col("event_id")
    return out.select(
        F.col("user_id").alias("path_id"), F.col("pos").cast("int").alias("pos"), "event_id",
        F.when(i % 4 != 0, F.floor(i / 3).cast("int") % 12 + 1).alias("stated_month"),
        F.when(i % 11 == 0, 1800 + (i % 50).cast("int")).alias("stated_year"))


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot that lacks a third of the entries; a fifth is out of date."""
    return entries(spark, sf_dir).filter("id % 3 <> 0").withColumn(
        "last_updated", F.when(F.col("id") % 5 == 0, F.col("last_updated") - F.expr("INTERVAL '1' DAY"))
        .otherwise(F.col("last_updated")))


def query_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved query per supplier, with two year ranges and one category."""
    k = (F.col("s_suppkey") % 25).cast("int")

    def part(seq, kind, value, lo, hi):
        return F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"),
                        value.cast("string").alias("str_value"),
                        lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))

    null = F.lit(None)
    parts = F.array(
        part(1, "year", null, k * 100 - 3000, k * 100 - 2000),
        part(2, "year", null, k * 100 - 2800, k * 100 - 1500),
        part(3, "category", F.when(k % 2 == 0, "person").otherwise("event"), null, null))
    return (table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.explode(parts).alias("f"))
            .select("query_id", "f.*"))


SQL_VIEWS = {
    "v_entries": """
SELECT o_orderkey AS id, concat('o-',CAST(o_orderkey AS STRING)) AS slug, concat(c_name,' ',c_mktsegment) AS title,
 CAST((o_orderkey*7919)%5000 AS INT)-3000 AS start_year, CAST((o_orderkey*7919)%5000 AS INT)-3000+CAST(o_custkey%120 AS INT) AS end_year,
 CASE CAST(o_orderkey%9 AS INT) WHEN 0 THEN 'person' WHEN 1 THEN 'event' WHEN 2 THEN 'place' WHEN 3 THEN 'artifact' WHEN 4 THEN 'pol_mil_organization'
  WHEN 5 THEN 'business' WHEN 6 THEN 'historical_period' WHEN 7 THEN 'concepts' ELSE 'other' END AS category,
 concat(o_orderpriority,' ',o_orderstatus) AS description,
 CASE CAST(o_orderkey%18 AS INT) WHEN 6 THEN 'rome-history' WHEN 15 THEN 'no-coords-found' ELSE '' END AS tag,
 o_orderdate AS last_updated FROM orders JOIN customer ON o_custkey=c_custkey""",
    "v_locations": """
SELECT CASE WHEN l_orderkey%13<>0 THEN l_orderkey ELSE -l_orderkey-1 END AS entry_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey)-1 AS INT) AS ordinal, 'point' AS kind,
 CAST((l_partkey*104729+l_orderkey*31)%36001 AS INT)/100.0-180 AS lng, CAST((l_suppkey*7907+l_orderkey*17)%18001 AS INT)/100.0-90 AS lat
 FROM lineitem""",
    "v_ring": """
SELECT n_nationkey AS lane_id, concat('lane-',CAST(n_nationkey AS STRING)) AS slug, n_regionkey AS laneset_id, n_nationkey AS ordinal, k AS vtx,
 n_nationkey%5*72-180+CASE k WHEN 0 THEN 0 WHEN 1 THEN 80 WHEN 2 THEN 40 WHEN 3 THEN 80 WHEN 4 THEN 0 ELSE 0 END AS lng,
 CAST(floor(n_nationkey/5) AS INT)*36-90+CASE k WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 20 WHEN 3 THEN 40 WHEN 4 THEN 40 ELSE 0 END AS lat
 FROM nation CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) s""",
    "v_edge": """
SELECT a.lane_id, a.slug, a.laneset_id, a.ordinal, CAST(a.lng AS DOUBLE) x1, CAST(a.lat AS DOUBLE) y1, CAST(b.lng AS DOUBLE) x2, CAST(b.lat AS DOUBLE) y2
 FROM v_ring a JOIN v_ring b ON a.lane_id=b.lane_id AND b.vtx=a.vtx+1""",
    "v_hit": """
SELECT p.entry_id, e.lane_id, e.slug, e.laneset_id, e.ordinal FROM v_locations p
 JOIN v_edge e ON ((y1>p.lat) <> (y2>p.lat)) AND p.lng < (x1-x2)*(p.lat-y2)/(y1-y2)+x2
 WHERE p.ordinal=0 GROUP BY p.entry_id, e.lane_id, e.slug, e.laneset_id, e.ordinal HAVING count(*)%2=1""",
    "v_wikitext": """
SELECT doc_id AS page_id, concat('Doc ',CAST(doc_id AS STRING)) AS title,
 concat('{{Infobox ',CASE CAST(doc_id%6 AS INT) WHEN 0 THEN 'person' WHEN 1 THEN 'military conflict' WHEN 2 THEN 'settlement' WHEN 3 THEN 'Ship begin' WHEN 4 THEN 'officeholder' ELSE 'album' END,
 chr(10),'| ',CASE CAST(doc_id%6 AS INT) WHEN 0 THEN 'birth_date' WHEN 1 THEN 'date' WHEN 2 THEN 'founded' WHEN 3 THEN 'launched' WHEN 4 THEN 'birth_date' ELSE 'released' END,' = ',
 CASE CAST(doc_id%5 AS INT) WHEN 0 THEN concat('{{birth date|',CAST(1500+doc_id%400 AS STRING),'|',CAST(1+doc_id%12 AS STRING),'|',CAST(1+doc_id%28 AS STRING),'}}')
  WHEN 1 THEN concat('c. ',CAST(100+doc_id%900 AS STRING),' BC') WHEN 2 THEN concat(CAST(1000+doc_id%300 AS STRING),'-',CAST(1400+doc_id%300 AS STRING))
  WHEN 3 THEN concat(CAST(1+doc_id%28 AS STRING),' May ',CAST(1600+doc_id%300 AS STRING)) ELSE concat(CAST(4+doc_id%16 AS STRING),'th century BC') END,
 CASE WHEN doc_id%3=0 THEN '' ELSE concat(chr(10),'| coordinates = {{coord|',CAST(doc_id%90 AS STRING),'|',CAST(doc_id%60 AS STRING),CASE WHEN doc_id%2=0 THEN '|N|' ELSE '|S|' END,CAST(doc_id%180 AS STRING),'|30|E|display=title}}') END,
 chr(10),'}}',chr(10), text) AS wikitext FROM documents""",
    "v_type_edges": """
SELECT CAST(p_partkey AS BIGINT) AS child, CAST(floor(p_partkey/2) AS BIGINT) AS parent FROM part WHERE p_partkey>1""",
    "v_claims_type": """
SELECT l_orderkey AS item, l_partkey AS type_id FROM lineitem WHERE l_partkey>0""",
    "v_waypoints": """
SELECT user_id AS path_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id) AS INT) AS pos, event_id,
 CASE WHEN event_id%4=0 THEN NULL ELSE CAST(floor(event_id/3) AS INT)%12+1 END AS stated_month, CASE WHEN event_id%11=0 THEN 1800+CAST(event_id%50 AS INT) END AS stated_year FROM events""",
    "v_cache": """
SELECT id, title, last_updated - CASE WHEN id%5=0 THEN INTERVAL '1' DAY ELSE INTERVAL '0' DAY END AS last_updated FROM v_entries WHERE id%3<>0""",
    "v_shape": """
SELECT c_nationkey AS laneset_id, c_custkey AS ordinal, concat('shape-',CAST(c_custkey AS STRING)) AS slug, k AS vtx,
 c_custkey%5*50-180+CASE k WHEN 1 THEN 80 WHEN 2 THEN 40 WHEN 3 THEN 80 ELSE 0 END*(1+c_custkey%7)/8.0 AS lng, c_custkey%4*30-90+CASE k WHEN 2 THEN 20 WHEN 3 THEN 40 WHEN 4 THEN 40 ELSE 0 END*(1+c_custkey%7)/8.0 AS lat
 FROM customer JOIN (SELECT unnest([0,1,2,3,4,5]) AS k) ON true""",
    "v_shape_edge": """
SELECT a.slug, CAST(a.lng AS DOUBLE) x1, CAST(a.lat AS DOUBLE) y1, CAST(b.lng AS DOUBLE) x2, CAST(b.lat AS DOUBLE) y2 FROM v_shape a JOIN v_shape b ON a.slug=b.slug AND b.vtx=a.vtx+1""",
    "v_query_spec": """
SELECT s_suppkey AS query_id, 1 AS seq, 'year' AS kind, CAST(NULL AS STRING) AS str_value, s_suppkey%25*100-3000 AS lo, s_suppkey%25*100-2000 AS hi FROM supplier
 UNION ALL SELECT s_suppkey,2,'year',NULL,s_suppkey%25*100-2800,s_suppkey%25*100-1500 FROM supplier
 UNION ALL SELECT s_suppkey,3,'category',CASE WHEN s_suppkey%25%2=0 THEN 'person' ELSE 'event' END,NULL,NULL FROM supplier""",
}
