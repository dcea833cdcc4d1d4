"""Queries over tables of facts."""

from pyspark.sql import functions as F

from chronofold.functions import coords, dates
from chronofold.functions.years import whole_year
from chronofold.operators import facts as K
from chronofold.plans import fixtures as v
from chronofold.plans.registry import query
from chronofold.runtime import broadcast_if_small, cut


def q(c):
    return F.concat(F.lit("Q"), c.cast("string"))


CLOSURE = """
WITH RECURSIVE c AS (SELECT CAST(r AS BIGINT) AS root, CAST(r AS BIGINT) AS type FROM (SELECT unnest([1,3,10]) AS r) UNION SELECT c.root, e.child FROM c JOIN v_type_edges e ON e.parent=c.type)"""


@query("type_closure", CLOSURE + " SELECT root, type FROM c", ("v_type_edges",))
def type_closure(spark, sf):
    """Every type under three roots, the roots themselves included."""
    roots = v.table(spark, sf, "part").select(F.col("p_partkey").alias("root")).filter(F.col("root").isin(1, 3, 10))
    return K.descendants(v.type_edges(spark, sf), roots)


@query("type_match", CLOSURE + """
 SELECT DISTINCT item, 'under' AS how FROM v_claims_type t JOIN c ON c.root=10 AND c.type=t.type_id UNION ALL SELECT DISTINCT item, 'exact' FROM v_claims_type WHERE type_id=10""",
       ("v_type_edges", "v_claims_type"))
def type_match(spark, sf):
    t = v.type_claims(spark, sf)
    roots = v.table(spark, sf, "part").select(F.col("p_partkey").alias("root")).filter("root = 10")
    closure = K.descendants(v.type_edges(spark, sf), roots)
    return K.of_type(t, 10, closure).withColumn("how", F.lit("under")).unionByName(K.of_type(t, 10).withColumn("how", F.lit("exact")))


@query("exclude_under_type", CLOSURE + """
 SELECT id FROM v_entries WHERE id NOT IN (SELECT item FROM v_claims_type t JOIN c ON c.root=3 AND c.type=t.type_id)""", ("v_entries", "v_type_edges", "v_claims_type"))
def exclude_under_type(spark, sf):
    roots = v.table(spark, sf, "part").select(F.col("p_partkey").alias("root")).filter("root = 3")
    gone = K.of_type(v.type_claims(spark, sf), 3, K.descendants(v.type_edges(spark, sf), roots))
    return K.without(v.entries(spark, sf).select(F.col("id").alias("item")), gone).select(F.col("item").alias("id"))


@query("exclude_direct_types", """
SELECT id FROM v_entries WHERE id NOT IN (SELECT item FROM v_claims_type WHERE type_id IN (12,14,100,150))""", ("v_entries", "v_claims_type"))
def exclude_direct_types(spark, sf):
    e = v.entries(spark, sf).select(F.col("id").alias("item"))
    return K.without_types(e, v.type_claims(spark, sf), [12, 14, 100, 150]).select(F.col("item").alias("id"))


@query("required_language", """
SELECT e.id, CASE WHEN id%4<>0 THEN title END AS label FROM v_entries e""", ("v_entries",))
def required_language(spark, sf):
    e = v.entries(spark, sf)
    texts = e.select(F.col("id").alias("item"), F.when(F.col("id") % 4 != 0, "en").otherwise("fr").alias("lang"), F.col("title").alias("text"))
    return e.select(F.col("id").alias("item")).join(K.in_language(texts), "item", "left").select(F.col("item").alias("id"), F.col("text").alias("label"))


@query("fact_times", """
SELECT o_orderkey, CAST(o_orderkey%6000 AS INT)-3000 AS year, CASE WHEN o_orderkey%9+3>=10 THEN 5 ELSE 0 END AS month, CASE WHEN o_orderkey%9+3>=11 THEN 17 ELSE 0 END AS day,
 CASE o_orderkey%9+3 WHEN 3 THEN 500000 WHEN 4 THEN 50000 WHEN 5 THEN 5000 WHEN 6 THEN 500 WHEN 7 THEN 50 WHEN 8 THEN 5 ELSE 0 END AS uncertainty_years FROM orders""")
def fact_times(spark, sf):
    i = F.col("o_orderkey")
    y = (i % 6000).cast("int") - 3000
    t = F.concat(F.when(y < 0, "-").otherwise(""), F.lpad(F.abs(y).cast("string"), 4, "0"), F.lit("-05-17T00:00:00Z"))
    return v.table(spark, sf, "orders").select("o_orderkey", dates.fact_time(t, (i % 9 + 3).cast("int")).alias("t")).select("o_orderkey", "t.*")


@query("wkt_points", """
SELECT entry_id, ordinal, CASE WHEN ordinal<>2 THEN round(lng,2) END AS lng, CASE WHEN ordinal<>2 THEN round(lat,2) END AS lat FROM v_locations""", ("v_locations",))
def wkt_points(spark, sf):
    text = F.when(F.col("ordinal") == 2, "LINESTRING(1 2, 3 4)").otherwise(F.format_string("Point( %s  %s )", F.col("lng").cast("decimal(10,2)").cast("string"), F.col("lat").cast("decimal(10,2)").cast("string")))
    p = coords.wkt_point(text)
    return v.locations(spark, sf).select("entry_id", "ordinal", F.round(p["lng"], 2).alias("lng"), F.round(p["lat"], 2).alias("lat"))


@query("item_ids", """
SELECT id, CASE WHEN id%3<>0 THEN concat('Q',CAST(id AS STRING)) END AS item FROM v_entries""", ("v_entries",))
def item_ids(spark, sf):
    iri = F.concat(F.lit("http://www.wikidata.org/entity/"), F.when(F.col("id") % 3 == 0, "P").otherwise("Q"), F.col("id").cast("string"))
    return v.entries(spark, sf).select("id", K.item_id(iri).alias("item"))


@query("whole_year_bounds", """
SELECT p_partkey, CAST(trunc((p_partkey*13-9000)/10.0) AS INT) AS year FROM part""")
def whole_year_bounds(spark, sf):
    return v.table(spark, sf, "part").select("p_partkey", whole_year((F.col("p_partkey") * 13 - 9000) / F.lit(10.0)).alias("year"))


@query("merge_by_id", """
SELECT id, min_by(title, seq) AS title, count(DISTINCT (lat, lng)) FILTER (lat IS NOT NULL) AS n_points, min_by(lat, seq) FILTER (lat IS NOT NULL) AS first_lat FROM (
 SELECT entry_id%997 AS id, entry_id*10+ordinal AS seq, concat('t',CAST(entry_id AS STRING)) AS title, CASE WHEN ordinal%4<>3 THEN round(lat/10)*10+0 END AS lat, CASE WHEN ordinal%4<>3 THEN round(lng/10)*10+0 END AS lng FROM v_locations) GROUP BY id""", ("v_locations",))
def merge_by_id(spark, sf):
    """Rows with one id become one row: first values, all different points."""
    has = F.col("ordinal") % 4 != 3
    tens = lambda c: F.when(F.col(c) >= 0, F.floor(F.col(c) / 10 + 0.5)).otherwise(-F.floor(-F.col(c) / 10 + 0.5)).cast("double") * 10
    rows = v.locations(spark, sf).select(
        (F.col("entry_id") % 997).alias("id"), (F.col("entry_id") * 10 + F.col("ordinal")).alias("seq"),
        F.concat(F.lit("t"), F.col("entry_id").cast("string")).alias("title"),
        F.when(has, F.struct(tens("lat").alias("lat"), tens("lng").alias("lng"))).alias("point"))
    m = K.merge_by_id(rows, ["seq"])
    return m.select("id", "title", F.size("locations").cast("long").alias("n_points"), F.get("locations", F.lit(0))["lat"].alias("first_lat"))


def claims(spark, sf):
    """Types, dates, places and exclusion marks of the entries as statements."""
    e = v.entries(spark, sf)
    i = F.col("id")
    s = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    li = v.table(spark, sf, "lineitem")

    def row(prop, item, value_item=none, value_time=none, precision=F.lit(None).cast("int"), value_point=none):
        return [item.alias("item"), F.lit(prop).alias("prop"), value_item.alias("value_item"), value_time.alias("value_time"),
                precision.alias("precision"), value_point.alias("value_point")]

    time = F.concat(F.when(F.col("start_year") < 0, "-").otherwise(""), F.lpad(s(F.abs("start_year")), 4, "0"), F.lit("-05-17T00:00:00Z"))
    precision = (i % 5 + 7).cast("int")
    two = lambda c: s(F.col(c).cast("decimal(10,2)"))
    return (li.select(*row("P31", q(F.col("l_orderkey")), q(F.col("l_partkey"))))
            .unionAll(e.filter("id % 2 = 0").select(*row("P569", q(i), value_time=time, precision=precision)))
            .unionAll(e.filter("id % 3 <> 0").select(*row("P585", q(i), value_time=time, precision=precision)))
            .unionAll(e.filter("id % 4 <> 1").select(*row("P19", q(i), q(i + 1))))
            .unionAll(e.filter("id % 7 = 0").select(*row("P641", q(i), q(F.lit(1)))))
            .unionAll(e.select(*row("P106", q(i), q(i % 500))))
            .unionAll(e.filter("id % 17 = 0").select(*row("P1074", q(i), q(F.lit(1)))))
            .unionAll(v.points(spark, sf).select(*row("P625", q(F.col("entry_id")), value_point=F.concat(
                F.lit("POINT("), two("lng"), F.lit(" "), two("lat"), F.lit(")"))))))


RULES = [K.CategoryRule("person", "Q7", "P569", place="P19"), K.CategoryRule("event", "Q3", "P585", transitive=True, place="direct")]
OUT = K.Exclusions(fictional_root="Q13", athlete_root="Q11", event_noise=("Q12", "Q24", "Q25"))


FACTS_SQL = """
WITH RECURSIVE c AS (SELECT CAST(r AS BIGINT) AS root, CAST(r AS BIGINT) AS type FROM (SELECT unnest([3,11,13]) AS r) UNION SELECT c.root, e.child FROM c JOIN v_type_edges e ON e.parent=c.type),
t AS (SELECT DISTINCT l_orderkey AS item, l_partkey AS type_id FROM lineitem),
b AS (SELECT item, 'person' AS category FROM t WHERE type_id=7 AND item%7<>0 AND item%500 NOT IN (SELECT type FROM c WHERE root=11)
 UNION SELECT item, 'event' FROM t JOIN c ON c.root=3 AND c.type=t.type_id WHERE item NOT IN (SELECT item FROM t WHERE type_id IN (12,24,25))),
d AS (SELECT b.item, b.category, e.* FROM b JOIN v_entries e ON e.id=b.item WHERE ((category_='person' AND id%2=0) OR (category_='event' AND id%3<>0)) AND start_year BETWEEN -1500 AND 1800
 AND item NOT IN (SELECT item FROM t JOIN c ON c.root=13 AND c.type=t.type_id) AND item%17<>0 AND item%5<>0),
p AS (SELECT d.*, l.lat, l.lng FROM d LEFT JOIN v_locations l ON CASE WHEN category_='person' THEN (CASE WHEN id%4<>1 THEN id+1 END) ELSE id END=l.entry_id)
SELECT concat('Q',CAST(id AS STRING)) AS id, min(CASE WHEN id%4<>0 THEN title ELSE concat('Q',CAST(id AS STRING)) END) AS title, min(category_) AS category, min(start_year) AS start_year,
 min(CASE WHEN id%5+7>=10 THEN 5 ELSE 0 END) AS start_month, min(CASE WHEN id%5+7>=11 THEN 17 ELSE 0 END) AS start_day, min(CASE id%5+7 WHEN 7 THEN 50 WHEN 8 THEN 5 ELSE 0 END) AS uncertainty_years,
 count(DISTINCT (round(lat,2),round(lng,2))) FILTER (lat IS NOT NULL) AS n_points, min(concat('page ',CAST(id AS STRING))) AS wikipedia_title,
 min(concat('https://www.wikidata.org/wiki/Q',CAST(id AS STRING))) AS citation_url, CASE WHEN min(category_)='event' THEN 'wikidata:Q3' ELSE 'wikidata:Q7' END AS infobox_type
FROM p WHERE {where} GROUP BY id {tail}""".replace("b.item, b.category, e.*", "b.item, b.category AS category_, e.*")


def searched(spark, sf, **asked):
    e = v.entries(spark, sf)
    i = F.col("id")
    item = q(i).alias("item")
    labels = e.select(item, F.when(i % 4 != 0, "en").otherwise("fr").alias("lang"), F.col("title").alias("text"))
    descs = e.select(item, F.lit("en").alias("lang"), F.col("description").alias("text"))
    articles = e.filter("id % 5 <> 0").select(item, F.concat(F.lit("page "), i.cast("string")).alias("title"))
    edges = v.type_edges(spark, sf).select(q(F.col("child")).alias("child"), q(F.col("parent")).alias("parent"))
    got = K.search(claims(spark, sf), edges, labels, descs, articles, -1500, 1800, rules=RULES, out=OUT, **asked)
    return got.select("id", "title", "category", "start_year", "start_month", "start_day", "uncertainty_years",
                      F.size("locations").cast("long").alias("n_points"), "wikipedia_title", "citation_url", "infobox_type")


@query("fact_search", FACTS_SQL.format(where="true", tail=""), ("v_entries", "v_type_edges", "v_locations"))
def fact_search(spark, sf):
    """The whole fact search: two category branches, dates, exclusions, articles,
    languages, places, merge."""
    return searched(spark, sf)


@query("fact_search_filtered", FACTS_SQL.format(
    where="(contains(lower(CASE WHEN id%4<>0 THEN title ELSE '' END),'ing') OR contains(lower(description),'ing')) AND round(lat,2) BETWEEN -70 AND 80 AND round(lng,2) BETWEEN -150 AND 120",
    tail="ORDER BY min(start_year), concat('Q',CAST(id AS STRING)) LIMIT 200"), ("v_entries", "v_type_edges", "v_locations"))
def fact_search_filtered(spark, sf):
    """The same with a text, a box and a limit: the earliest 200."""
    return searched(spark, sf, text="ING", box={"lat_min": -70.0, "lat_max": 80.0, "lng_min": -150.0, "lng_max": 120.0}, limit=200)


@query("category_union", """
WITH RECURSIVE c AS (SELECT CAST(3 AS BIGINT) AS type UNION SELECT e.child FROM c JOIN v_type_edges e ON e.parent=c.type)
SELECT DISTINCT item, 'person' AS category FROM v_claims_type WHERE type_id=7 UNION ALL SELECT DISTINCT item, 'event' FROM v_claims_type t JOIN c ON c.type=t.type_id""", ("v_type_edges", "v_claims_type"))
def category_union(spark, sf):
    """One branch per category, exact or with subclasses; an item may be in two."""
    types = v.type_claims(spark, sf).select("item", q(F.col("type_id")).alias("type_id"))
    edges = v.type_edges(spark, sf).select(q(F.col("child")).alias("child"), q(F.col("parent")).alias("parent"))
    closure = K.descendants(edges, v.table(spark, sf, "part").filter("p_partkey = 3").select(q(F.col("p_partkey")).alias("root")))
    return K.category_items(types, RULES, closure)


@query("optional_places", """
SELECT e.id, 'event' AS category, round(l.lat,2) AS lat, round(l.lng,2) AS lng FROM v_entries e LEFT JOIN v_locations l ON l.entry_id=e.id
UNION ALL SELECT e.id, 'person', round(l.lat,2), round(l.lng,2) FROM v_entries e LEFT JOIN v_locations l ON l.entry_id=e.id+1 AND e.id%4<>1
UNION ALL SELECT e.id, 'concepts', NULL, NULL FROM v_entries e""", ("v_entries", "v_locations"))
def optional_places(spark, sf):
    """A place on the item, on a linked item, or none; n places give n rows."""
    cats = F.explode(F.array(F.lit("event"), F.lit("person"), F.lit("concepts")))
    items = v.entries(spark, sf).select("id", q(F.col("id")).alias("item"), cats.alias("category"))
    rules = [*RULES, K.CategoryRule("concepts", "Q1", "P571")]
    df = K.with_places(items, claims(spark, sf), rules)
    return df.select("id", "category", F.round("point.lat", 2).alias("lat"), F.round("point.lng", 2).alias("lng"))


@query("required_article", """
SELECT id, concat('page ',CAST(id AS STRING)) AS article FROM v_entries WHERE id%5<>0""", ("v_entries",))
def required_article(spark, sf):
    e = v.entries(spark, sf)
    articles = e.filter("id % 5 <> 0").select("id", F.concat(F.lit("page "), F.col("id").cast("string")).alias("article"))
    return e.select("id").join(articles, "id")


@query("count_in_years", """
SELECT count(DISTINCT id%3001) AS n FROM v_entries WHERE start_year BETWEEN -1000 AND 1899""", ("v_entries",))
def count_in_years(spark, sf):
    d = v.entries(spark, sf).select((F.col("id") % 3001).alias("item"), F.col("start_year").alias("year"))
    return K.count_in_years(d, -1000, 1899)


@query("chunk_plan", """
WITH RECURSIVE d AS (SELECT DISTINCT id%3001 AS item, start_year AS year FROM v_entries WHERE start_year BETWEEN -3000 AND 2100),
p AS (SELECT year, prev, count(*) AS c FROM (SELECT year, lag(year) OVER (PARTITION BY item ORDER BY year) AS prev FROM d) GROUP BY ALL),
r AS (SELECT -3000 AS low, 2100 AS high, (SELECT CAST(sum(c) FILTER (prev IS NULL OR prev < -3000) AS BIGINT) FROM p) AS n
 UNION ALL SELECT k.low, k.high, (SELECT CAST(sum(c) FILTER (prev IS NULL OR prev<k.low) AS BIGINT) FROM p WHERE year BETWEEN k.low AND k.high) FROM
  (SELECT CASE WHEN s=0 THEN low ELSE CAST(floor((low+high)/2.0) AS INT)+1 END AS low, CASE WHEN s=0 THEN CAST(floor((low+high)/2.0) AS INT) ELSE high END AS high
   FROM r JOIN (SELECT unnest([0,1]) AS s) ON n>700 AND low<high) k)
SELECT low, high, n FROM r WHERE n>0 AND (n<=700 OR low>=high)""", ("v_entries",))
def chunk_plan(spark, sf):
    """Year ranges of at most 700 different items."""
    d = v.entries(spark, sf).select((F.col("id") % 3001).alias("item"), F.col("start_year").alias("year"))
    return K.plan_chunks(d, -3000, 2100, 700)


@query("chunk_plan_sketched", """
SELECT count(DISTINCT year) AS years, CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS too_large, CAST(0 AS BIGINT) AS far_off FROM (SELECT start_year AS year FROM v_entries WHERE start_year BETWEEN -3000 AND 2100)""", ("v_entries",))
def chunk_plan_sketched(spark, sf):
    """A plan by sketches, held against exact counts: every year in one chunk, no chunk much beyond 700 different items."""
    d = v.entries(spark, sf).select((F.col("id") % 3001).alias("item"), F.col("start_year").alias("year"))
    chunks = K.plan_chunks_sketched(d, -3000, 2100, 700)
    years = d.filter("year BETWEEN -3000 AND 2100").select("year").distinct()
    held = cut(years.join(F.broadcast(chunks), F.col("year").between(F.col("low"), F.col("high"))), "held")
    exact = d.join(broadcast_if_small(held), "year").groupBy("low", "high").agg(F.countDistinct("item").alias("items"), F.first("n").alias("n"))
    exact = exact.agg(F.count_if((F.col("items") > 770) & (F.col("low") < F.col("high"))).alias("too_large"),
                      F.count_if(F.abs(F.col("n") - F.col("items")) > 0.1 * F.col("items")).alias("far_off"))
    per_year = held.groupBy("year").agg(F.count("*").alias("c")).agg(F.count("*").alias("years"), F.count_if(F.col("c") > 1).alias("twice"))
    return per_year.crossJoin(exact).select("years", "twice", "too_large", "far_off")
