"""Queries over journeys and way networks."""

from pyspark.sql import functions as F

from chronofold.functions.years import long_date
from chronofold.operators import facts as K, filters as f, routes as J
from chronofold.plans import fixtures as v
from chronofold.plans.registry import query


@query("numbered_waypoints", """
SELECT path_id, n AS number, concat('place ',CAST(event_id AS STRING)) AS label, row_number() OVER (PARTITION BY path_id ORDER BY n, event_id)-1 AS seq FROM (
 SELECT user_id AS path_id, event_id, CAST(event_id%997 AS INT) AS n FROM events WHERE event_id%7<>0)""")
def numbered_waypoints(spark, sf):
    e = v.table(spark, sf, "events")
    i = F.col("event_id")
    name = F.when(i % 7 == 0, F.concat(F.lit("Book #"), i.cast("string"))).otherwise(
        F.concat(F.lit(" #"), (i % 997).cast("string"), F.lit(" = place "), i.cast("string"), F.lit(" ")))
    df = e.select(F.col("user_id").alias("path_id"), i.alias("pos"), name.alias("name"))
    return J.numbered_waypoints(df).select("path_id", "number", "label", "seq")


@query("date_fragments", """
SELECT event_id, CASE WHEN k=4 THEN NULL ELSE d END AS day, CASE WHEN k IN (0,1,2) THEN m END AS month, CASE WHEN k IN (0,1) THEN y END AS year FROM (
 SELECT event_id, CAST(event_id%5 AS INT) AS k, CAST(1+event_id%28 AS INT) AS d, CAST(1+event_id%12 AS INT) AS m, CAST(1800+event_id%90 AS INT) AS y FROM events)""")
def date_fragments(spark, sf):
    i = F.col("event_id")
    s = lambda c: c.cast("string")
    d, m, y = s(1 + i % 28), F.element_at(F.array(*[F.lit(x) for x in "JAN Feb. march April May june July aug Sept. oct November Dec".split()]), (1 + i % 12).cast("int")), s(1800 + i % 90)
    text = (F.when(i % 5 == 0, F.concat(F.lit("Page 74, the "), d, F.lit("th of "), m, F.lit(", "), y, F.lit(" we left")))
            .when(i % 5 == 1, F.concat(F.lit("On "), m, F.lit(" "), d, F.lit("th, "), y, F.lit(" the crew")))
            .when(i % 5 == 2, F.concat(m, F.lit(" "), d, F.lit(". -- calm")))
            .when(i % 5 == 3, F.concat(d, F.lit("th. -- The mayor came")))
            .otherwise("nothing is said of a day"))
    return v.table(spark, sf, "events").select("event_id", J.date_fragment(text).alias("g")).select("event_id", "g.*")


def stated(spark, sf):
    i = F.col("event_id")
    df = v.waypoints(spark, sf).withColumn("stated_day", (1 + i % 28).cast("int"))
    return df.withColumn("has_fragment", F.col("stated_month").isNotNull() | F.col("stated_year").isNotNull())


CARRIED = """
WITH a AS (SELECT *, CAST(1+event_id%28 AS INT) AS stated_day, last_value(stated_month IGNORE NULLS) OVER (PARTITION BY path_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM v_waypoints),
b AS (SELECT *, sum(CASE WHEN stated_year IS NULL AND stated_month<prior THEN 1 ELSE 0 END) OVER (PARTITION BY path_id ORDER BY pos) AS cum FROM a),
c AS (SELECT *, last_value(CASE WHEN stated_year IS NOT NULL THEN stated_year-cum END IGNORE NULLS) OVER (PARTITION BY path_id ORDER BY pos)+cum AS y, last_value(stated_month IGNORE NULLS) OVER (PARTITION BY path_id ORDER BY pos) AS m FROM b),
r AS (SELECT path_id, pos, CASE WHEN k THEN CAST(y AS INT) END AS year, CASE WHEN k THEN m END AS month, CASE WHEN k THEN stated_day END AS day FROM (SELECT *, (stated_month IS NOT NULL OR stated_year IS NOT NULL) AND y IS NOT NULL AND m IS NOT NULL AS k FROM c))"""


@query("carried_dates", CARRIED + " SELECT * FROM r", ("v_waypoints",))
def carried_dates(spark, sf):
    """Month and year carried along each path, new years found on the way.

    Blocks of 16 positions here, so that most paths span several."""
    return J.carry_dates(stated(spark, sf), "path_id", "pos", 16).select("path_id", "pos", "year", "month", "day")


@query("filled_gaps", CARRIED + """,
n AS (SELECT *, CAST(make_date(year,month,1)-DATE '1970-01-01' AS BIGINT)+day-1 AS d FROM r),
g AS (SELECT *, last_value(CASE WHEN d IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS p1, last_value(d IGNORE NULLS) OVER w AS d1,
  first_value(CASE WHEN d IS NOT NULL THEN pos END IGNORE NULLS) OVER x AS p2, first_value(d IGNORE NULLS) OVER x AS d2 FROM n
  WINDOW w AS (PARTITION BY path_id ORDER BY pos), x AS (PARTITION BY path_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT path_id, pos, DATE '1970-01-01'+CAST(coalesce(d, floor(d1+(d2-d1)*((pos-p1)/CAST(nullif(p2-p1,0) AS DOUBLE)))) AS INT) AS date FROM g""", ("v_waypoints",))
def filled_gaps(spark, sf):
    r = J.carry_dates(stated(spark, sf), "path_id", "pos", 16)
    return J.fill_gaps(r.select("path_id", "pos", "year", "month", "day"), "path_id", "pos", 16).select("path_id", "pos", "date")


@query("voyage_progress", """
SELECT event_id, round(least(1.0,greatest(0.0,CAST(CAST(ts AS DATE)-DATE '2024-01-05' AS DOUBLE)/(DATE '2024-01-25'-DATE '2024-01-05'))),9) AS t,
 concat(['January'][1],' ',CAST(day(ts) AS STRING),', ',CAST(year(ts) AS STRING)) AS label FROM events""")
def voyage_progress(spark, sf):
    d = F.to_date("ts")
    t = J.progress(d, F.lit("2024-01-05").cast("date"), F.lit("2024-01-25").cast("date"))
    return v.table(spark, sf, "events").select("event_id", F.round(t, 9).alias("t"), long_date(F.year(d), F.month(d), F.day(d)).alias("label"))


@query("route_points", """
WITH w AS (SELECT user_id AS path_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)-1 AS seq, CASE WHEN event_id%3=0 THEN CAST(ts AS DATE)-DATE '1970-01-01' END AS d FROM events),
g AS (SELECT *, last_value(CASE WHEN d IS NOT NULL THEN seq END IGNORE NULLS) OVER a AS p1, last_value(d IGNORE NULLS) OVER a AS d1, first_value(CASE WHEN d IS NOT NULL THEN seq END IGNORE NULLS) OVER b AS p2, first_value(d IGNORE NULLS) OVER b AS d2 FROM w
 WINDOW a AS (PARTITION BY path_id ORDER BY seq), b AS (PARTITION BY path_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT path_id, seq, DATE '1970-01-01'+CAST(coalesce(d, floor(d1+(d2-d1)*((seq-p1)/CAST(nullif(p2-p1,0) AS DOUBLE)))) AS INT) AS date FROM g)
SELECT path_id, seq, date, round(least(1.0,greatest(0.0,CAST(date-DATE '2024-01-05' AS DOUBLE)/(DATE '2024-01-25'-DATE '2024-01-05'))),9) AS t FROM f""")
def route_points(spark, sf):
    """From features to dated waypoints; two thirds of them name no date."""
    i, s = F.col("event_id"), lambda c: c.cast("string")
    day = F.to_date("ts")
    text = F.when(i % 3 == 0, F.concat(F.lit("On the "), s(F.day(day)), F.lit("th of January, "), s(F.year(day)), F.lit(" we sailed."))).otherwise("Calm sea.")
    f = v.table(spark, sf, "events").select(F.col("user_id").alias("path_id"), i.alias("pos"), F.concat(F.lit("#"), s(i), F.lit(" = stop")).alias("name"),
                                            text.alias("description"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng"))
    r = J.route_points(f, F.lit("2024-01-05").cast("date"), F.lit("2024-01-25").cast("date"))
    return r.select("path_id", "seq", "date", F.round("t", 9).alias("t"))


@query("way_lines", """
WITH r AS (SELECT w, p, n FROM (SELECT l_orderkey AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey) AS p, l_partkey AS n FROM lineitem) WHERE n%10<>0)
SELECT w AS way_id, count(*) AS n_points, round(min_by(CAST(n%180 AS DOUBLE)-90,p),6) AS first_lat, round(max_by(CAST(n%360 AS DOUBLE)-180,p),6) AS last_lng FROM r GROUP BY w HAVING count(*)>=2""")
def way_lines(spark, sf):
    """A tenth of the nodes is missing; short ways drop out."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    ways = v.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("way_id")).agg(F.sort_array(F.collect_list(row)).alias("r"))
    ways = ways.select("way_id", F.col("r.l_partkey").alias("nodes"))
    n = F.col("p_partkey")
    nodes = v.table(spark, sf, "part").filter("p_partkey % 10 <> 0").select(
        n.alias("node_id"), (n % 180 - 90).cast("double").alias("lat"), (n % 360 - 180).cast("double").alias("lng"))
    w = J.way_lines(ways, nodes)
    return w.select("way_id", F.size("points").cast("long").alias("n_points"), F.get("points", F.lit(0))["lat"].alias("first_lat"),
                    F.element_at("points", -1)["lng"].alias("last_lng"))


@query("relation_tree", """
WITH RECURSIVE m AS (SELECT CAST(floor(p_partkey/3) AS BIGINT) AS parent, p_partkey AS child FROM part WHERE p_partkey>0 UNION ALL SELECT p_partkey, CAST(floor(p_partkey/3) AS BIGINT) FROM part WHERE p_partkey BETWEEN 1 AND 40),
t AS (SELECT CAST(7 AS BIGINT) AS root, CAST(7 AS BIGINT) AS member UNION SELECT t.root, m.child FROM t JOIN m ON m.parent=t.member) SELECT root, member FROM t""")
def relation_tree(spark, sf):
    """Relations reachable from one, each once, over edges with cycles."""
    p = F.col("p_partkey")
    part = v.table(spark, sf, "part")
    edges = part.filter(p > 0).select(F.floor(p / 3).alias("parent"), p.alias("child")).unionAll(
        part.filter(p.between(1, 40)).select(p.alias("parent"), F.floor(p / 3).alias("child")))
    return K.reachable(edges, part.filter(p == 7).select(p.alias("root")))


def network(spark, sf):
    """Nine lines in a row and one apart; a third of them runs backwards."""
    i = F.col("o_orderkey")
    lat = (F.floor(i / 100) % 1500).cast("double") / 10 - 75 + F.when(i % 10 == 9, 0.05).otherwise(0.0)
    at = lambda k: F.struct(lat.alias("lat"), ((i % 100 + k).cast("double") / 5 - 60).alias("lng"))
    a, b = F.array(at(F.lit(0)), at(F.lit(1))), F.array(at(F.lit(1)), at(F.lit(0)))
    return v.table(spark, sf, "orders").select(i.alias("line"), F.when(i % 3 == 0, b).otherwise(a).alias("points"))


@query("merged_lines", """
SELECT o_orderkey AS line, CASE WHEN o_orderkey%10=9 THEN o_orderkey ELSE o_orderkey-o_orderkey%10 END AS chain,
 CASE WHEN o_orderkey%10=9 THEN 0 WHEN (o_orderkey-o_orderkey%10)%3=0 THEN 8-CAST(o_orderkey%10 AS INT) ELSE CAST(o_orderkey%10 AS INT) END AS seq,
 o_orderkey%10<>9 AND (o_orderkey%3=0)<>((o_orderkey-o_orderkey%10)%3=0) AS turned FROM orders""")
def merged_lines(spark, sf):
    return J.merge_lines(network(spark, sf))


@query("section_report", """
WITH s AS (SELECT CASE WHEN o_orderkey%10=9 THEN o_orderkey ELSE o_orderkey-o_orderkey%10 END AS chain, count(*) AS n_lines, sum(2*6371*asin(sqrt(pow(cos(radians(lat)),2)*pow(sin(radians(0.2)/2),2)))) AS km
 FROM (SELECT o_orderkey, (floor(o_orderkey/100)%1500)/10-75+CASE WHEN o_orderkey%10=9 THEN 0.05 ELSE 0 END AS lat FROM orders) GROUP BY 1)
SELECT chain, n_lines, round(km,3) AS length_km FROM s WHERE km>=10""")
def section_report(spark, sf):
    """Chains of at least 10 km."""
    lines = network(spark, sf)
    s = J.chain_lengths(lines, J.merge_lines(lines))
    return f.at_least_km(s).select("chain", "n_lines", F.round("length_km", 3).alias("length_km"))


@query("section_labels", """
SELECT s_nationkey, s_suppkey, rank, concat('Section ',CAST(rank AS STRING),' (',CAST(CAST(floor(abs(s_acctbal)+0.5) AS BIGINT) AS STRING),' km)') AS label FROM (
 SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY abs(s_acctbal) DESC, s_suppkey) AS rank FROM supplier)""")
def section_labels(spark, sf):
    s = v.table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", F.abs("s_acctbal").alias("length_km"))
    return J.label_sections(s, ["s_nationkey"], "s_suppkey").select("s_nationkey", "s_suppkey", "rank", "label")


@query("kept_share", """
SELECT count(*) FILTER (l>=2500) AS n_kept, round(sum(l) FILTER (l>=2500),2) AS kept_km, round(sum(l),2) AS total_km, round(sum(l) FILTER (l>=2500)*100/sum(l),6) AS percent FROM (SELECT abs(c_acctbal) AS l FROM customer)""")
def kept_share(spark, sf):
    s = v.table(spark, sf, "customer").select(F.abs("c_acctbal").alias("length_km"))
    r = J.kept_share(s, 2500.0)
    return r.select("n_kept", F.round("kept_km", 2).alias("kept_km"), F.round("total_km", 2).alias("total_km"), F.round("percent", 6).alias("percent"))
