"""Queries for layout, saved searches and samples."""

from pyspark.sql import functions as F

from chronofold.operators import layout as L, sampling as S, searches as Q, text_index as T
from chronofold.operators.lanes import assign_lanes
from chronofold.plans import fixtures as v
from chronofold.plans.places import polygons
from chronofold.plans.registry import query


LANED = """laned AS (SELECT h.lane, e.id, e.start_year AS s, e.end_year AS e FROM (SELECT entry_id, laneset_id, min_by(slug, ordinal) AS lane FROM v_hit GROUP BY ALL) h
 JOIN v_entries e ON e.id=h.entry_id),
o AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY s, id) AS n FROM laned)"""


def laned(spark, sf):
    """Entries by their lane in each of the lanesets."""
    lane = assign_lanes(v.primary_points(spark, sf), polygons(spark, sf), ["entry_id"])
    return v.entries(spark, sf).join(lane.select(F.col("entry_id").alias("id"), "lane"), "id")


@query("pack_rows", f"""
WITH RECURSIVE {LANED},
f AS (SELECT DISTINCT lane, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS INT) AS r, [CAST('-infinity' AS DOUBLE) FOR i IN range(8)] AS ends FROM o
 UNION ALL SELECT lane, n, id, r, [CASE WHEN i=r THEN CAST(greatest(e,s+5)+40 AS DOUBLE) ELSE ends[i+1] END FOR i IN range(8)] FROM (
  SELECT o.lane, o.n, o.id, o.s, o.e, f.ends, CAST(coalesce(list_position([x<=o.s-5 FOR x IN f.ends], true), 8)-1 AS INT) AS r FROM f JOIN o ON o.lane=f.lane AND o.n=f.n+1))
SELECT lane, id, r AS "row" FROM f WHERE n>0""", ("v_entries", "v_hit"))
def pack_rows(spark, sf):
    """Entries of each lane in up to eight rows."""
    return L.pack_rows(laned(spark, sf), "lane", "id", "start_year", "end_year", 5, 40)


@query("pack_tracks", f"""
WITH RECURSIVE {LANED},
f AS (SELECT DISTINCT lane, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS INT) AS t, CAST(NULL AS BIGINT) AS gone,
  CAST('-infinity' AS DOUBLE) AS e0, CAST(NULL AS BIGINT) AS k0, CAST('-infinity' AS DOUBLE) AS e1, CAST(NULL AS BIGINT) AS k1 FROM o
 UNION ALL SELECT lane, n, id, t, CASE WHEN e0<=s OR e1<=s THEN NULL WHEN t=0 THEN k0 WHEN t=1 THEN k1 END,
  CASE WHEN t=0 THEN e ELSE e0 END, CASE WHEN t=0 THEN id ELSE k0 END, CASE WHEN t=1 THEN e ELSE e1 END, CASE WHEN t=1 THEN id ELSE k1 END FROM (
  SELECT o.lane, o.n, o.id, o.s, CAST(o.e AS DOUBLE) AS e, f.e0, f.k0, f.e1, f.k1,
   CAST(CASE WHEN e0<=o.s THEN 0 WHEN e1<=o.s THEN 1 WHEN e0<=e1 AND o.e>e0 THEN 0 WHEN e1<e0 AND o.e>e1 THEN 1 END AS INT) AS t FROM f JOIN o ON o.lane=f.lane AND o.n=f.n+1))
SELECT f.lane, f.id, f.t AS track FROM f WHERE t IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f g WHERE g.lane=f.lane AND g.gone=f.id)""", ("v_entries", "v_hit"))
def pack_tracks(spark, sf):
    """Intervals of each lane on two tracks, early-ending ones put out."""
    return L.pack_tracks(laned(spark, sf), "lane", "id", "start_year", "end_year")


@query("saved_search_bounds", """
SELECT query_id, CAST(max(lo) FILTER (kind='year') AS DOUBLE) AS year_min, CAST(min(hi) FILTER (kind='year') AS DOUBLE) AS year_max, max_by(str_value, seq) FILTER (kind='category') AS categories,
 CAST(NULL AS DOUBLE) AS lat_min, 100 AS row_limit FROM v_query_spec GROUP BY query_id""", ("v_query_spec",))
def saved_search_bounds(spark, sf):
    b = Q.resolve(v.query_spec(spark, sf))
    return b.select("query_id", "year_min", "year_max", F.array_join("categories", ",").alias("categories"), "lat_min", "row_limit")


@query("saved_searches", """
WITH b AS (SELECT query_id, max(lo) FILTER (kind='year') AS y0, min(hi) FILTER (kind='year') AS y1, max_by(str_value, seq) FILTER (kind='category') AS cat FROM v_query_spec GROUP BY query_id)
SELECT query_id, rank, id, slug, start_year FROM (SELECT b.query_id, e.id, e.slug, e.start_year, row_number() OVER (PARTITION BY b.query_id ORDER BY e.start_year, e.slug) AS rank
 FROM b JOIN v_entries e ON e.category=b.cat AND e.start_year<=b.y1 AND e.end_year>=b.y0) WHERE rank<=100""", ("v_query_spec", "v_entries"))
def saved_searches(spark, sf):
    """All saved searches in one pass over the entries."""
    return Q.run_all(Q.resolve(v.query_spec(spark, sf)), v.entries_with_tags(spark, sf))


def full_spec(spark, sf):
    """Searches that use every kind of line, some of them twice."""
    k = F.col("n_nationkey")
    line = lambda seq, kind, text=F.lit(None), lo=F.lit(None), hi=F.lit(None): F.struct(
        F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.cast("string").alias("str_value"),
        lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    lines = F.array(line(1, "year", lo=F.lit(1900), hi=k * 20 - 3000), line(2, "text", F.lit("Nothing")), line(3, "text", F.lit("BUILDING")),
                    line(4, "category", F.lit("no-such, also-none")), line(5, "lat", lo=F.lit(60), hi=F.lit(-80)), line(6, "lat", lo=k - 90, hi=F.lit(70)),
                    line(7, "inside", F.concat(F.lit("lane-"), k.cast("string"))), line(8, "outside", F.concat(F.lit("lane-"), (k + 1).cast("string"))),
                    line(9, "limit", lo=F.lit(5000)))
    return v.table(spark, sf, "nation").select(k.alias("query_id"), F.explode(lines).alias("f")).select("query_id", "f.*")


@query("saved_searches_all_kinds", """
SELECT query_id, rank, id, slug, start_year FROM (
 SELECT n_nationkey AS query_id, e.id, e.slug, e.start_year, row_number() OVER (PARTITION BY n_nationkey ORDER BY e.start_year, e.slug) AS rank FROM nation
 JOIN v_entries e ON e.start_year<=1900 AND e.end_year>=n_nationkey*20-3000 AND contains(lower(e.title)||' '||lower(e.description),'building') AND NOT (category='historical_period' AND tag LIKE '%-history')
 JOIN v_locations p ON p.entry_id=e.id AND p.ordinal=0 AND p.lat BETWEEN greatest(-80,n_nationkey-90) AND 60 AND p.lng BETWEEN -150 AND 150
 JOIN v_hit h ON h.entry_id=e.id AND h.slug=concat('lane-',CAST(n_nationkey AS STRING))
 WHERE NOT EXISTS (SELECT 1 FROM v_hit o WHERE o.entry_id=e.id AND o.slug=concat('lane-',CAST(n_nationkey+1 AS STRING)))) WHERE rank<=5000""",
       ("v_entries", "v_locations", "v_hit"))
def saved_searches_all_kinds(spark, sf):
    b = Q.resolve(full_spec(spark, sf), box=(-90.0, 90.0, -150.0, 150.0))
    return Q.run_all(b, v.entries_with_tags(spark, sf), v.primary_points(spark, sf), polygons(spark, sf))


@query("saved_searches_indexed", """
SELECT query_id, rank, id, slug, start_year FROM (SELECT s_suppkey AS query_id, e.id, e.slug, e.start_year, row_number() OVER (PARTITION BY s_suppkey ORDER BY e.start_year, e.slug) AS rank
 FROM supplier JOIN v_entries e ON e.start_year<=1500-s_suppkey%1000 AND e.end_year>=-2000-s_suppkey%700
 AND contains(lower(e.title)||' '||lower(e.description), lower(CASE WHEN s_suppkey%10=3 THEN 'zz no such' WHEN s_suppkey%10=7 THEN 'r1' ELSE right('00000'||CAST(s_suppkey%1500 AS STRING),5) END))
 AND NOT (category='historical_period' AND tag LIKE '%-history')) WHERE rank<=5+query_id%90""", ("v_entries",))
def saved_searches_indexed(spark, sf):
    """A search for each supplier, each with its own text, years and limit, by an index of the entries' trigrams."""
    k = F.col("s_suppkey")
    line = lambda seq, kind, text=F.lit(None), lo=F.lit(None), hi=F.lit(None): F.struct(
        F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.cast("string").alias("str_value"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    text = F.when(k % 10 == 3, "ZZ no such").when(k % 10 == 7, "R1").otherwise(F.lpad((k % 1500).cast("string"), 5, "0"))
    lines = F.array(line(1, "text", text), line(2, "year", lo=-2000 - k % 700, hi=1500 - k % 1000), line(3, "limit", lo=5 + k % 90))
    spec = v.table(spark, sf, "supplier").select(k.alias("query_id"), F.explode(lines).alias("f")).select("query_id", "f.*")
    e = v.entries_with_tags(spark, sf)
    index = T.build(e.select("id", Q.words_of(F.col("title"), F.col("description")).alias("words")))
    return Q.run_all(Q.resolve(spec), e, index=index)


INDEX = "(SELECT 'dump-1' AS file, CAST(floor(doc_id/100) AS BIGINT)*650+17 AS \"offset\", doc_id, concat('Doc: ',CAST(doc_id AS STRING)) AS title FROM documents)"


def index(spark, sf):
    i = F.col("doc_id")
    return v.table(spark, sf, "documents").select(
        F.lit("dump-1").alias("file"), (F.floor(i / 100) * 650 + 17).alias("offset"), F.concat(F.lit("Doc: "), i.cast("string")).alias("title"), "doc_id")


@query("next_offsets", f"""
SELECT file, "offset", lead("offset") OVER (ORDER BY "offset") AS next_offset, row_number() OVER (ORDER BY "offset")-1 AS stream FROM (SELECT DISTINCT file, "offset" FROM {INDEX})""")
def next_offsets(spark, sf):
    return S.next_offsets(index(spark, sf))


@query("find_titles", f"""
WITH n AS (SELECT "offset", lead("offset") OVER (ORDER BY "offset") AS next_offset FROM (SELECT DISTINCT "offset" FROM {INDEX}))
SELECT i.title, i.file, i."offset", n.next_offset FROM {INDEX} i JOIN n ON n."offset"=i."offset" WHERE doc_id IN (SELECT doc_id FROM labels)""")
def find_titles(spark, sf):
    titles = v.table(spark, sf, "labels").select(F.concat(F.lit("Doc: "), F.col("doc_id").cast("string")).alias("title"))
    return S.find_titles(titles, index(spark, sf))


@query("stream_stride", "SELECT doc_id FROM documents WHERE floor(doc_id/10)>=2 AND (floor(doc_id/10)-2)%7=0")
def stream_stride(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 10).alias("stream"))
    return S.every_nth(d, "stream", 7, 2).select("doc_id")


@query("sample_with_restarts", """
SELECT 0 AS pass, doc_id FROM documents WHERE lang='en' AND floor(doc_id/10)%9=0 UNION ALL SELECT 1, doc_id FROM documents WHERE lang='en' AND floor(doc_id/10)>=1 AND (floor(doc_id/10)-1)%5=0
UNION ALL SELECT 2, doc_id FROM documents WHERE lang='en' AND floor(doc_id/10)>=2 AND (floor(doc_id/10)-2)%3=0""")
def sample_with_restarts(spark, sf):
    """The target is never met, so both restarts run."""
    d = v.table(spark, sf, "documents").select("doc_id", "lang", F.floor(F.col("doc_id") / 10).alias("stream"))
    return S.sample_until(d, "stream", lambda p: p.filter("lang = 'en'"), 9, 10**9).select("pass", "doc_id")


@query("stop_after_considering", """
WITH s AS (SELECT stream, sum(n) OVER (ORDER BY stream)-n AS seen FROM (SELECT floor(doc_id/10) AS stream, count(*) AS n FROM documents GROUP BY 1))
SELECT doc_id FROM documents WHERE floor(doc_id/10) IN (SELECT stream FROM s WHERE seen<(SELECT count(*)/3 FROM documents))""")
def stop_after_considering(spark, sf):
    """A third of the pages, to the end of the stream that reaches it."""
    d = v.table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 10).alias("stream"))
    return S.stop_after_considering(d, "stream", d.count() / 3).select("doc_id")


@query("stop_after_collecting", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 150")
def stop_after_collecting(spark, sf):
    """The first 150 in order: the stop rule itself."""
    return S.stop_after_collecting(v.table(spark, sf, "documents").select("doc_id"), ["doc_id"], 150)


@query("spread_sample", """
WITH r AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY id)-1 AS i, count(*) OVER (PARTITION BY category) AS n, min(id) OVER (PARTITION BY category) AS f FROM v_entries WHERE tag='no-coords-found'),
c AS (SELECT ceil(400.0/count(DISTINCT category)) AS share FROM r)
SELECT id, category FROM r JOIN c ON true WHERE i%greatest(1,CAST(floor(n/share) AS BIGINT))=0 AND i/greatest(1,floor(n/share))<share ORDER BY f, id LIMIT 400""", ("v_entries",))
def spread_sample(spark, sf):
    """About 400 entries without coordinates, spread over their categories."""
    d = v.entries(spark, sf).filter("tag = 'no-coords-found'").select("id", "category")
    return S.spread_sample(d, "category", "id", 400)
