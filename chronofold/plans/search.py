"""Queries over stored entries: filters, order, lists, saved searches."""

from pyspark.sql import functions as F

from chronofold.functions import years
from chronofold.functions.text import citation_label, citation_url, percent_encode
from chronofold.operators import entries as E, filters as f, searches as Q, text_index as T
from chronofold.plans import fixtures as v
from chronofold.plans.registry import query


@query("entry_search", """
SELECT e.id, e.slug, e.title, e.start_year, e.end_year, e.category, count(*) AS n_locations, round(min(l.lat),6) AS min_lat, round(max(l.lng),6) AS max_lng
FROM (SELECT * FROM v_entries e WHERE NOT (category='historical_period' AND tag LIKE '%-history')
  AND start_year<=1500 AND end_year>=-1000 AND category IN ('person','event','place','artifact')
  AND contains(lower(title)||' '||lower(description),'building')
  AND EXISTS (SELECT 1 FROM v_locations p WHERE p.entry_id=e.id AND p.ordinal=0 AND p.lat BETWEEN -60 AND 75 AND p.lng BETWEEN -120 AND 140)
  ORDER BY start_year, slug LIMIT 100) e JOIN v_locations l ON l.entry_id=e.id
GROUP BY ALL""", ("v_entries", "v_locations"))
def entry_search(spark, sf):
    """The whole search: not an era, years, category, text, box; order, limit, nest."""
    df = f.without_eras(v.entries_with_tags(spark, sf))
    df = f.in_categories(f.overlapping_years(df, -1000, 1500), ["person", "event", "place", "artifact"])
    df = f.text_contains(df, "Building")
    df = f.in_box_entries(df, v.primary_points(spark, sf), lat_min=-60.0, lat_max=75.0, lng_min=-120.0, lng_max=140.0)
    top = f.first_entries(df, 100)
    full = E.page_with_locations(top, lambda ids: v.locations(spark, sf, ids), "kind", "lng", "lat")
    return full.select("id", "slug", "title", "start_year", "end_year", "category",
                       F.size("locations").cast("long").alias("n_locations"),
                       F.round(F.array_min("locations.lat"), 6).alias("min_lat"),
                       F.round(F.array_max("locations.lng"), 6).alias("max_lng"))


@query("filter_category", "SELECT id, category FROM v_entries WHERE category IN ('person','concepts')", ("v_entries",))
def filter_category(spark, sf):
    return f.in_categories(v.entries(spark, sf), ["person", "concepts"]).select("id", "category")


@query("filter_year_overlap", "SELECT id, start_year, end_year FROM v_entries WHERE start_year<=300 AND end_year>=250", ("v_entries",))
def filter_year_overlap(spark, sf):
    return f.overlapping_years(v.entries(spark, sf), 250, 300).select("id", "start_year", "end_year")


@query("filter_text", """
SELECT id, title, description FROM v_entries
WHERE position(lower('Machinery 1-URGENT') IN lower(title)||' '||lower(description))>0""", ("v_entries",))
def filter_text(spark, sf):
    """The needle spans the join of title and description."""
    return f.text_contains(v.entries(spark, sf), "Machinery 1-URGENT").select("id", "title", "description")


@query("filter_text_indexed", """
SELECT id, title, description FROM v_entries
WHERE position(lower('Machinery 1-URGENT') IN lower(title)||' '||lower(description))>0""", ("v_entries",))
def filter_text_indexed(spark, sf):
    """The same by the trigrams of all entries: the rarest ones lead to the texts that are tested."""
    e = v.entries(spark, sf).select("id", "title", "description")
    index = T.build(e.select("id", Q.words_of(F.col("title"), F.col("description")).alias("words")))
    return e.join(T.holding(index, "machinery 1-urgent"), "id", "left_semi")


@query("filter_label_text", """
SELECT id, label FROM (SELECT id, CASE WHEN id%7<>0 THEN title END AS label, CASE WHEN id%5<>0 THEN description END AS description FROM v_entries)
WHERE contains(lower(coalesce(label,'')),'low') OR contains(lower(coalesce(description,'')),'low')""", ("v_entries",))
def filter_label_text(spark, sf):
    df = v.entries(spark, sf).select("id", F.when(F.col("id") % 7 != 0, F.col("title")).alias("label"),
                                     F.when(F.col("id") % 5 != 0, F.col("description")).alias("description"))
    return f.label_contains(df, "LOW").select("id", "label")


@query("filter_box", """
SELECT id FROM v_entries e WHERE EXISTS (SELECT 1 FROM v_locations p WHERE p.entry_id=e.id AND p.ordinal=0
 AND p.lat BETWEEN 10 AND 40 AND p.lng BETWEEN -180 AND 30)""", ("v_entries", "v_locations"))
def filter_box(spark, sf):
    return f.in_box_entries(v.entries(spark, sf), v.primary_points(spark, sf),
                            lat_min=10.0, lat_max=40.0, lng_max=30.0).select("id")


@query("filter_box_facts", """
SELECT entry_id AS item, lat, lng FROM v_locations WHERE lat>=-20 AND lat<=20""", ("v_locations",))
def filter_box_facts(spark, sf):
    """Latitude alone; every place of an item is tested on its own."""
    p = v.locations(spark, sf)
    return p.filter((F.col("lat") >= -20.0) & (F.col("lat") <= 20.0)).select(F.col("entry_id").alias("item"), "lat", "lng")


@query("filter_era", """
SELECT id, title, start_year, end_year, tag AS source FROM v_entries WHERE category='historical_period' AND tag LIKE '%-history'""", ("v_entries",))
def filter_era(spark, sf):
    return E.eras(v.entries_with_tags(spark, sf)).drop("last_updated")


@query("filter_not_era", "SELECT id FROM v_entries WHERE NOT (category='historical_period' AND tag LIKE '%-history')", ("v_entries",))
def filter_not_era(spark, sf):
    return f.without_eras(v.entries_with_tags(spark, sf)).select("id")


@query("filter_ids", "SELECT id, title FROM v_entries WHERE id IN (SELECT user_id FROM events)", ("v_entries",))
def filter_ids(spark, sf):
    ids = v.table(spark, sf, "events").select(F.col("user_id").alias("id"))
    return f.by_ids(v.entries(spark, sf), ids).select("id", "title")


@query("order_limit", """
SELECT id, slug, start_year FROM v_entries ORDER BY start_year, slug LIMIT 900""", ("v_entries",))
def order_limit(spark, sf):
    """The first 900 rows: a limit is what the caller says."""
    return f.first_entries(v.entries(spark, sf), 900).select("id", "slug", "start_year")


@query("order_descending", """
SELECT id, slug, start_year FROM v_entries ORDER BY start_year DESC, slug LIMIT 100""", ("v_entries",))
def order_descending(spark, sf):
    return f.first_entries(v.entries(spark, sf), descending=True).select("id", "slug", "start_year")


@query("era_list", """
SELECT id, start_year, last_updated FROM v_entries WHERE category='historical_period' AND tag LIKE '%-history' ORDER BY start_year, id""", ("v_entries",))
def era_list(spark, sf):
    return f.only_eras(v.entries_with_tags(spark, sf)).select("id", "start_year", "last_updated").orderBy("start_year", "id")


@query("year_labels", """
SELECT id, CASE WHEN start_year<0 THEN concat(CAST(-start_year AS STRING),' BCE') ELSE concat(CAST(start_year AS STRING),' CE') END AS start_label,
 CASE WHEN start_year=end_year THEN CASE WHEN start_year<0 THEN concat(CAST(-start_year AS STRING),' BCE') ELSE concat(CAST(start_year AS STRING),' CE') END
 ELSE concat(CASE WHEN start_year<0 THEN concat(CAST(-start_year AS STRING),' BCE') ELSE concat(CAST(start_year AS STRING),' CE') END,' – ',
  CASE WHEN end_year<0 THEN concat(CAST(-end_year AS STRING),' BCE') ELSE concat(CAST(end_year AS STRING),' CE') END) END AS span_label FROM v_entries""", ("v_entries",))
def year_labels(spark, sf):
    s, e = F.col("start_year"), F.col("end_year")
    return v.entries(spark, sf).select("id", years.year_label(s).alias("start_label"), years.span_label(s, e).alias("span_label"))


@query("entry_dates", """
SELECT id, title AS start_expression, start_year AS s_year, end_year AS s_end_year, 0 AS s_month,
 CASE WHEN end_year<>start_year THEN description END AS end_expression,
 CASE WHEN end_year<>start_year THEN end_year END AS e_year,
 CASE WHEN end_year<>start_year THEN end_year ELSE end_year END AS layout_end FROM v_entries""", ("v_entries",))
def entry_dates(spark, sf):
    """Start and end date structs, the end null for a one-year entry."""
    zero = F.lit(0)
    df = v.entries(spark, sf).withColumns({
        "start_expr": F.col("title"), "end_expr": F.col("description"), "calendar": F.lit("gregorian"),
        "uncertainty_years": F.lit(0.0), "start_month": zero, "start_day": zero, "end_month": zero, "end_day": zero})
    s, e = years.start_date(), years.end_date()
    df = df.select("id", s.alias("s"), e.alias("e"))
    return df.select("id", F.col("s.original_expression").alias("start_expression"),
                     F.col("s.start_year").alias("s_year"), F.col("s.end_year").alias("s_end_year"),
                     F.col("s.start_month").alias("s_month"),
                     F.col("e.original_expression").alias("end_expression"), F.col("e.start_year").alias("e_year"),
                     years.layout_end(F.col("e.start_year"), F.col("s.end_year")).alias("layout_end"))


@query("citation_fallback", """
SELECT id, CASE WHEN id%4=0 THEN 'https://example.org/x' ELSE concat('https://en.wikipedia.org/wiki/',replace(replace(title,'#','%23'),' ','%20')) END AS citation_url,
 CASE WHEN id%4=0 THEN 'Example' ELSE 'Wikipedia' END AS citation_label, CASE WHEN id%4=0 THEN '' ELSE title END AS wikipedia_title FROM v_entries""", ("v_entries",))
def citation_fallback(spark, sf):
    own = F.col("id") % 4 == 0
    df = v.entries(spark, sf).withColumns({
        "citation_url": F.when(own, "https://example.org/x").otherwise(""), "citation_label": F.when(own, "Example").otherwise(""),
        "infobox_type": F.lit(""), "tags": F.array("tag"), "calendar": F.lit("gregorian"),
        **{c: F.lit("") for c in ("start_expr", "end_expr")}, "uncertainty_years": F.lit(0.0),
        **{c: F.lit(0) for c in ("start_month", "start_day", "end_month", "end_day")}})
    return E.full_records(df).select("id", "citation_url", "citation_label", "wikipedia_title")


@query("percent_encoding", """
SELECT p_partkey, replace(replace(replace(replace(concat(p_name,' (',p_brand,')*!',p_type),'#','%23'),' ','%20'),'/','%2F'),'&','%26') AS encoded FROM part""")
def percent_encoding(spark, sf):
    t = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")*!"), "p_type")
    return v.table(spark, sf, "part").select("p_partkey", percent_encode(t).alias("encoded"))


@query("nested_locations", """
SELECT e.id, count(l.ordinal) AS n_locations, min(CASE WHEN l.ordinal=0 THEN round(l.lng,6) END) AS first_lng,
 min(CASE WHEN l.ordinal=1 THEN round(l.lat,6) END) AS second_lat, coalesce(string_agg(CAST(l.ordinal AS STRING), ',' ORDER BY l.ordinal),'') AS ordinals
FROM v_entries e LEFT JOIN v_locations l ON l.entry_id=e.id GROUP BY e.id""", ("v_entries", "v_locations"))
def nested_locations(spark, sf):
    """Every entry with its ordered location array, empty when it has none."""
    df = E.with_locations(v.entries(spark, sf), v.locations(spark, sf), "kind", "lng", "lat")
    loc = F.col("locations")
    return df.select("id", F.size(loc).cast("long").alias("n_locations"),
                     F.round(F.get(loc, F.lit(0))["lng"], 6).alias("first_lng"),
                     F.round(F.get(loc, F.lit(1))["lat"], 6).alias("second_lat"),
                     F.array_join(F.transform(loc, lambda x: x["ordinal"].cast("string")), ",").alias("ordinals"))


RING = "concat('[[',x,',',y,'],[',x1,',',y,'],[',x1,',',y1,'],[',x,',',y,']]')"


@query("location_json", f"""
WITH p AS (SELECT md5(concat('l-',CAST(entry_id AS VARCHAR),'-',CAST(ordinal AS VARCHAR))) AS h, ((entry_id+ordinal)%5+5)%5 AS k, floor(lng*2)/2 AS lng, floor(lat*2)/2 AS lat FROM v_locations),
t AS (SELECT *, CAST(lng AS VARCHAR) AS x, CAST(lat AS VARCHAR) AS y, CAST(lng+1 AS VARCHAR) AS x1, CAST(lat+1 AS VARCHAR) AS y1 FROM p)
SELECT concat_ws('-',substr(h,1,8),substr(h,9,4),substr(h,13,4),substr(h,17,4),substr(h,21,12)) AS entry_id, 0 AS ordinal, CASE k
 WHEN 0 THEN concat('{{"type":"point","lat":',y,',"lng":',x,',"uncertain":false,"label":null}}')
 WHEN 1 THEN concat('{{"type":"circle","centerLat":',y,',"centerLng":',x,',"radiusKm":25.0,"uncertain":true,"label":"about"}}')
 WHEN 2 THEN concat('{{"type":"polygon","rings":[',{RING},'],"uncertain":false,"label":null}}')
 WHEN 3 THEN concat('{{"type":"multipolygon","polygons":[[',{RING},'],[',{RING},']],"uncertain":true,"label":"about"}}')
 ELSE concat('{{"type":"path","waypoints":[{{"lat":',y,',"lng":',x,',"t":0.0,"label":"from"}},{{"lat":',y1,',"lng":',x1,',"t":null,"label":null}}],"label":null}}') END AS location
FROM t""", ("v_locations",))
def location_json(spark, sf):
    """Locations of all five kinds, loaded into the stored table and written out as JSON objects."""
    from chronofold.schema import LOCATION
    from chronofold.sources.sinks import location_table
    x, y, k = F.floor(F.col("lng") * 2) / 2, F.floor(F.col("lat") * 2) / 2, F.pmod(F.col("entry_id") + F.col("ordinal"), F.lit(5))
    ring = F.array(F.array(x, y), F.array(x + 1, y), F.array(x + 1, y + 1), F.array(x, y))
    stop = lambda lat, lng, t, label: F.struct(lat.alias("lat"), lng.alias("lng"), F.lit(t).cast("double").alias("t"), F.lit(label).cast("string").alias("label"))
    members = {"type": F.element_at(F.array(*map(F.lit, ["point", "circle", "polygon", "multipolygon", "path"])), (k + 1).cast("int")),
               "lat": y, "lng": x, "centerLat": y, "centerLng": x, "radiusKm": F.lit(25.0), "rings": F.array(ring), "polygons": F.array(F.array(ring), F.array(ring)),
               "waypoints": F.array(stop(y, x, 0.0, "from"), stop(y + 1, x + 1, None, None)), "uncertain": k % 2 == 1,
               "label": F.when(k % 2 == 1, F.lit("about"))}
    one = F.struct(*[members[f.name].alias(f.name) for f in LOCATION.fields]).cast(LOCATION)
    slug = F.concat_ws("-", F.lit("l"), F.col("entry_id").cast("string"), F.col("ordinal").cast("string"))
    stored = location_table(v.locations(spark, sf).select(slug.alias("slug"), F.array(one).alias("locations")))
    return stored.select("entry_id", "ordinal", E.location_json(F.col("kind")).alias("location"))


@query("boundary_list", """
SELECT DISTINCT e.id, e.slug, e.title FROM v_entries e JOIN v_locations l ON l.entry_id=e.id WHERE l.ordinal%3=2 ORDER BY e.title""", ("v_entries", "v_locations"))
def boundary_list(spark, sf):
    loc = v.locations(spark, sf).withColumn("kind", F.when(F.col("ordinal") % 3 == 2, "multipolygon").otherwise("point"))
    return E.boundaries(v.entries(spark, sf), loc)


@query("pinned_merge", """
WITH m AS (SELECT id, slug, start_year, 0 AS part, NULL AS pin_order FROM v_entries WHERE category='place' AND start_year<=0 ORDER BY start_year, slug LIMIT 100),
p AS (SELECT user_id AS id, min(event_id) AS pin_order FROM events GROUP BY user_id)
SELECT id, slug, part, CAST(pin_order AS BIGINT) AS pin_order FROM m UNION ALL
SELECT e.id, e.slug, 1, p.pin_order FROM p JOIN v_entries e ON e.id=p.id WHERE e.id NOT IN (SELECT id FROM m)""", ("v_entries",))
def pinned_merge(spark, sf):
    e = v.entries(spark, sf)
    m = f.first_entries(f.in_categories(e, ["place"]).filter("start_year <= 0"), 100)
    pins = v.table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.min("event_id").alias("pin_order"))
    return E.with_pins(m, ["start_year", "slug"], e, pins).select("id", "slug", "part", "pin_order")


@query("result_counts", """
SELECT (SELECT count(*) FROM v_entries WHERE category='place') AS n_matches, (SELECT count(DISTINCT user_id) FROM events) AS n_pinned""", ("v_entries",))
def result_counts(spark, sf):
    return E.result_counts(f.in_categories(v.entries(spark, sf), ["place"]),
                           v.table(spark, sf, "events").select("user_id").distinct())


@query("table_counts", """
SELECT 'lanesets' AS table_name, count(DISTINCT laneset_id) AS n_rows FROM v_ring UNION ALL SELECT 'lanes', count(DISTINCT lane_id) FROM v_ring
UNION ALL SELECT 'entries', count(*) FROM v_entries UNION ALL SELECT 'entry_locations', count(*) FROM v_locations""",
       ("v_ring", "v_entries", "v_locations"))
def table_counts(spark, sf):
    ring = v.ring_vertices(spark, sf)
    return E.table_counts({"lanesets": ring.select("laneset_id").distinct(), "lanes": ring.select("lane_id").distinct(),
                           "entries": v.entries(spark, sf), "entry_locations": v.locations(spark, sf)})


@query("density_histogram", """
SELECT bucket, n, n/CAST(max(n) OVER () AS DOUBLE) AS height FROM (
 SELECT CAST(floor(start_year/100.0)*100 AS INT) AS bucket, count(*) AS n FROM v_entries WHERE start_year BETWEEN -500 AND 1500 GROUP BY 1)""", ("v_entries",))
def density_histogram(spark, sf):
    return E.density(v.entries(spark, sf), -500, 1500)
