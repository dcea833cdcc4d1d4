"""Queries over pages with infoboxes."""

from pyspark.sql import functions as F

from chronofold.functions import coords, dates
from chronofold.functions.text import decode_entities, description, escape_field, slug, unescape_field, with_suffixes
from chronofold.operators import catalog as C, extract as X
from chronofold.plans import fixtures as v
from chronofold.plans.registry import query

# The numbers each page's infobox was made from, for the check SQL.
NUMBERS = """
SELECT doc_id AS page_id, doc_id AS i, CAST(doc_id%5 AS INT) AS f, CAST(doc_id%6 AS INT) AS t, text,
 CASE CAST(doc_id%6 AS INT) WHEN 0 THEN 'person' WHEN 1 THEN 'military_conflict' WHEN 2 THEN 'settlement' WHEN 3 THEN 'ship_begin' WHEN 4 THEN 'officeholder' ELSE 'album' END AS infobox_type,
 CASE CAST(doc_id%6 AS INT) WHEN 0 THEN 'person' WHEN 1 THEN 'event' WHEN 2 THEN 'place' WHEN 4 THEN 'person' ELSE 'artifact' END AS category,
 CASE CAST(doc_id%5 AS INT) WHEN 0 THEN 1500+doc_id%400 WHEN 1 THEN -(100+doc_id%900) WHEN 2 THEN 1000+doc_id%300 WHEN 3 THEN 1600+doc_id%300 ELSE -(4+doc_id%16)*100 END AS y0,
 CASE CAST(doc_id%5 AS INT) WHEN 0 THEN 1500+doc_id%400 WHEN 1 THEN -(100+doc_id%900) WHEN 2 THEN 1400+doc_id%300 WHEN 3 THEN 1600+doc_id%300 ELSE -(3+doc_id%16)*100 END AS y1,
 CASE CAST(doc_id%5 AS INT) WHEN 0 THEN 1+doc_id%12 WHEN 3 THEN 5 ELSE 0 END AS m, CASE WHEN doc_id%5 IN (0,3) THEN 1+doc_id%28 ELSE 0 END AS d,
 CASE CAST(doc_id%5 AS INT) WHEN 0 THEN 20 WHEN 1 THEN CASE WHEN 100+doc_id%900>=500 THEN 50 ELSE 20 END WHEN 2 THEN 50 WHEN 3 THEN 20 ELSE CASE WHEN 4+doc_id%16>=10 THEN 100 ELSE 50 END END AS unc,
 CASE CAST(doc_id%5 AS INT) WHEN 0 THEN concat('{{birth date|',CAST(1500+doc_id%400 AS STRING),'|',CAST(1+doc_id%12 AS STRING),'|',CAST(1+doc_id%28 AS STRING),'}}')
  WHEN 1 THEN concat('c. ',CAST(100+doc_id%900 AS STRING),' BC') WHEN 2 THEN concat(CAST(1000+doc_id%300 AS STRING),'-',CAST(1400+doc_id%300 AS STRING))
  WHEN 3 THEN concat(CAST(1+doc_id%28 AS STRING),' May ',CAST(1600+doc_id%300 AS STRING)) ELSE concat(CAST(4+doc_id%16 AS STRING),'th century BC') END AS expr,
 CASE WHEN doc_id%3<>0 THEN round((doc_id%90+(doc_id%60)/60.0)*CASE WHEN doc_id%2=0 THEN 1 ELSE -1 END,6) END AS lat, CASE WHEN doc_id%3<>0 THEN doc_id%180+0.5 END AS lng
FROM documents"""
# Its first real prose line, then its first sentence.
PROSE = """
SELECT page_id, coalesce(nullif(regexp_extract(line,'^([^.!?]+[.!?])',1),''), line[1:150]) AS sentence FROM (
 SELECT page_id, list_filter(list_transform(string_split(regexp_replace(x,'[ \\t]{2,}',' ','g'),chr(10)), lambda s: regexp_replace(regexp_replace(s,'^[\\s,;()\\[\\]]+',''),'\\s+$','')),
   lambda s: length(s)>40 AND s[1:1] NOT IN ('*','|','{'))[1] AS line FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w,'\\[\\[\\s*(?:File|Image)\\s*:[^\\]]*\\]\\]','','gi'),'\\[https?://[^\\s\\]]+\\s+([^\\]]+)\\]','\\1','g'),
   '\\[https?://[^\\]]*\\]','','g'),'\\[\\[(?:[^\\]|]*\\|)?([^\\]]*)\\]\\]','\\1','g'),'''{2,3}','','g'),'==+[^=]+=+','','g'),'\\[\\[Category:[^\\]]*\\]\\]','','gi') AS x FROM (
   SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(wikitext,'<ref\\b[^>]*/>','','gi'),'<ref\\b[^>]*>[\\s\\S]*?</ref>','','gi'),'<[^>]+>','','g'),'\\{\\{[^{}]*\\}\\}','','g'),'\\{\\{[^{}]*\\}\\}','','g') AS w FROM v_wikitext)))"""


def _with(sql: str, prose: bool = False) -> str:
    return f"WITH n AS ({NUMBERS}){f', p AS ({PROSE})' if prose else ''} {sql}"


def typed(spark, sf):
    df = v.wiki_pages(spark, sf).select("page_id", C.infobox_types(F.col("wikitext")).alias("types"), "wikitext")
    return df


@query("infobox_types", _with("SELECT page_id, 0 AS n, infobox_type FROM n"))
def infobox_types(spark, sf):
    return typed(spark, sf).select("page_id", F.posexplode("types").alias("n", "infobox_type"))


@query("type_categories", """
SELECT page_id, segment, category FROM (SELECT c_custkey AS page_id, concat(c_mktsegment,' ',CASE CAST(c_custkey%6 AS INT) WHEN 0 THEN 'royal house' WHEN 1 THEN 'royal' WHEN 2 THEN 'x' WHEN 3 THEN 'film award' WHEN 4 THEN 'war faction' ELSE 'civil_conflict' END) AS segment,
 CASE CAST(c_custkey%6 AS INT) WHEN 1 THEN 'person' WHEN 5 THEN 'event' ELSE CASE WHEN c_mktsegment='AUTOMOBILE' THEN 'artifact'
   WHEN c_custkey%6=0 THEN 'pol_mil_organization' WHEN c_custkey%6=4 THEN 'pol_mil_organization' WHEN c_mktsegment='BUILDING' THEN 'place' ELSE 'other' END END AS category FROM customer)""")
def type_categories(spark, sf):
    """Ordered category words with their exceptions."""
    tail = F.element_at(F.array(*[F.lit(x) for x in ["royal house", "royal", "x", "film award", "war faction", "civil_conflict"]]),
                        (F.col("c_custkey") % 6 + 1).cast("int"))
    df = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("page_id"), F.concat("c_mktsegment", F.lit(" "), tail).alias("segment"))
    return df.withColumn("category", C.category_of(F.col("segment")))


@query("primary_type", _with("SELECT page_id, infobox_type, category FROM n WHERE t IN (0,1,2,4)"))
def primary_type(spark, sf):
    df = typed(spark, sf).withColumn("infobox_type", C.primary_type(F.col("types"), C.DEFAULT_TYPES))
    return df.filter("infobox_type IS NOT NULL").select("page_id", "infobox_type", C.category_of(F.col("infobox_type")).alias("category"))


@query("infobox_fields", _with("""
SELECT page_id, 0 AS n, CASE t WHEN 0 THEN 'birth_date' WHEN 1 THEN 'date' WHEN 2 THEN 'founded' WHEN 3 THEN 'launched' WHEN 4 THEN 'birth_date' ELSE 'released' END AS key, expr AS value FROM n
UNION ALL SELECT page_id, 1, 'coordinates', concat('{{coord|',CAST(i%90 AS STRING),'|',CAST(i%60 AS STRING),CASE WHEN i%2=0 THEN '|N|' ELSE '|S|' END,CAST(i%180 AS STRING),'|30|E|display=title}}') FROM n WHERE i%3<>0"""))
def infobox_fields(spark, sf):
    """Depth-one fields of balanced templates, in order."""
    df = v.wiki_pages(spark, sf).withColumn("t", X.page_templates(X.needs_templates(F.col("wikitext"))))
    return df.select("page_id", F.posexplode("t.fields").alias("n", "f")).select("page_id", "n", "f.key", "f.value")


@query("parse_dates", _with("""
SELECT page_id, expr AS expression, 'gregorian' AS calendar, y0 AS start_year, m AS start_month, d AS start_day, y1 AS end_year, m AS end_month, d AS end_day, unc AS uncertainty_years FROM n"""))
def parse_dates(spark, sf):
    """The date value of each infobox, cut out by a line pattern."""
    value = F.regexp_extract("wikitext", r"\n\| [a-z_]+ = ([^\n]*)", 1)
    df = v.wiki_pages(spark, sf).select("page_id", dates.parse_date(value).alias("d"))
    return df.select("page_id", "d.*")


@query("calendar_and_style", """
SELECT doc_id, CASE WHEN regexp_matches(s,'hijri|ah\\b|هـ') THEN 'islamic' WHEN regexp_matches(s,'julian|os\\b') THEN 'julian' WHEN regexp_matches(s,'hebrew|am\\b') THEN 'hebrew' ELSE 'gregorian' END AS calendar,
 CASE WHEN regexp_matches(s,'\\bc\\.?\\s*\\d|\\bcirca\\b|\\bapprox') THEN 'circa' WHEN regexp_matches(s,'century|millennium') THEN 'century' WHEN regexp_matches(s,'\\d\\s*[-–—to]\\s*\\d') THEN 'range' WHEN regexp_matches(s,'\\d{3,4}') THEN 'exact' ELSE 'unknown' END AS style
FROM (SELECT doc_id, lower(text) AS s FROM documents)""")
def calendar_and_style(spark, sf):
    t = F.col("text")
    return v.texts(spark, sf).select("doc_id", dates.calendar(t).alias("calendar"), dates.style(t).alias("style"))


@query("uncertainty_table", """
SELECT p_partkey, CASE WHEN y>=50000 THEN 25000 WHEN y>=10000 THEN 5000 WHEN y>=3000 THEN 500 WHEN y>=1000 THEN 100 WHEN y>=500 THEN 50 ELSE 50 END AS century,
 CASE WHEN y>=50000 THEN 10000 WHEN y>=10000 THEN 2000 WHEN y>=3000 THEN 200 WHEN y>=1000 THEN 20 WHEN y>=500 THEN 5 ELSE 1 END AS exact
FROM (SELECT p_partkey, abs(CAST(p_partkey*37-20000 AS INT)) AS y FROM part)""")
def uncertainty_table(spark, sf):
    y = (F.col("p_partkey") * 37 - 20000).cast("int")
    return v.table(spark, sf, "part").select("p_partkey", dates.uncertainty(y, F.lit("century")).alias("century"),
                                             dates.uncertainty(y, F.lit("exact")).alias("exact"))


@query("page_coordinates", _with("SELECT page_id, lat, lng FROM n WHERE lat IS NOT NULL"))
def page_coordinates(spark, sf):
    none = F.array().cast("array<string>")
    df = v.wiki_pages(spark, sf).select("page_id", F.explode(coords.page_points(F.col("wikitext"), none)).alias("p"))
    return df.select("page_id", F.round("p.lat", 6).alias("lat"), "p.lng")


@query("coordinate_forms", """
SELECT s_suppkey, CASE WHEN s_suppkey%4=0 THEN 10.25 WHEN s_suppkey%4=1 THEN -20.5 WHEN s_suppkey%4=2 THEN round(-(30+15/60.0+36/3600.0),6) ELSE 45.125 END AS lat,
 CASE WHEN s_suppkey%4=0 THEN -11.75 WHEN s_suppkey%4=1 THEN 7.25 WHEN s_suppkey%4=2 THEN 100.5 ELSE -45.5 END AS lng FROM supplier""")
def coordinate_forms(spark, sf):
    """Module call, locator map, degree fields and plain fields."""
    i = F.col("s_suppkey") % 4
    text = (F.when(i == 0, "{{#Invoke:coordinates | coord |10.25|-11.75|type:city}} {{coord|99|5}}")
            .when(i == 1, "{{Location map+|World|places={{Location map~|World|lat=-20.5|long=7.25}} }} |lat=5|long=6\n")
            .when(i == 2, "|lat_deg=30|lat_min=15|lat_sec=36|latNS=S\n|lon_deg=100|long_min=30|longEW=E")
            .otherwise("| latitude = 45.125\n| longitude = -45.5\n"))
    df = v.table(spark, sf, "supplier").select("s_suppkey", F.concat(text, F.lit(" "), "s_name").alias("wikitext"))
    df = df.withColumn("t", X.page_templates(X.needs_templates(F.col("wikitext"))))
    maps = F.coalesce("t.maps", F.array().cast("array<string>"))
    df = df.select("s_suppkey", F.explode(coords.page_points(F.col("wikitext"), maps)).alias("p"))
    return df.select("s_suppkey", F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"))


@query("same_latitude_points", """
SELECT entry_id, lat, lng FROM v_locations l WHERE ordinal=0 OR NOT EXISTS (SELECT 1 FROM v_locations o WHERE o.entry_id=l.entry_id AND o.ordinal<l.ordinal AND abs(o.lat-l.lat)<0.0001)""", ("v_locations",))
def same_latitude_points(spark, sf):
    """Later points on an earlier point's latitude drop out."""
    loc = v.locations(spark, sf).groupBy("entry_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "lat", "lng"))).alias("l"))
    points = F.transform("l", lambda x: F.struct(x["lat"].alias("lat"), x["lng"].alias("lng")))
    return loc.select("entry_id", F.explode(coords.distinct_points(points)).alias("p")).select("entry_id", "p.*")


@query("descriptions", _with("SELECT page_id, coalesce(trim(sentence)[1:200],'') AS description FROM p", True), ("v_wikitext",))
def descriptions(spark, sf):
    return v.wiki_pages(spark, sf).select("page_id", description(F.col("wikitext"), 150, 200).alias("description"))


@query("slugs", """
SELECT id, regexp_replace(regexp_replace(lower(title),'[^a-z0-9]+','-','g'),'^-|-$','','g') AS slug FROM (SELECT id, concat('¡',title,'! (',description,')') AS title FROM v_entries)""", ("v_entries",))
def slugs(spark, sf):
    t = F.concat(F.lit("¡"), "title", F.lit("! ("), "description", F.lit(")"))
    return v.entries(spark, sf).select("id", slug(t).alias("slug"))


@query("slug_suffixes", """
SELECT l_orderkey, seq, concat(s, repeat('-x', CAST(row_number() OVER (PARTITION BY l_orderkey, s ORDER BY seq)-1 AS INT))) AS slug FROM (
 SELECT l_orderkey, lower(concat(l_returnflag,'-',l_linestatus)) AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS seq FROM lineitem)""")
def slug_suffixes(spark, sf):
    """Repeated headings of one article get -x, -x-x and so on."""
    li = v.table(spark, sf, "lineitem")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    df = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("r"))
    s = F.transform("r", lambda x: slug(F.concat(x["l_returnflag"], F.lit(" "), x["l_linestatus"])))
    return df.select("l_orderkey", F.posexplode(with_suffixes(s)).alias("seq", "slug")).withColumn("seq", F.col("seq").cast("long") + 1)


@query("extract_entries", _with("""
SELECT concat('doc-',CAST(n.page_id AS STRING)) AS id, y0 AS start_year, m AS start_month, d AS start_day, y1 AS end_year, m AS end_month, d AS end_day, expr AS start_expr, 'gregorian' AS calendar, unc AS uncertainty_years,
 category, infobox_type, coalesce(trim(sentence)[1:200],'') AS description, CASE WHEN lat IS NULL THEN 'no-coords-found' ELSE '' END AS tags, lat, lng FROM n JOIN p ON p.page_id=n.page_id WHERE t IN (0,1,2,4)""", True), ("v_wikitext",))
def extract_entries(spark, sf):
    """The whole page job: types, category, points, dates, description."""
    e = X.extract_entries(X.judge_pages(v.wiki_pages(spark, sf)), 150, 200)
    p = F.get("locations", F.lit(0))
    return e.select("id", "start_year", "start_month", "start_day", "end_year", "end_month", "end_day", "start_expr", "calendar",
                    "uncertainty_years", "category", "infobox_type", "description", F.array_join("tags", ",").alias("tags"),
                    F.round(p["lat"], 6).alias("lat"), p["lng"].alias("lng"))


RULES = X.IngestRules(exclude_categories=["place"], require_points=True, date_after=-800, date_before=1850, max_start_year={"person": 1700})
JUDGED = _with("""
SELECT page_id, infobox_type, category, CASE WHEN category='place' THEN 'category' WHEN lat IS NULL THEN 'no coordinates' WHEN y0<-800 THEN 'before range' WHEN y0>1850 THEN 'after range'
 WHEN infobox_type='person' AND y0>1700 THEN 'over year cap' END AS reject_reason FROM n WHERE t IN (0,1,2,4)""")


@query("ingest_filters", JUDGED)
def ingest_filters(spark, sf):
    return X.judge_pages(v.wiki_pages(spark, sf), RULES).select("page_id", "infobox_type", "category", "reject_reason")


@query("ingest_counts", f"""
WITH c AS (SELECT unnest(['person','event','place','artifact','pol_mil_organization','business','historical_period','concepts','other']) AS category)
SELECT c.category, count(j.page_id) AS considered, count(CASE WHEN j.page_id IS NOT NULL AND reject_reason IS NULL THEN 1 END) AS collected, count(reject_reason) AS rejected
FROM c LEFT JOIN ({JUDGED}) j ON j.category=c.category GROUP BY c.category""")
def ingest_counts(spark, sf):
    return C.ingest_counts(X.judge_pages(v.wiki_pages(spark, sf), RULES))


@query("infobox_catalog", _with("""
SELECT infobox_type, category AS proposed_category, count(*) AS count, infobox_type NOT IN ('ship_begin','album') AS was_included, infobox_type NOT IN ('ship_begin','album') AS include_in_future FROM n GROUP BY ALL"""))
def infobox_catalog(spark, sf):
    return C.roll_up(v.wiki_pages(spark, sf), C.DEFAULT_TYPES)


@query("catalog_categories", _with("SELECT category AS proposed_category, count(DISTINCT infobox_type) AS n FROM n GROUP BY category"))
def catalog_categories(spark, sf):
    return C.category_counts(C.recategorise(C.roll_up(v.wiki_pages(spark, sf), C.DEFAULT_TYPES)))


@query("coordinate_signals", """
WITH f AS (SELECT regexp_matches(wikitext,'(?i)\\{\\{\\s*coord') a, regexp_matches(wikitext,'(?i)\\|\\s*coordinates\\s*=') b, (page_id%3<>0) e,
 regexp_matches(wikitext,'(?i)\\{\\{\\s*location\\s*map|\\|\\s*lat[_ ]?d\\s*=|\\|\\s*long?[_ ]?d\\s*=|\\|\\s*lat_?deg\\s*=|\\|\\s*lo(?:n|ng)_?deg\\s*=|\\|\\s*latitude\\s*=|\\|\\s*longitude\\s*=|\\|\\s*lat\\s*=\\s*-?[\\d.]|\\|\\s*long?\\s*=\\s*-?[\\d.]|\\|\\s*(?:image[_ ]?map|map[_ ]?image|map)\\s*=.*\\.svg|\\{\\{\\s*geo|class\\s*=\\s*\\"geo\\"') o FROM v_wikitext),
s AS (SELECT count(*) AS c, count(*) FILTER (a) AS na, count(*) FILTER (b) AS nb, count(*) FILTER (e) AS ne, count(*) FILTER (NOT (a OR b OR o)) AS nn FROM f)
SELECT signal, n, n*100/CAST(c AS DOUBLE) AS percent FROM (SELECT 'coord-template' AS signal, na AS n, c FROM s UNION ALL SELECT 'coordinates-field', nb, c FROM s UNION ALL SELECT 'extracted-now', ne, c FROM s UNION ALL SELECT 'NONE', nn, c FROM s
 UNION ALL SELECT unnest(['location-map','latd/longd','lat_deg/lon_deg','latitude/longitude','lat/long-plain','map-image/svg','geo-microformat']), 0, c FROM s)""", ("v_wikitext",))
def coordinate_signals(spark, sf):
    none = F.array().cast("array<string>")
    df = v.wiki_pages(spark, sf).select("wikitext", (F.size(coords.page_points(F.col("wikitext"), none)) > 0).alias("has_points"))
    return C.signal_tally(df)


@query("entity_decode", """
SELECT page_id, md5(replace(replace(replace(replace(replace(html,'&amp;','&'),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&apos;','''')) AS h FROM pages""")
def entity_decode(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", F.md5(decode_entities(F.col("html"))).alias("h"))


@query("field_escape", """
SELECT doc_id, md5(replace(replace(replace(text,chr(9),'\\t'),chr(10),'\\n'),chr(13),'')) AS escaped, true AS same_again FROM documents""")
def field_escape(spark, sf):
    t = F.col("text")
    e = escape_field(t)
    return v.texts(spark, sf).select("doc_id", F.md5(e).alias("escaped"),
                                                  (unescape_field(e) == F.replace(t, F.lit("\r"), F.lit(""))).alias("same_again"))
