"""Queries that write the derived tables in a file format and read them back."""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from chronofold.operators import catalog as C, routes as J, spatial as sp
from chronofold.operators.facts import as_entries, merge_by_id
from chronofold.plans import fixtures as v
from chronofold.plans.places import shapes
from chronofold.plans.registry import query
from chronofold.runtime import cut, shared_path
from chronofold.sources import dump, files, sinks

# Rows of the longest document up to which one task sorts it.
SORTED_BY_ONE = 200_000


def written(spark, df, label):
    path = shared_path(spark, label)
    df.write.text(path)
    return path


@query("index_scan", """SELECT CAST(floor(doc_id/100)*650+17 AS BIGINT) AS "offset", doc_id AS article_id, concat('Doc: ',CAST(doc_id AS STRING)) AS title FROM documents WHERE doc_id%9<>4""")
def index_scan(spark, sf):
    i = F.col("doc_id")
    line = F.when(i % 9 == 4, F.concat(F.lit("bad line "), i.cast("string"))).otherwise(F.concat(
        (F.floor(i / 100) * 650 + 17).cast("string"), F.lit(":"), i.cast("string"), F.lit(":Doc: "), i.cast("string")))
    path = written(spark, v.table(spark, sf, "documents").select(line.alias("value")), "index")
    return dump.read_index(spark, path).select("offset", "article_id", "title")


def stored(spark, sf):
    e = v.entries_with_tags(spark, sf)
    i = F.col("id")
    loc = F.when(i % 4 == 0, F.lit("[]")).when(i % 4 == 1, F.lit('[{"type":"circle","centerLat":5.5,"centerLng":6.5,"radiusKm":20,"label":"a"}]')).when(
        i % 4 == 2, F.lit('[{"type":"point","lat":1.5,"lng":2.5},{"type":"path","waypoints":[{"lat":1,"lng":2,"t":0.5,"label":"x"},{"lat":3,"lng":4}]}]')).otherwise(
        F.lit('[{"type":"polygon","rings":[[[0,0],[4,0],[4,4],[0,0]]],"uncertain":true}]'))
    from chronofold.schema import LOCATIONS
    zero = F.lit(0)
    return e.select(F.col("slug").alias("id"), F.concat("title", F.lit("\tx\ny")).alias("title"), F.from_json(loc, LOCATIONS).alias("locations"),
                    "start_year", zero.alias("start_month"), zero.alias("start_day"), "end_year", zero.alias("end_month"), zero.alias("end_day"),
                    F.lit("a \"b\"").alias("start_expr"), F.lit(" ").alias("end_expr"), F.when(i % 3 == 0, "").otherwise("julian").alias("calendar"),
                    F.lit(20).alias("uncertainty_years"), F.when(F.col("category") == "concepts", "invention").otherwise(F.col("category")).alias("category"),
                    F.lit("").alias("infobox_type"), "description", "tags")


@query("entry_file", """
SELECT slug, concat(title,chr(9),'x',chr(10),'y') AS title, start_year, end_year, CASE WHEN id%3=0 THEN 'gregorian' ELSE 'julian' END AS calendar, 20.0::DOUBLE AS uncertainty_years,
 CASE WHEN category='concepts' THEN 'other' ELSE category END AS category, description, tag AS tags, CAST(CASE id%4 WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS INT) AS n_locations FROM v_entries""", ("v_entries",))
def entry_file(spark, sf):
    """Entries written as 17-column text and read back."""
    path = shared_path(spark, "entries-tsv")
    sinks.write_entries(stored(spark, sf), path)
    e = files.read_entries(spark, path)
    return e.select("slug", "title", "start_year", "end_year", "calendar", "uncertainty_years", "category", "description",
                    F.array_join("tags", ",").alias("tags"), F.size("locations").alias("n_locations"))


@query("entry_file_rules", """
SELECT concat('o-',CAST(o_orderkey AS STRING)) AS slug, CAST(CASE o_orderkey%8 WHEN 0 THEN 12 ELSE o_orderkey%3000 END AS INT) AS start_year, CASE WHEN o_orderkey%8=5 THEN 0 ELSE 1 END AS n_tags FROM orders WHERE o_orderkey%8 IN (0,4,5,6,7)""")
def entry_file_rules(spark, sf):
    """Lines that break a rule drop out; a number may be followed by text."""
    i = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    year = F.when(i % 8 == 0, "12th").when(i % 8 == 1, "unknown").otherwise(s(i % 3000))
    loc = F.when(i % 8 == 2, '{"type":"point"}').when(i % 8 == 3, "[{").otherwise("[]")
    tags = F.when(i % 8 == 5, "[oops").otherwise('["t"]')
    line = F.concat_ws("\t", F.concat(F.lit("o-"), s(i)), F.lit("t"), loc, year, F.lit("0"), F.lit("0"), s(i % 3000 + 5), F.lit("0"), F.lit("0"),
                       F.lit("a"), F.lit("b"), F.lit(""), F.lit("x"), F.lit("event"), F.lit(""), F.lit("d"), tags)
    path = written(spark, v.table(spark, sf, "orders").select(line.alias("value")), "lines")
    return files.read_entries(spark, path).select("slug", "start_year", F.size("tags").alias("n_tags"))


@query("entry_union", """
SELECT slug, category, CASE WHEN part=1 THEN 'Source' ELSE '' END AS citation_label FROM (SELECT slug, CASE WHEN category='concepts' THEN 'other' ELSE category END AS category, 0 AS part FROM v_entries
 UNION ALL SELECT concat('extra-',CAST(id AS STRING)), 'event', 1 FROM v_entries)""", ("v_entries",))
def entry_union(spark, sf):
    """Entry text and entry documents together, a blank citation where none is given."""
    path = shared_path(spark, "entries-tsv")
    sinks.write_entries(stored(spark, sf), path)
    i = F.col("id")
    doc = F.concat(F.lit('[{"slug":"extra-'), i.cast("string"), F.lit('","title":"E","startYear":1,"endYear":2,"category":"event","tags":["x"],"citationUrl":"u","citationLabel":"Source","locations":[]}]'))
    extra = written(spark, v.entries(spark, sf).select(doc.alias("value")), "extra")
    docs = files.parse_entry_documents(spark.read.schema(files.ENTRY_DOCUMENTS).json(extra))
    both = files.all_entries([files.read_entries(spark, path), docs])
    return both.select("slug", "category", "citation_label")


@query("normalised_load", """
SELECT slug, CAST(ordinal AS INT) AS ordinal, kind, lng, lat, radius_km, n_vertices FROM (SELECT slug, id FROM v_entries) e JOIN (
 SELECT 1 AS k, 0 AS ordinal, 'circle' AS kind, 6.5::DOUBLE AS lng, 5.5::DOUBLE AS lat, 20.0::DOUBLE AS radius_km, NULL AS n_vertices UNION ALL SELECT 2, 0, 'point', 2.5, 1.5, NULL, NULL
 UNION ALL SELECT 2, 1, 'path', NULL, NULL, NULL, 2 UNION ALL SELECT 3, 0, 'polygon', NULL, NULL, NULL, 4) l ON e.id%4=l.k""", ("v_entries",))
def normalised_load(spark, sf):
    """Entry and location tables written, read back and joined by id."""
    path = shared_path(spark, "tables")
    sinks.load_tables(stored(spark, sf).withColumnRenamed("id", "slug"), path)
    e, loc = spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/locations")
    n = F.when(F.col("kind") == "path", F.size("waypoints")).when(F.col("kind") == "polygon", F.size(F.get(F.get("polygons", F.lit(0)), F.lit(0))))
    return loc.join(e.select(F.col("id").alias("entry_id"), "slug"), "entry_id").select("slug", "ordinal", "kind", "lng", "lat", "radius_km", n.alias("n_vertices"))


def long_documents(spark, rows, head, tail, label, between=","):
    """A JSON document over many lines for each value of doc: head, the records (value) in the order of seq, tail.

    opening: what begins a group of records, before its first one; between stands between groups.
    """
    first = cut(rows.groupBy("doc").agg(F.min("seq").alias("first"), F.count("*").alias("n")), f"{label}-first")
    longest = first.agg(F.max("n")).first()[0] or 0
    first = first.drop("n")
    opening = F.col("opening") if "opening" in rows.columns else F.lit(None).cast("string")
    head = F.lit(head) if isinstance(head, str) else head
    begins = F.concat(F.when(F.col("seq") == F.col("first"), head).when(opening.isNotNull(), between).otherwise(","), F.coalesce(opening, F.lit("")))
    lines = rows.join(F.broadcast(first), "doc").select("doc", F.lit(0).alias("end"), "seq", F.concat(begins, "value").alias("value"))
    ends = first.select("doc", F.lit(1), "first", F.lit(tail))
    lines, path = lines.unionAll(ends), shared_path(spark, label)
    if longest > SORTED_BY_ONE:
        return long_files(spark, lines, path, label)
    lines.repartition("doc").sortWithinPartitions("doc", "end", "seq").select("value").write.text(path)
    return path


def long_files(spark, lines, path, label):
    """A file for each doc in the order of (end, seq).  A file has one writer; sorted by it, a document would have to fit its memory.  So
    many tasks sort, and the writer of a file copies their parts one behind the other."""
    parts = shared_path(spark, f"{label}-parts")
    lines.repartitionByRange("doc", "end", "seq").sortWithinPartitions("doc", "end", "seq").select("doc", "value").write.parquet(parts)
    read = spark.read.schema(lines.select("doc", "value").schema)
    docs = {}  # a row for each part and document
    for r in sorted(read.parquet(parts).select("doc", F.col("_metadata.file_name").alias("part")).distinct().collect(), key=lambda r: r.part):
        docs.setdefault(r.doc, []).append(r.part)

    def copy(numbered):
        n, (doc, names) = numbered
        inside = [read.parquet(f"{parts}/{name}").filter(F.col("doc").eqNullSafe(F.lit(doc))).select("value") for name in names]
        reduce(DataFrame.unionAll, inside).coalesce(1).write.text(f"{path}/{n}")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(copy, enumerate(docs.items())))
    return f"{path}/*"


def feature_line(ring):
    return F.concat(F.lit("[["), F.array_join(F.transform(ring, lambda p: F.concat(
        F.lit("["), p["lng"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit("]"))), ","), F.lit("]]"))


@query("boundary_features", """
SELECT concat('realm-',CASE WHEN k*100-1000<0 THEN concat('bce',CAST(1000-k*100 AS STRING)) ELSE CAST(k*100-1000 AS STRING) END,'-',CASE WHEN k*100-850<0 THEN concat('bce',CAST(850-k*100 AS STRING)) ELSE CAST(k*100-850 AS STRING) END) AS slug,
 k*100-1000 AS start_year, CASE WHEN k*100-1000<0 THEN concat(CAST(1000-k*100 AS STRING),' BCE') ELSE concat(CAST(k*100-1000 AS STRING),' CE') END AS start_expr,
 concat('The extent from ',CASE WHEN k*100-1000<0 THEN concat(CAST(1000-k*100 AS STRING),' BCE') ELSE concat(CAST(k*100-1000 AS STRING),' CE') END,' to ',CASE WHEN k*100-850<0 THEN concat(CAST(850-k*100 AS STRING),' BCE') ELSE concat(CAST(k*100-850 AS STRING),' CE') END,
  '. Approximate area: ',CASE WHEN k=0 THEN '1,235' ELSE concat(CAST(k AS STRING),',001,235') END,' km².',CASE WHEN k%2=0 THEN ' See also Wikipedia: "Realm".' ELSE '' END) AS description, 1 AS n_polygons, 6 AS n_vertices
FROM (SELECT c_custkey AS n, CAST(c_custkey%40 AS INT) AS k FROM customer WHERE c_custkey%40%3<>1)""")
def boundary_features(spark, sf):
    """Features one to a line, of one name, as boundary entries."""
    k = (F.col("ordinal") % 40).cast("int")
    line = F.concat(
        F.lit('{ "type": "Feature", "properties": { "Name": "'), F.when(k % 3 == 1, "Other").otherwise("Realm"), F.lit('", "FromYear": '), (k * 100 - 1000).cast("string"),
        F.lit('.0, "ToYear": '), (k * 100 - 850).cast("string"), F.lit(', "Area": '), (k * 1000000 + 1234).cast("string"), F.lit('.56'),
        F.when(k % 2 == 0, ', "Wikipedia": "Realm"').otherwise(""), F.lit(' }, "geometry": { "type": '),
        F.when(k % 2 == 0, F.concat(F.lit('"Polygon", "coordinates": '), feature_line(F.get("rings", F.lit(0)))))
        .otherwise(F.concat(F.lit('"MultiPolygon", "coordinates": ['), feature_line(F.get("rings", F.lit(0))), F.lit("]"))), F.lit(" } },"))
    path = written(spark, shapes(spark, sf).select(line.alias("value")), "features")
    b = files.boundary_entries(files.read_feature_lines(spark, path, "Realm"), "realm", "https://example.org", "Example", "boundary", "The extent")
    return b.select("slug", "start_year", "start_expr", "description", F.size("polygons").alias("n_polygons"),
                    F.size(F.get(F.get("polygons", F.lit(0)), F.lit(0))).alias("n_vertices"))


@query("laneset_file", """
SELECT CAST(c_nationkey AS STRING) AS laneset_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)-1 AS INT) AS ordinal, concat('shape-',CAST(c_custkey AS STRING)) AS slug, 1 AS n_sources, 6 AS n_vertices FROM customer""")
def laneset_file(spark, sf):
    """Long documents of several lanesets each; lanes in document order."""
    lane = F.concat(F.lit('{"id":"'), F.col("slug"), F.lit('","name":"n","description":"d","geometry":['), feature_line(F.get("rings", F.lit(0))),
                    F.lit('],"bbox":[0,0,1,1],"eraSources":["rome-history"]}'))
    rows = shapes(spark, sf).select((F.col("laneset_id") % 3).alias("doc"), "laneset_id", F.struct("laneset_id", "ordinal").alias("seq"), lane.alias("value"))
    opening = rows.groupBy("laneset_id").agg(F.min("seq").alias("seq")).withColumn("opens", F.lit(True))
    begun = F.concat(F.lit('{"id":"'), F.col("laneset_id").cast("string"), F.lit('","name":"x","description":"y","lanes":['))
    rows = rows.join(F.broadcast(opening), ["laneset_id", "seq"], "left")
    path = long_documents(spark, rows.select("doc", "seq", "value", F.when(F.col("opens"), begun).alias("opening")), '{"lanesets":[', "]}]}", "lanesets", between="]},")
    sets, lanes = files.read_lanesets(spark, path)
    lanes = lanes.join(F.broadcast(sets.select("laneset_id", "name")), "laneset_id")
    return lanes.select("laneset_id", "ordinal", "slug", F.size("era_sources").alias("n_sources"),
                        F.size(F.get(F.get("polygons", F.lit(0)), F.lit(0))).alias("n_vertices"))


@query("country_file", """
SELECT CASE WHEN c_custkey%2=0 THEN 'Asia' ELSE 'Africa' END AS continent, concat('sub ',CAST(c_custkey AS STRING)) AS subregion, CASE WHEN c_custkey%5=1 THEN 2 ELSE 1 END AS n_polygons FROM customer WHERE c_custkey%7<>3""")
def country_file(spark, sf):
    """Features of both kinds; what the file calls open ocean is no country."""
    k = F.col("ordinal")
    ring = feature_line(F.get("rings", F.lit(0)))
    f = F.concat(F.lit('{"type":"Feature","properties":{"CONTINENT":"'), F.when(k % 7 == 3, files.OPEN_OCEAN).when(k % 2 == 0, "Asia").otherwise("Africa"),
                 F.lit('","SUBREGION":"sub '), k.cast("string"), F.lit('"},"geometry":{"type":'), F.when(k % 5 == 1, F.concat(
                     F.lit('"MultiPolygon","coordinates":['), ring, F.lit(","), ring, F.lit("]"))).otherwise(F.concat(F.lit('"Polygon","coordinates":'), ring)), F.lit("}}"))
    rows = shapes(spark, sf).select((k % 2).alias("doc"), k.alias("seq"), f.alias("value"))
    c = files.read_countries(spark, long_documents(spark, rows, '{"type":"FeatureCollection","bbox":[0,1],"features":[', "]}", "countries"))
    return c.select("continent", "subregion", F.size("polygons").alias("n_polygons"))


@query("map_elements", """
SELECT 'node' AS kind, p_partkey AS id, CAST(p_partkey%180-90 AS DOUBLE) AS lat, CAST(NULL AS BIGINT) AS n FROM part UNION ALL SELECT 'way', s_suppkey, NULL, 3 FROM supplier UNION ALL SELECT 'member', n_nationkey+1, NULL, n_regionkey FROM nation""")
def map_elements(spark, sf):
    """Two documents with every element; each counts once."""
    s = lambda c: F.col(c).cast("string")
    n = v.table(spark, sf, "part").select(F.concat(F.lit('{"type":"node","id":'), s("p_partkey"), F.lit(',"lat":'), (F.col("p_partkey") % 180 - 90).cast("string"), F.lit(',"lon":1}')).alias("e"))
    w = v.table(spark, sf, "supplier").select(F.concat(F.lit('{"type":"way","id":'), s("s_suppkey"), F.lit(',"nodes":[1,2,3]}')).alias("e"))
    r = v.table(spark, sf, "nation").select(F.concat(F.lit('{"type":"relation","id":'), (F.col("n_nationkey") + 1).cast("string"), F.lit(',"members":[{"type":"relation","ref":'), s("n_regionkey"), F.lit("}]}")).alias("e"))
    e = n.unionAll(w).unionAll(r)
    rows = e.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("doc"), F.col("e").alias("seq"), F.col("e").alias("value"))
    nodes, ways, members = files.read_map_elements(spark, long_documents(spark, rows, '{"version":0.6,"elements":[', "]}", "elements"))
    null = F.lit(None)
    return nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), "lat", null.cast("long").alias("n")).unionAll(
        ways.select(F.lit("way"), "way_id", null.cast("double"), F.size("nodes").cast("long"))).unionAll(
        members.select(F.lit("member"), "parent", null.cast("double"), "child"))


@query("query_results", """
SELECT concat('Q',CAST(id AS STRING)) AS id, CASE WHEN id%3=0 THEN concat('Q',CAST(id AS STRING)) ELSE title END AS title, start_year, 5 AS start_month, 0 AS start_day, 'wikidata:Q5' AS infobox_type, CASE WHEN id%2=0 THEN 1 ELSE 0 END AS n_points
FROM v_entries WHERE id%11<>0""", ("v_entries",))
def query_results(spark, sf):
    """Query-result documents to entries; a row whose item is no item drops out."""
    i = F.col("id")
    time = F.concat(F.when(F.col("start_year") < 0, "-").otherwise(""), F.lpad(F.abs("start_year").cast("string"), 4, "0"), F.lit("-05-17T00:00:00Z"))
    pair = lambda n, c: F.concat(F.lit(f'"{n}":{{"value":"'), c, F.lit('"}'))
    b = F.concat(F.lit("{"), F.concat_ws(",", pair("item", F.concat(F.lit("http://www.wikidata.org/entity/"), F.when(i % 11 == 0, "L").otherwise("Q"), i.cast("string"))),
                 F.when(i % 3 != 0, pair("itemLabel", F.col("title"))), pair("matchedCategory", F.lit("person")), pair("date", time), pair("datePrecision", F.lit("10")),
                 F.when(i % 2 == 0, pair("coord", F.lit("POINT(1.5 2.5)"))), pair("wikipediaTitle", F.lit("W"))), F.lit("}"))
    rows = v.entries(spark, sf).select((i % 3).alias("doc"), i.alias("seq"), b.alias("value"))
    path = long_documents(spark, rows, '{"head":{"vars":["item","date"]},"results":{"bindings":[', "]}}", "bindings")
    e = merge_by_id(as_entries(files.bindings_as_facts(files.read_bindings(spark, path))), ["start_year"])
    return e.select("id", "title", "start_year", "start_month", "start_day", "infobox_type", F.size("locations").alias("n_points"))


@query("document_lists", """
SELECT CAST(event_id AS STRING) AS id, event_type AS category, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events""")
def document_lists(spark, sf):
    """Records in JSON lists, each kept whole beside its key."""
    e = v.table(spark, sf, "events")
    rec = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("category"), F.from_json("props", "k long").alias("p")))
    rows = e.select((F.col("event_id") % 4).alias("doc"), F.col("event_id").alias("seq"), rec.alias("value"))
    d = files.read_record_lists(spark, long_documents(spark, rows, "[", "]", "documents"))
    return d.select("id", "category", F.variant_get("data", "$.p.k", "bigint").alias("k"))


@query("document_members", """
SELECT CAST(event_id AS STRING) AS id, CAST(i AS INT) AS pos, CASE i WHEN 0 THEN event_type WHEN 1 THEN 'a}b' ELSE 'u' || user_id END AS tag FROM events JOIN (SELECT unnest([0,1,2]) AS i) ON i < 1 + event_id % 3""")
def document_members(spark, sf):
    """The members of an array inside each record of a list, by the variant type."""
    e = v.table(spark, sf, "events")
    tags = F.slice(F.array("event_type", F.lit("a}b"), F.concat(F.lit("u"), F.col("user_id").cast("string"))), F.lit(1), (1 + F.col("event_id") % 3).cast("int"))
    rec = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), tags.alias("tags")))
    rows = e.select((F.col("event_id") % 2).alias("doc"), F.col("event_id").alias("seq"), rec.alias("value"))
    d = files.read_record_lists(spark, long_documents(spark, rows, "[", "]", "members"))
    return files.record_members(d, "$.tags").select("id", "pos", F.variant_get("value", "$", "string").alias("tag"))


@query("json_paths", """
SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k, concat('{"id":',CAST(event_id AS STRING),',"tags":["',event_type,'"]}') AS row_json FROM events""")
def json_paths(spark, sf):
    """Path into a document, and a row as a document, by the variant type."""
    e = v.table(spark, sf, "events")
    return e.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"),
                    F.to_json(F.struct(F.col("event_id").alias("id"), F.array("event_type").alias("tags"))).alias("row_json"))


@query("catalog_file", """
SELECT p_type AS infobox_type, count(*) AS count, p_type='ECONOMY' AS include_in_future FROM part GROUP BY p_type""")
def catalog_file(spark, sf):
    """The catalog written, read back and turned into the list of types to take in."""
    c = v.table(spark, sf, "part").groupBy(F.col("p_type").alias("infobox_type")).agg(F.count(F.lit(1)).alias("count"))
    c = C.recategorise(c).withColumns({"was_included": F.lit(True), "include_in_future": F.col("infobox_type") == "ECONOMY"})
    path = shared_path(spark, "catalog")
    sinks.write_catalog(c, path)
    back = files.read_catalog(spark, path)
    types = files.types_from_file(spark, path)
    return back.select("infobox_type", "count", F.col("infobox_type").isin(*types).alias("include_in_future"))


@query("catalog_split", """
SELECT c_mktsegment AS infobox_type, count(*) AS count, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'artifact' WHEN 'BUILDING' THEN 'place' ELSE 'other' END AS proposed_category FROM customer GROUP BY c_mktsegment HAVING count(*)>1""")
def catalog_split(spark, sf):
    """One folder per category; types seen once are left out."""
    c = v.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("t")).unionAll(v.table(spark, sf, "nation").select("n_name"))
    c = c.groupBy(F.col("t").alias("infobox_type")).agg(F.count(F.lit(1)).alias("count"))
    c = C.recategorise(c).withColumns({"was_included": F.lit(True), "include_in_future": F.lit(False)})
    path = shared_path(spark, "catalog-split")
    sinks.write_split_catalog(c, path)
    return spark.read.options(sep="\t", header=True).csv(path).select("infobox_type", F.col("count").cast("long").alias("count"), "proposed_category")


@query("waypoint_file", """
SELECT path_id, number, label, row_number() OVER (PARTITION BY path_id ORDER BY number, k)-1 AS seq, lng FROM (
 SELECT CAST(c_nationkey AS STRING) AS path_id, c_custkey AS k, CAST(c_custkey%20 AS INT) AS number, c_name AS label, CAST(c_custkey%60*3 AS DOUBLE) AS lng FROM customer WHERE c_custkey%4<>0)""")
def waypoint_file(spark, sf):
    """Point features of a route per document, the numbered ones kept in order."""
    k = F.col("c_custkey")
    f = F.concat(F.lit('{"properties":{"name":"'), F.when(k % 4 == 0, "Book ").otherwise(F.concat(F.lit("#"), (k % 20).cast("string"), F.lit(" = "))), F.col("c_name"),
                 F.lit('","description":"d"},"geometry":{"type":"Point","coordinates":['), (k % 60 * 3).cast("string"), F.lit(',1]}}'))
    rows = v.table(spark, sf, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("seq"), f.alias("value"),
                                                 F.concat(F.lit('{"path_id":"'), F.col("c_nationkey").cast("string"), F.lit('","features":[')).alias("head"))
    path = long_documents(spark, rows, F.col("head"), "]}", "waypoints")
    return J.numbered_waypoints(files.read_waypoint_features(spark, path)).select("path_id", "number", "label", "seq", "lng")
