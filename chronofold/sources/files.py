"""Text and JSON files of entries, boundaries, lanes, networks and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chronofold.functions.text import WS, leading_int, trim_all, unescape_field
from chronofold.functions.years import year_label
from chronofold.operators.catalog import DEFAULT_TYPES
from chronofold.operators.extract import IngestRules
from chronofold.operators.spatial import to_rings
from chronofold.runtime import keep_if
from chronofold.schema import CATEGORIES, LOCATIONS
from chronofold.sources.json_records import read_documents


# -- entries ----------------------------------------------------------------

def parse_entries(lines: DataFrame) -> DataFrame:
    """Entries of 17-column lines (column value).

    Lines with fewer than 16 columns, without whole start and end years or without
    a JSON list of locations are left out (the header among them).
    """
    df = lines.select(F.split(trim_all(F.col("value")), "\t").alias("c"))
    at = lambda i: F.get("c", F.lit(i))
    text = lambda i: unescape_field(F.coalesce(at(i), F.lit("")))
    number = {n: leading_int(at(i)) for i, n in enumerate(
        ("start_year", "start_month", "start_day", "end_year", "end_month", "end_day"), 3)}
    no_tags = F.array().cast("array<string>")
    is_list = F.regexp_like(at(2), F.lit(rf"^{WS}*\[")) & F.try_parse_json(at(2)).isNotNull()
    # A plain filter would be pushed below the split and split a line again for each column it looks at.
    df = keep_if(df, F.size("c") >= 16).select("c", *[c.alias(n) for n, c in number.items()])
    df = keep_if(df, F.col("start_year").isNotNull() & F.col("end_year").isNotNull() & is_list)
    return df.select(
        text(0).alias("slug"), text(1).alias("title"), F.from_json(at(2), LOCATIONS).alias("locations"),
        *number, text(9).alias("start_expr"), text(10).alias("end_expr"),
        F.when(F.coalesce(at(11), F.lit("")) == "", "gregorian").otherwise(at(11)).alias("calendar"),
        F.coalesce(leading_int(at(12)), F.lit(0)).cast("double").alias("uncertainty_years"),
        F.when(at(13).isin(*CATEGORIES), at(13)).otherwise("other").alias("category"),
        text(14).alias("infobox_type"), text(15).alias("description"),
        F.coalesce(F.from_json(text(16), "array<string>"), no_tags).alias("tags"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return parse_entries(spark.read.text(path))


ENTRY_DOCUMENTS = (
    "slug string, title string, locations string, startYear int, startMonth int, startDay int, endYear int,"
    " endMonth int, endDay int, startExpr string, endExpr string, calendar string, uncertaintyYears double,"
    " category string, infoboxType string, description string, tags array<string>, citationUrl string,"
    " citationLabel string")


def read_entry_documents(spark: SparkSession, path: str) -> DataFrame:
    return parse_entry_documents(whole_json(spark, path, ENTRY_DOCUMENTS))


def parse_entry_documents(doc: DataFrame) -> DataFrame:
    """Entry objects of JSON lists, with their citation."""
    snake = lambda n: "".join("_" + ch.lower() if ch.isupper() else ch for ch in n)
    df = doc.select(*[F.col(n).alias(snake(n)) for n in doc.columns])
    return df.withColumn("locations", F.from_json("locations", LOCATIONS))


def all_entries(tables: list[DataFrame]) -> DataFrame:
    """Entry tables from every source; those without a citation get a blank one."""
    out = None
    for t in tables:
        for c in ("citation_url", "citation_label"):
            t = t.withColumn(c, F.coalesce(c, F.lit("")) if c in t.columns else F.lit(""))
        out = t if out is None else out.unionByName(t)
    return out


# -- boundaries and lanes ---------------------------------------------------

def as_multipolygon(kind: Column, coordinates: Column) -> Column:
    """Polygon or MultiPolygon JSON coordinates to array of rings; anything else is an error."""
    one = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    polygons = F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many).otherwise(
        F.raise_error(F.concat(F.lit("unexpected geometry: "), F.coalesce(kind, F.lit("none")))))
    return F.transform(polygons, to_rings)


def read_feature_lines(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(properties, kind, coordinates) of a file with one feature per line; with a
    name, only features called so.  Lines that are not features are passed over."""
    lines = spark.read.text(path).select(F.regexp_replace(trim_all(F.col("value")), r",\z", "").alias("line"))
    lines = lines.filter(F.regexp_like("line", F.lit(r'^\{\s*"type"\s*:\s*"Feature"[\s,]')))
    shape = "properties map<string,string>, geometry struct<type:string,coordinates:string>"
    df = lines.select(F.from_json("line", shape).alias("f"))
    df = df.select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))
    return df if name is None else df.filter(F.col("properties")["Name"] == name)


def boundary_entries(features: DataFrame, prefix: str, citation_url: str, citation_label: str, tag: str, about: str) -> DataFrame:
    """Boundary features (Name, FromYear, ToYear, Area, Wikipedia) as entries.

    `about` is the start of the description, before the years.
    """
    p = F.col("properties")
    number = lambda n: p[n].try_cast("double")
    start, end = number("FromYear").cast("int"), number("ToYear").cast("int")
    area = F.format_number(F.floor(number("Area") + 0.5), 0)
    mark = lambda y: F.when(y < 0, F.concat(F.lit("bce"), (-y).cast("string"))).otherwise(y.cast("string"))
    see = F.when(F.coalesce(p["Wikipedia"], F.lit("")) != "", F.concat(F.lit(' See also Wikipedia: "'), p["Wikipedia"], F.lit('".'))).otherwise("")
    zero = F.lit(0)
    return features.select(
        F.concat(F.lit(prefix + "-"), mark(start), F.lit("-"), mark(end)).alias("slug"),
        F.concat(p["Name"], F.lit(" ("), start.cast("string"), F.lit("–"), end.cast("string"), F.lit(")")).alias("title"),
        start.alias("start_year"), zero.alias("start_month"), zero.alias("start_day"),
        end.alias("end_year"), zero.alias("end_month"), zero.alias("end_day"),
        year_label(start).alias("start_expr"), year_label(end).alias("end_expr"), F.lit("gregorian").alias("calendar"),
        F.lit(0.0).alias("uncertainty_years"), F.lit("pol_mil_organization").alias("category"), F.lit("").alias("infobox_type"),
        F.concat(F.lit(about + " from "), year_label(start), F.lit(" to "), year_label(end), F.lit(". Approximate area: "), area,
                 F.lit(" km²."), see).alias("description"),
        F.array(F.lit(tag)).alias("tags"), F.lit(citation_url).alias("citation_url"), F.lit(citation_label).alias("citation_label"),
        as_multipolygon(F.col("kind"), F.col("coordinates")).alias("polygons"))


def array_members(spark: SparkSession, path: str, array: str, shape: str, keep: str | None = None) -> DataFrame:
    """(file, pos, m): the members of an array of JSON documents, read by many tasks however long a document is.

    array: the way to it, as "results.bindings"; shape: schema of a member, which stays text where there is none.  keep: a field of
    the document to carry along.
    """
    names = array.split(".") if array else []
    kind = "array<string>"
    for name in reversed(names[1:]):
        kind = f"struct<{name}:{kind}>"
    frame = (f"{names[0]} {kind}" + (f", {keep} string" if keep else "")) if names else kind
    docs = read_documents(spark, path, len(names) + 1)
    at = docs.arrays(frame, F.col(".".join(["d", *names])))
    found = docs.members_of(at.select("file", "array", *([F.col(f"d.{keep}").alias(keep)] if keep else [])))
    return found.select("file", *([keep] if keep else []), "pos", (F.from_json("text", shape) if shape else F.col("text")).alias("m"))


LANE = ("id string, name string, description string, geometry array<array<array<array<double>>>>, bbox array<double>, eraSources array<string>")
LANESETS = "lanesets array<struct<id:string,name:string,description:string,lanes:array<string>>>"
COUNTRY = "properties struct<CONTINENT:string,SUBREGION:string>, geometry struct<type:string,coordinates:string>"


def read_lanesets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lanesets, lanes) of laneset documents; both keep their order in the document."""
    docs = read_documents(spark, path, 4)
    sets = docs.frames.select("file", F.posexplode(F.from_json("text", LANESETS)["lanesets"]).alias("ordinal", "s"))
    lanes = docs.members_of(sets.select("file", F.get("s.lanes", F.lit(0)).alias("array"), F.col("s.id").alias("laneset_id")))
    lanes = lanes.select("laneset_id", F.col("pos").alias("ordinal"), F.from_json("text", LANE).alias("l"))
    return (sets.select(F.col("s.id").alias("laneset_id"), F.col("s.id").alias("slug"), "ordinal", "s.name", "s.description"),
            lanes.select("laneset_id", "ordinal", F.col("l.id").alias("slug"), "l.name", "l.description",
                         F.transform("l.geometry", to_rings).alias("polygons"), "l.bbox",
                         F.coalesce("l.eraSources", F.array().cast("array<string>")).alias("era_sources")))


# Fixed value: a feature of the country file that is no country.
OPEN_OCEAN = "Seven seas (open ocean)"


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """(source_order, continent, subregion, polygons) of country feature collections."""
    f = array_members(spark, path, "features", COUNTRY)
    f = f.select(F.col("pos").alias("source_order"), F.col("m.properties.CONTINENT").alias("continent"), F.col("m.properties.SUBREGION").alias("subregion"),
                 F.col("m.geometry.type").alias("kind"), F.col("m.geometry.coordinates").alias("coordinates"))
    return f.filter(F.coalesce("continent", F.lit("")) != OPEN_OCEAN).select(
        "source_order", "continent", "subregion", as_multipolygon(F.col("kind"), F.col("coordinates")).alias("polygons"))


WAYPOINT = "properties struct<name:string,description:string>, geometry struct<type:string,coordinates:array<double>>"


def read_waypoint_features(spark: SparkSession, path: str) -> DataFrame:
    """(path_id, pos, name, description, lng, lat) of point features: a path a document, known by its path_id or else by the file."""
    f = array_members(spark, path, "features", WAYPOINT, keep="path_id")
    at = lambda i: F.get("m.geometry.coordinates", F.lit(i))
    return f.select(F.coalesce("path_id", F.element_at(F.split("file", "/"), -1)).alias("path_id"), "pos", "m.properties.*", at(0).alias("lng"), at(1).alias("lat"))


# -- networks, facts, catalogs ----------------------------------------------

ELEMENT = "type string, id long, lat double, lon double, nodes array<long>, members array<struct<type:string,ref:long>>"
BINDING_NAMES = ["item", "itemLabel", "description", "matchedCategory", "date", "datePrecision", "coord", "wikipediaTitle"]
BINDING = ", ".join(f"{n} struct<value:string>" for n in BINDING_NAMES)


def read_map_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, relation members) of map-element documents, each id once."""
    e = array_members(spark, path, "elements", ELEMENT).select("m.*")
    nodes = e.filter("type = 'node'").select(F.col("id").alias("node_id"), "lat", F.col("lon").alias("lng")).dropDuplicates(["node_id"])
    ways = e.filter("type = 'way'").select(F.col("id").alias("way_id"), "nodes").dropDuplicates(["way_id"])
    members = e.filter("type = 'relation'").select("id", "members").dropDuplicates(["id"]).select(
        F.col("id").alias("parent"), F.explode("members").alias("m")).select("parent", "m.type", F.col("m.ref").alias("child"))
    return nodes, ways, members


def read_bindings(spark: SparkSession, path: str) -> DataFrame:
    """Rows of query-result documents, one string column per variable."""
    return array_members(spark, path, "results.bindings", BINDING).select(*[F.col(f"m.{n}.value").alias(n) for n in BINDING_NAMES])


def bindings_as_facts(bindings: DataFrame) -> DataFrame:
    """Bindings in the row shape of fact entries."""
    from chronofold.functions.coords import wkt_point
    from chronofold.operators.facts import item_id
    return bindings.select(
        item_id(F.col("item")).alias("item"), F.col("itemLabel").alias("label"), "description",
        F.col("matchedCategory").alias("category"), F.col("date").alias("value_time"),
        leading_int(F.col("datePrecision")).alias("precision"), wkt_point(F.col("coord")).alias("point"),
        F.col("wikipediaTitle").alias("article")).filter("item IS NOT NULL")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.split("value", "\t").alias("c")).filter(F.size("c") >= 5)
    at = lambda i: F.trim(F.get("c", F.lit(i)))
    df = lines.select(at(0).alias("infobox_type"), at(1).alias("proposed_category"), at(2).try_cast("long").alias("count"),
                      (at(3) == "1").alias("was_included"), (at(4) == "1").alias("include_in_future"))
    return df.filter("count IS NOT NULL")


# Types a catalog may name: a setting of the run, kept on the driver.
MOST_TYPES = 50_000


def included_types(catalog: DataFrame) -> list[str]:
    """Types a reviewed catalog takes in; the defaults when it names none."""
    rows = catalog.filter("include_in_future AND infobox_type <> ''").select("infobox_type").distinct().limit(MOST_TYPES + 1).collect()
    if len(rows) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} infobox types to include")
    return sorted(r[0] for r in rows) or list(DEFAULT_TYPES)


def types_from_file(spark: SparkSession, path: str) -> list[str]:
    """The same from a file; the defaults also when there is no such file."""
    from pyspark.errors import AnalysisException
    try:
        return included_types(read_catalog(spark, path))
    except AnalysisException:
        return list(DEFAULT_TYPES)


def read_rules(spark: SparkSession, path: str) -> tuple[IngestRules, dict[str, str]]:
    """(rules, other settings) of a 'key<TAB>value' settings file; # starts a comment.

    Keys exclude_category and max_birth_year ("type year") may repeat.  Settings
    that are not rules (paths, stream_stride, max_restarts, stop_after_...) come
    back as text.
    """
    line = trim_all(F.col("value"))
    lines = spark.read.text(path).select(line.alias("l")).filter(~F.startswith("l", F.lit("#")) & F.contains("l", F.lit("\t")))
    at = F.locate("\t", F.col("l"))
    rows = lines.select(trim_all(F.substring("l", F.lit(1), at - 1)), trim_all(F.substring("l", at + 1, F.length("l")))).collect()
    rules, caps, excluded, other = {}, {}, [], {}
    for key, value in rows:
        if key == "exclude_category":
            excluded.append(value)
        elif key == "max_birth_year":
            infobox_type, year = value.split()
            caps[infobox_type] = int(year)
        elif key in ("date_after", "date_before"):
            rules[key] = int(value)
        elif key == "exclude_no_coords":
            rules["require_points"] = value.lower() in ("1", "true")
        else:
            other[key] = value
    if "catalog_input" in other:
        rules["include"] = types_from_file(spark, other["catalog_input"])
    return IngestRules(exclude_categories=excluded, max_start_year=caps, **rules), other


def read_record_lists(spark: SparkSession, path: str) -> DataFrame:
    """(id, category, data) of JSON lists of records; data is the whole record as a variant."""
    items = array_members(spark, path, "", "").select(F.try_parse_json("m").alias("data"))
    return items.select(F.try_variant_get("data", "$.id", "string").alias("id"), F.try_variant_get("data", "$.category", "string").alias("category"), "data")


def record_members(records: DataFrame, path: str) -> DataFrame:
    """Records with a row for each member (pos, value) of an array inside them; data is a variant."""
    inner = records.withColumn("__at", F.try_variant_get("data", path, "variant"))
    members = records.sparkSession.tvf.variant_explode(F.col("__at").outer())
    return inner.lateralJoin(members).drop("__at", "key")
