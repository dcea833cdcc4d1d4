"""Entries with their locations: nesting, lists, eras and pins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronofold.functions import years
from chronofold.functions.text import citation_label, citation_url
from chronofold.operators.filters import only_eras
from chronofold.runtime import broadcast_if_small, cut


def nested_locations(locations: DataFrame, *fields: str) -> DataFrame:
    """One row per entry with its locations as an ordered array."""
    item = F.struct("ordinal", *fields)
    return locations.groupBy("entry_id").agg(F.sort_array(F.collect_list(item)).alias("locations"))


def with_locations(entries: DataFrame, locations: DataFrame, *fields: str) -> DataFrame:
    """Entries with their location array, empty when there is none."""
    nested = nested_locations(locations, *fields)
    out = entries.join(nested, entries["id"] == nested["entry_id"], "left").drop("entry_id")
    kind = out.schema["locations"].dataType
    return out.withColumn("locations", F.coalesce("locations", F.array().cast(kind)))


def page_with_locations(top: DataFrame, locations: DataFrame | Callable[[DataFrame], DataFrame], *fields: str) -> DataFrame:
    """The same for a search's rows, all that it is given.

    They are written out, so the search runs once, and their ids, if few, are broadcast
    into the location scan, so only their locations are gathered.  locations may be a
    function from the ids (entry_id) to their locations, for tables that are numbered or
    nested first: the ids then reach the scan below that.
    """
    top = cut(top, "page")
    ids = broadcast_if_small(top.select(F.col("id").alias("entry_id")))
    own = locations(ids) if callable(locations) else locations.join(ids, "entry_id", "left_semi")
    return with_locations(top, own, *fields)


def location_json(kind: Column) -> Column:
    """One stored location row as the JSON object of its kind; ring points are [lng, lat]."""
    label, uncertain = F.col("label"), F.col("uncertain")
    tail = [uncertain.alias("uncertain"), label.alias("label")]
    pair = lambda p: F.array(p["lng"], p["lat"])
    shapes = F.transform("polygons", lambda rings: F.transform(rings, lambda ring: F.transform(ring, pair)))

    def js(*cols):
        return F.to_json(F.struct(kind.alias("type"), *cols), {"ignoreNullFields": "false"})

    return (F.when(kind == "point", js(F.col("lat").alias("lat"), F.col("lng").alias("lng"), *tail))
            .when(kind == "circle", js(F.col("lat").alias("centerLat"), F.col("lng").alias("centerLng"),
                                       F.col("radius_km").alias("radiusKm"), *tail))
            .when(kind == "polygon", js(F.get(shapes, F.lit(0)).alias("rings"), *tail))
            .when(kind == "multipolygon", js(shapes.alias("polygons"), *tail))
            .when(kind == "path", js(F.col("waypoints").alias("waypoints"), label.alias("label")))
            .otherwise(F.raise_error(F.concat(F.lit("unknown location kind: "), kind))))


def full_records(entries: DataFrame) -> DataFrame:
    """Stored entries in their outward shape, with dates and citation."""
    plain = F.coalesce("citation_url", F.lit("")) == ""
    return entries.select(
        "id", "title", F.when(plain, F.col("title")).otherwise("").alias("wikipedia_title"),
        "category", "infobox_type", "description", "tags", "last_updated",
        citation_url(F.col("citation_url"), F.col("title")).alias("citation_url"),
        citation_label(F.col("citation_label")).alias("citation_label"),
        years.start_date().alias("start_date"), years.end_date().alias("end_date"))


def boundaries(entries: DataFrame, locations: DataFrame) -> DataFrame:
    """Entries that have a polygon, by title."""
    shaped = locations.filter(F.col("kind").isin("polygon", "multipolygon")).select("entry_id")
    return (entries.join(shaped, entries["id"] == shaped["entry_id"], "left_semi")
            .select("id", "slug", "title").orderBy("title"))


def era_source(tags: Column) -> Column:
    """First tag ending in -history; world-history when there is none."""
    return F.coalesce(F.get(F.filter(tags, lambda t: F.endswith(t, F.lit("-history"))), F.lit(0)),
                      F.lit("world-history"))


def eras(entries: DataFrame) -> DataFrame:
    return only_eras(entries).select("id", "title", "start_year", "end_year",
                                     era_source(F.col("tags")).alias("source"), "last_updated")


def with_pins(matches: DataFrame, order: list[str], entries: DataFrame, pins: DataFrame) -> DataFrame:
    """Matches in order, then the pinned entries not among them in pin order.

    `pins` is (id, pin_order).  Adds `part` (0 match, 1 pin) and pin_order; pins
    that name no entry drop out.  The matches are written out, so the search
    behind them runs once.
    """
    matches, small = cut(matches, "matches"), broadcast_if_small(pins)
    extra = entries.join(small, "id").join(matches.select("id"), "id", "left_anti")
    a = matches.withColumn("part", F.lit(0)).withColumn("pin_order", F.lit(None).cast("long"))
    b = extra.withColumn("part", F.lit(1)).withColumn("pin_order", F.col("pin_order").cast("long"))
    return a.unionByName(b).orderBy("part", "pin_order", *order)


def result_counts(matches: DataFrame, pins: DataFrame) -> DataFrame:
    """How many entries matched and how many are pinned, each on its own."""
    both = matches.select(F.lit(1).alias("m"), F.lit(0).alias("p")).unionAll(
        pins.select(F.lit(0).alias("m"), F.lit(1).alias("p")))
    return both.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n_matches"),
                    F.coalesce(F.sum("p"), F.lit(0)).alias("n_pinned"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = row if out is None else out.unionAll(row)
    return out


def density(entries: DataFrame, low: int, high: int) -> DataFrame:
    """Entries per time bucket and height against the tallest bucket.

    Buckets are 10, 100 or 1000 years wide for a span up to 200, 2000 or more.
    """
    span = high - low
    width = 10 if span <= 200 else 100 if span <= 2000 else 1000
    n = entries.filter(F.col("start_year").between(low, high)).groupBy(
        (F.floor(F.col("start_year") / width) * width).cast("int").alias("bucket")
    ).agg(F.count(F.lit(1)).alias("n"))
    # One row per bucket is left here, a few hundred at most.
    top = F.max("n").over(W.partitionBy(F.lit(1)))
    return n.select("bucket", "n", (F.col("n") / top).alias("height"))
