"""Writing entries and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter, functions as F

from chronofold.functions.text import escape_field
from chronofold.schema import ENTRY_COLUMNS, KINDS

# Plain tab-separated text: nothing quoted, nothing trimmed.
_TSV = {"sep": "\t", "header": "true", "quote": "", "escape": "", "emptyValue": "", "nullValue": "",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def entry_fields(entries: DataFrame) -> DataFrame:
    """The 17 text columns of an entry file."""
    numbers = {"start_year", "start_month", "start_day", "end_year", "end_month", "end_day", "uncertainty_years"}

    def column(name: str) -> Column:
        if name in numbers:
            c = F.col(name)
            return (c.cast("long") if name == "uncertainty_years" else c).cast("string")
        if name in ("locations", "tags"):
            return escape_field(F.to_json(name))
        return escape_field(F.col(name))

    return entries.select(*[column(n).alias(n) for n in ENTRY_COLUMNS])


def write_entries(entries: DataFrame, path: str) -> None:
    """Entry text files, one per task, each with the header."""
    entry_fields(entries).write.mode("overwrite").options(**_TSV).csv(path)


def catalog_fields(catalog: DataFrame) -> DataFrame:
    flag = lambda c: F.col(c).cast("int").alias(c)
    return catalog.select("infobox_type", "proposed_category", "count", flag("was_included"), flag("include_in_future"))


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Most frequent types first."""
    catalog_fields(catalog).orderBy(F.desc("count"), "infobox_type").write.mode("overwrite").options(**_TSV).csv(path)


def split_catalog(catalog: DataFrame) -> DataFrame:
    """Types seen more than once, to be written one folder per category."""
    return catalog_fields(catalog).filter(F.col("count") > 1)


def write_split_catalog(catalog: DataFrame, path: str) -> None:
    df = split_catalog(catalog)
    df.repartition("proposed_category").sortWithinPartitions(F.desc("count"), "infobox_type").write.mode("overwrite") \
        .partitionBy("proposed_category").options(**_TSV).csv(path)


def named_uuid(name: Column) -> Column:
    """The same id for the same name, so a repeated task cannot break the link
    between an entry and its locations."""
    h = F.md5(name)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def finite(c: Column, what: str) -> Column:
    bad = c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"not a finite number: {what}"))).otherwise(c)


def entry_table(entries: DataFrame) -> DataFrame:
    """Entries without their locations, every number checked."""
    numbers = ["start_year", "start_month", "start_day", "end_year", "end_month", "end_day", "uncertainty_years"]
    return entries.withColumn("id", named_uuid(F.col("slug"))).withColumns(
        {n: finite(F.col(n), n) for n in numbers}).drop("locations")


def location_table(entries: DataFrame) -> DataFrame:
    """One row per location; the first has ordinal 0; an unknown kind is an error."""
    df = entries.select(named_uuid(F.col("slug")).alias("entry_id"), F.posexplode("locations").alias("ordinal", "l"))
    kind = F.col("l.type")
    rings = lambda c: F.transform(c, lambda r: F.transform(r, lambda p: F.struct(
        F.get(p, F.lit(0)).alias("lng"), F.get(p, F.lit(1)).alias("lat"))))
    polygons = (F.when(kind == "polygon", F.array(rings(F.col("l.rings"))))
                .when(kind == "multipolygon", F.transform("l.polygons", rings)))
    return df.select(
        "entry_id", "ordinal", F.when(kind.isin(*KINDS), kind).otherwise(F.raise_error(
            F.concat(F.lit("unknown location kind: "), F.coalesce(kind, F.lit("none"))))).alias("kind"),
        F.when(kind == "point", F.col("l.lng")).when(kind == "circle", F.col("l.centerLng")).alias("lng"),
        F.when(kind == "point", F.col("l.lat")).when(kind == "circle", F.col("l.centerLat")).alias("lat"),
        F.when(kind == "circle", finite(F.col("l.radiusKm"), "radius")).alias("radius_km"),
        polygons.alias("polygons"), F.when(kind == "path", F.col("l.waypoints")).alias("waypoints"),
        F.coalesce("l.uncertain", F.lit(False)).alias("uncertain"), F.col("l.label").alias("label"))


def load_tables(entries: DataFrame, path: str) -> None:
    """Replace the stored tables: entries by category and in order of start year, so
    that category and year filters skip files and row groups; locations by entry.  Bloom filters on ids, slugs and titles let look-ups
    skip the row groups that do not hold them."""
    entries_out = entry_table(entries).sortWithinPartitions("category", "start_year").write.mode("overwrite")
    with_blooms(entries_out, "id", "slug", "title").partitionBy("category").parquet(f"{path}/entries")
    with_blooms(location_table(entries).write.mode("overwrite"), "entry_id").parquet(f"{path}/locations")


def with_blooms(writer: DataFrameWriter, *columns: str) -> DataFrameWriter:
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return writer
