"""Lanesets: building lanes, placing entries and eras in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chronofold.operators import spatial as sp
from chronofold.runtime import broadcast_if_small

# Fixed value: the lane that holds everything when no laneset is active.
ALL_LANE = "all"
GLOBAL_LANE, GLOBAL_SOURCE = "global", "world-history"


def group_into_lanes(countries: DataFrame, membership: DataFrame) -> DataFrame:
    """Lanes whose geometry is all polygons of the countries with a listed key.

    countries: (source_order, key_kind -> value columns, polygons);
    membership: (laneset_id, ordinal, slug, key_kind, key_value).
    """
    keys = F.explode(F.create_map(F.lit("continent"), F.col("continent"), F.lit("subregion"), F.col("subregion")))
    c = countries.select("source_order", "polygons", keys.alias("key_kind", "key_value"))
    lanes = c.join(broadcast_if_small(membership), ["key_kind", "key_value"]).groupBy(
        "laneset_id", "ordinal", "slug").agg(
        F.sort_array(F.collect_list(F.struct("source_order", "polygons"))).alias("g"))
    return lanes.select("laneset_id", "ordinal", "slug", F.flatten(F.col("g.polygons")).alias("polygons")) \
        .withColumn("bbox", sp.bbox(F.col("polygons")))


def lane_parts(lanes: DataFrame) -> DataFrame:
    """One row per polygon of a lane, ready for the point joins."""
    return lanes.select("laneset_id", "ordinal", "slug", F.posexplode("polygons").alias("part", "rings"))


def nested_lanes(lanesets: DataFrame, lanes: DataFrame, *fields: str) -> DataFrame:
    """Lanesets with their lanes as an array in lane order, empty when none.

    A lane has its slug, box and era sources, and what other fields are named
    (name, description, polygons).
    """
    item = F.struct("ordinal", "slug", F.array("bbox.lng_min", "bbox.lat_min", "bbox.lng_max", "bbox.lat_max").alias("bbox"),
                    "era_sources", *fields)
    agg = lanes.groupBy("laneset_id").agg(F.sort_array(F.collect_list(item)).alias("lanes"))
    out = lanesets.join(agg, "laneset_id", "left")
    return out.withColumn("lanes", F.coalesce("lanes", F.array().cast(out.schema["lanes"].dataType)))


def laneset_list(lanesets: DataFrame) -> DataFrame:
    return lanesets.select("laneset_id", "slug", "last_updated").orderBy("slug")


def active_laneset(lanesets: DataFrame, requested: str) -> DataFrame:
    """The asked-for laneset, else the first; one row."""
    return lanesets.agg(F.min_by(F.struct("laneset_id", "slug"),
                                 F.struct(F.col("slug") != requested, "ordinal")).alias("l")).select("l.*")


def assign_lanes(points: DataFrame, lane_polygons: DataFrame, point_keys: list[str]) -> DataFrame:
    """(point keys, laneset_id, lane): first lane in order that holds the point."""
    return sp.first_containing(points, lane_polygons, point_keys, ["laneset_id"], "ordinal", "slug") \
        .withColumnRenamed("slug", "lane")


def assign_all(points: DataFrame, point_keys: list[str]) -> DataFrame:
    """No laneset: every entry with a point is in the one lane."""
    return points.filter(F.col("lng").isNotNull() & F.col("lat").isNotNull()).select(
        *point_keys, F.lit(ALL_LANE).alias("lane"))


def assign_eras(eras: DataFrame, lanes: DataFrame, with_global: bool = True) -> DataFrame:
    """(era columns, laneset_id, lane): first lane whose era sources name the era's source.

    lanes: (laneset_id, ordinal, slug, era_sources).
    """
    by_source = lanes.select("laneset_id", "ordinal", "slug", F.explode("era_sources").alias("source"))
    if with_global:
        top = lanes.select("laneset_id").distinct().select(
            "laneset_id", F.lit(-1).alias("ordinal"), F.lit(GLOBAL_LANE).alias("slug"), F.lit(GLOBAL_SOURCE).alias("source"))
        by_source = by_source.unionByName(top)
    first = by_source.groupBy("laneset_id", "source").agg(F.min_by("slug", "ordinal").alias("lane"))
    return eras.join(broadcast_if_small(first), "source")
