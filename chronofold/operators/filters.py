"""Filters over entries.

Each takes and returns a DataFrame and keeps to plain comparisons, so category
and year bounds reach the Parquet scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from chronofold.runtime import broadcast_if_small
from chronofold.schema import CATEGORIES

UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)


# Ids that go to a scan as values; more are joined.
AS_VALUES = 1000


def in_categories(df: DataFrame, names: list[str]) -> DataFrame:
    bad = [n for n in names if n not in CATEGORIES]
    if bad:
        raise ValueError(f"invalid category: {', '.join(bad)}")
    return df.filter(F.col("category").isin(*names))


def overlapping_years(df: DataFrame, low: int, high: int) -> DataFrame:
    """Entries whose closed year range meets [low, high]."""
    return df.filter((F.col("start_year") <= high) & (F.col("end_year") >= low))


def text_contains(df: DataFrame, needle: str) -> DataFrame:
    """Case-blind match in title and description joined by a space."""
    both = F.concat(F.lower("title"), F.lit(" "), F.lower("description"))
    return df.filter(F.contains(both, F.lit(needle.lower())))


def label_contains(df: DataFrame, needle: str) -> DataFrame:
    """Case-blind match in label or in description, each on its own."""
    n = F.lit(needle.lower())
    return df.filter(F.contains(F.lower(F.coalesce("label", F.lit(""))), n)
                     | F.contains(F.lower(F.coalesce("description", F.lit(""))), n))


def in_box(lat: Column, lng: Column, lat_min: float | None = None, lat_max: float | None = None,
           lng_min: float | None = None, lng_max: float | None = None) -> Column:
    """Point in a box; a side left out is the end of the globe."""
    pick = lambda v, d: d if v is None else v
    return (lat.between(pick(lat_min, -90.0), pick(lat_max, 90.0))
            & lng.between(pick(lng_min, -180.0), pick(lng_max, 180.0)))


def in_box_entries(df: DataFrame, primary: DataFrame, **sides: float) -> DataFrame:
    """Entries whose primary representative point is in the box; no point fails."""
    hits = primary.filter(in_box(F.col("lat"), F.col("lng"), **sides)).select(F.col("entry_id").alias("id"))
    return df.join(hits, "id", "left_semi")


def is_era() -> Column:
    return (F.col("category") == "historical_period") & F.exists("tags", lambda t: F.endswith(t, F.lit("-history")))


def only_eras(df: DataFrame) -> DataFrame:
    return df.filter(is_era())


def without_eras(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce(is_era(), F.lit(False)))


def by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries named in a table of ids.

    Few ids go to the scan as values, where bloom filters on id (sinks.load_tables) pass over row groups that hold none of them.
    """
    few = ids.select("id").where("id is not null").distinct().limit(AS_VALUES + 1).collect()
    if len(few) <= AS_VALUES:
        return df.filter(F.col("id").isin([r.id for r in few]))
    return df.join(broadcast_if_small(ids.select("id")), "id", "left_semi")


def check_uuids(ids: list[str]) -> list[str]:
    bad = [i for i in ids if not UUID.fullmatch(i)]
    if bad:
        raise ValueError(f"invalid id: {bad[0]}")
    return ids


def at_least_km(df: DataFrame, floor_km: float = 10.0) -> DataFrame:
    return df.filter(F.col("length_km") >= floor_km)


def first_entries(df: DataFrame, limit: int = 100, descending: bool = False, most: int | None = None) -> DataFrame:
    """Earliest (or latest) entries, `most` at most if given; one TakeOrdered, no full sort."""
    start = F.col("start_year").desc() if descending else F.col("start_year").asc()
    return df.orderBy(start, F.col("slug")).limit(limit if most is None else min(most, limit))
