"""Saved searches: resolving their lines to bounds and running many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronofold.operators import search_kernels as K
from chronofold.operators.filters import without_eras
from chronofold.operators.spatial import containing
from chronofold.operators.text_index import TextIndex, holders
from chronofold.runtime import broadcast_if_small, cut
from chronofold.schema import CATEGORIES, DEFAULT_LIMIT

# Years per time bucket of the many-searches join, and the span that is cut into
# buckets; everything before or after falls into the first or last one.
BUCKET_YEARS, BUCKET_FROM, BUCKET_TO = 250, -10_000, 3_000


def resolve(spec: DataFrame, years: tuple[float, float] = (float("-inf"), float("inf")),
            box: tuple[float, float, float, float] | None = None, most: int | None = None) -> DataFrame:
    """One row of bounds per search.

    spec: (query_id, seq, kind, str_value, lo, hi), kinds category, text, year,
    lat, lng, inside, outside, limit.  Of category, text, inside, outside and limit
    the last line counts; year, lat and lng ranges are intersected, a reversed one
    put in order first, together with the caller's years and box
    (lat_min, lat_max, lng_min, lng_max).  A limit is cut to `most` if that is given.  Unknown categories drop out of a line,
    and a line with none left is as if not there.
    """
    names = F.filter(F.transform(F.split("str_value", ","), lambda s: F.lower(F.trim(s))), lambda s: s.isin(*CATEGORIES))
    df = spec.withColumns({"names": F.when((F.col("kind") == "category") & (F.size(names) > 0), names),
                           "a": F.least("lo", "hi"), "b": F.greatest("lo", "hi")})
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    last = lambda value: F.max_by(value, F.when(value.isNotNull(), F.col("seq")))
    text = of("text", F.when(F.col("str_value") != "", F.lower("str_value")))
    limit = of("limit", F.greatest(F.col("lo").cast("int"), F.lit(1)))
    sides = {"lat": (box[0], box[1]), "lng": (box[2], box[3])} if box else {}
    low = lambda k: F.greatest(F.max(of(k, F.col("a"))), F.lit(sides[k][0])) if k in sides else F.max(of(k, F.col("a")))
    high = lambda k: F.least(F.min(of(k, F.col("b"))), F.lit(sides[k][1])) if k in sides else F.min(of(k, F.col("b")))
    return df.groupBy("query_id").agg(
        F.greatest(F.coalesce(F.max(of("year", F.col("a"))), F.lit(float(years[0]))), F.lit(float(years[0]))).alias("year_min"),
        F.least(F.coalesce(F.min(of("year", F.col("b"))), F.lit(float(years[1]))), F.lit(float(years[1]))).alias("year_max"),
        low("lat").alias("lat_min"), high("lat").alias("lat_max"), low("lng").alias("lng_min"), high("lng").alias("lng_max"),
        last(F.col("names")).alias("categories"), last(text).alias("text"),
        last(of("inside", F.col("str_value"))).alias("inside"), last(of("outside", F.col("str_value"))).alias("outside"),
        F.least(F.coalesce(last(limit), F.lit(DEFAULT_LIMIT)), F.lit(most)).cast("int").alias("row_limit"))


def words_of(title: Column, description: Column) -> Column:
    """What a text line is looked for in."""
    return F.concat(F.lower(title), F.lit(" "), F.lower(description))


def _bucket(year):
    return F.floor(F.least(F.greatest(year, F.lit(BUCKET_FROM)), F.lit(BUCKET_TO)) / BUCKET_YEARS).cast("int")


# Entries of a text and bucket that go past their searches in one task, about.
A_TASK = 200_000

#: Columns by which a search looks at places.
PLACED = ("lat_min", "lat_max", "lng_min", "lng_max", "inside", "outside")


def _within_reach(q: DataFrame, cells: DataFrame) -> DataFrame:
    """Searches with a text, each up to the bucket in which its limit is surely full: no entry that begins later is among its first rows.

    An entry that begins in a bucket before the search's last one and ends in one after its first one is in its years.  A search that
    looks at places keeps all its buckets.  cells: (no, category, from_bucket, to_bucket, n), how many entries hold a text.
    """
    q = cut(q, "worded")
    plain = q.filter(F.coalesce(*[F.col(c).cast("string") for c in PLACED]).isNull())
    sure = plain.join(cells, ["no", "category"]).filter("from_bucket < last_bucket AND to_bucket > query_bucket")
    sure = sure.groupBy("query_id", "row_limit", "from_bucket").agg(F.sum("n").alias("n"))
    so_far = F.sum("n").over(W.partitionBy("query_id").orderBy("from_bucket"))
    full = sure.withColumn("n", so_far).filter("n >= row_limit").groupBy("query_id").agg(F.min("from_bucket").alias("reach"))
    q = q.join(full, "query_id", "left")
    return q.withColumn("last_bucket", F.least("last_bucket", F.greatest("query_bucket", F.coalesce("reach", "last_bucket")))).drop("reach")


def _first_rows(q: DataFrame, held: DataFrame, cells: DataFrame) -> DataFrame:
    """(query_id, id, slug, start_year, row_limit) of searches that look at no place: of each bucket, the first rows up to the limit.

    The entries of a text and bucket go by in order, past all searches for them, so that no pair is made that a limit leaves out.
    Where they are many, they go by in several shares, past the searches each time.
    """
    touched = lambda df: df.withColumn("bucket", F.explode(F.sequence("from_bucket", F.greatest("from_bucket", "to_bucket"))))
    shares = touched(cells).groupBy("no", "bucket").agg(F.ceil(F.sum("n") / A_TASK).alias("shares"))
    q = q.withColumn("bucket", F.explode(F.sequence("query_bucket", "last_bucket")))
    asked = q.groupBy("no", "bucket", "query_id", "year_min", "year_max", "row_limit", "query_bucket").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    asked = cut(asked.join(broadcast_if_small(shares), ["no", "bucket"]), "asked")
    hits = touched(held).withColumn("no", F.explode("nos")).join(broadcast_if_small(asked.select("no", "bucket", "shares").distinct()), ["no", "bucket"])
    hits = hits.withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")))
    asked = asked.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    of = dict(held.dtypes) | dict(asked.dtypes)
    columns = ["start_year", "slug", "id", "end_year", "category", "from_bucket", "query_id", "year_min", "year_max", "row_limit", "query_bucket", "categories"]
    row = lambda df, kind: df.select("no", "bucket", "share", F.lit(kind).alias("kind"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(of[c]).alias(c) for c in columns])
    rows = row(asked, 0).unionByName(row(hits, 1)).repartition("no", "bucket", "share").sortWithinPartitions("no", "bucket", "share", "kind", "start_year", "slug")
    return rows.mapInArrow(K.first_rows, ", ".join(f"{c} {of[c]}" for c in ("query_id", "id", "slug", "start_year", "row_limit")))


def run_all(bounds: DataFrame, entries: DataFrame, primary: DataFrame | None = None,
            boundaries: DataFrame | None = None, index: TextIndex | None = None) -> DataFrame:
    """(query_id, rank, id, slug, start_year) of every search over one pass of the entries.

    Searches and entries meet on category and time bucket, both sides listing the
    buckets they touch (at most 53), and a pair counts only in the first bucket the
    two share.  Searches with the same bounds are run once and their rows handed to
    each.  Ranks are cut to the largest limit before the shuffle, and only boundaries that
    a search names are looked into.

    entries carry tags; primary: (entry_id, lat, lng); boundaries: (slug, part, rings).  index: of all entries' titles and
    descriptions (words_of); with it their texts are not read, but for those that hold the rarest trigrams of a search, and a search
    with a text meets the entries that hold it, not all of its years.
    """
    same = F.to_json(F.struct(*[c for c in bounds.columns if c != "query_id"]))
    asked = cut(bounds.withColumn("bounds", same), "bounds")
    leaders = asked.groupBy("bounds").agg(F.min("query_id").alias("leader"))
    owners = asked.select("query_id", "bounds").join(leaders, "bounds").select("query_id", "leader")
    bounds = asked.join(leaders, [asked["bounds"] == leaders["bounds"], asked["query_id"] == leaders["leader"]], "left_semi").drop("bounds")
    most = asked.agg(F.max("row_limit")).first()[0] or 0
    e = without_eras(entries)
    if primary is not None:
        e = e.join(primary.select(F.col("entry_id").alias("id"), "lat", "lng"), "id", "left")
    else:
        e = e.withColumns({"lat": F.lit(None).cast("double"), "lng": F.lit(None).cast("double")})
    words = F.lit(None).cast("string") if index else words_of(F.col("title"), F.col("description"))
    e = e.select("id", "slug", "start_year", "end_year", "category", "lat", "lng", words.alias("words"),
                 _bucket(F.col("start_year")).alias("from_bucket"), _bucket(F.col("end_year")).alias("to_bucket"))
    all_nine = F.array(*[F.lit(c) for c in CATEGORIES])
    q = bounds.filter("year_min <= year_max").withColumns({
        "category": F.explode(F.array_distinct(F.coalesce("categories", all_nine))), "query_bucket": _bucket(F.col("year_min")),
        "last_bucket": _bucket(F.col("year_max"))}).drop("categories")

    def met(e: DataFrame, q: DataFrame, on: list[str]) -> DataFrame:
        e = e.withColumn("bucket", F.explode(F.sequence("from_bucket", F.greatest("from_bucket", "to_bucket"))))
        q = q.withColumn("bucket", F.explode(F.sequence("query_bucket", "last_bucket")))
        return e.join(broadcast_if_small(q), [*on, "bucket"]).filter(
            (F.col("bucket") == F.greatest("from_bucket", "query_bucket"))
            & (F.col("start_year") <= F.col("year_max")) & (F.col("end_year") >= F.col("year_min"))
            & (F.lit(index is not None) | F.col("text").isNull() | F.contains("words", F.col("text")))
            & (F.col("lat_min").isNull() | F.coalesce(F.col("lat").between(F.col("lat_min"), F.col("lat_max")), F.lit(False)))
            & (F.col("lng_min").isNull() | F.coalesce(F.col("lng").between(F.col("lng_min"), F.col("lng_max")), F.lit(False)))
        ).select("query_id", "id", "slug", "start_year", "inside", "outside", "row_limit")

    if index is None:
        hit = met(e, q, ["category"])
    else:
        # A search with a text meets only the entries that hold it.
        texts, found = holders(index, bounds.select("text"))
        held = cut(e.filter("start_year IS NOT NULL AND end_year IS NOT NULL").join(found, "id"), "held")
        numbered = q.filter("text IS NOT NULL").join(broadcast_if_small(texts), "text")
        cells = held.select(F.explode("nos").alias("no"), "category", "from_bucket", "to_bucket").groupBy("no", "category", "from_bucket", "to_bucket")
        cells = cut(cells.agg(F.count("*").alias("n")), "cells")
        worded = cut(_within_reach(numbered, cells), "reach")
        placed = F.coalesce(*[F.col(c).cast("string") for c in PLACED]).isNotNull()
        hit = _first_rows(worded.filter(~placed), held, cells).select("*", *[F.lit(None).cast("string").alias(c) for c in ("inside", "outside")])
        if not worded.filter(placed).isEmpty():
            each = held.withColumn("no", F.explode("nos")).drop("nos")
            hit = hit.unionByName(met(each, worded.filter(placed), ["category", "no"]))
        free = q.filter("text IS NULL")
        if not free.isEmpty():
            hit = hit.unionByName(met(e, free, ["category"]))
    if primary is not None and boundaries is not None:
        named = bounds.select(F.explode(F.array("inside", "outside")).alias("slug")).where("slug is not null").distinct()
        boundaries = boundaries.join(broadcast_if_small(named), "slug", "left_semi")
        within = containing(primary, boundaries, ["slug"]).select(F.col("entry_id").alias("id"), F.col("slug").alias("boundary")).distinct()
        inside = within.withColumn("is_in", F.lit(True)).withColumnRenamed("boundary", "inside")
        outside = within.withColumnRenamed("boundary", "outside")
        hit = hit.join(inside, ["id", "inside"], "left").filter("inside IS NULL OR is_in").drop("is_in")
        hit = hit.join(outside, ["id", "outside"], "left_anti")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("start_year", "slug"))
    top = hit.withColumn("rank", rank).filter(F.col("rank") <= most)
    top = top.filter("rank <= row_limit").withColumnRenamed("query_id", "leader")
    return owners.join(top, "leader").select("query_id", "rank", "id", "slug", "start_year")
