"""Intervals into non-overlapping rows.

Both packers read a lane from left to right, so a lane cannot simply be split.
What they need from equal starts is little, though: at one start only the first
few intervals can take a free row, and the rest share one fate.  So every start
is first cut down to those few (partial, on the map side), the sequential part
runs on at most a handful of rows per lane and start year, and the many other
intervals get their row by a join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from chronofold.runtime import broadcast_if_small, cut

MAX_ROWS = 8
TRACKS = 2


def _whole(df: DataFrame, start: str) -> None:
    """Starts are whole numbers, so that a lane has few of them however many its intervals are."""
    if dict(df.dtypes)[start] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{start} must be whole years")


def pack_rows(df: DataFrame, lane: str, key: str, start: str, end: str, pad: float, gap: float,
              max_rows: int = MAX_ROWS) -> DataFrame:
    """(lane, key, row): first row that is free at start - pad; an interval keeps its
    row until max(end, start + pad) + gap.  With all rows taken it overflows onto
    the last one.  Equal starts go in key order.
    """
    if pad + gap <= 0:
        raise ValueError("pad + gap must be positive")
    _whole(df, start)
    df = df.select(lane, key, start, end)
    nth = F.row_number().over(W.partitionBy(lane, start).orderBy(key))
    heads = df.withColumn("nth", nth).filter(F.col("nth") <= max_rows)
    last = df.groupBy(lane, start).agg(F.max_by(end, key).alias("last_end"), F.count(F.lit(1)).alias("n"))
    few = heads.join(last, [lane, start]).select(
        lane, F.col(key).alias("key"), F.col(start).alias("start"), F.col(end).alias("end"), "nth", "last_end", "n")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "nth"], ignore_index=True)
        ends, rows = [float("-inf")] * max_rows, []
        for s, e, nth, last_end, n in zip(pdf.start, pdf.end, pdf.nth, pdf.last_end, pdf.n):
            row = next((i for i, taken in enumerate(ends) if taken <= s - pad), max_rows - 1)
            ends[row] = max(e, s + pad) + gap
            if nth == max_rows and n > max_rows:
                ends[-1] = max(last_end, s + pad) + gap
            rows.append(row)
        return pd.DataFrame({lane: pdf[lane], key: pdf.key, "row": rows})

    kinds = dict(df.dtypes)
    placed = cut(few.groupBy(lane).applyInPandas(pack, f"`{lane}` {kinds[lane]}, `{key}` {kinds[key]}, row int"), "rows")
    out = df.select(lane, key).join(broadcast_if_small(placed), [lane, key], "left")
    return out.withColumn("row", F.coalesce("row", F.lit(max_rows - 1)))


def pack_tracks(df: DataFrame, lane: str, key: str, start: str, end: str) -> DataFrame:
    """(lane, key, track): two tracks; a track is free once its interval has ended.
    With both taken, an interval that ends later than the earliest-ending one puts
    it out, else it is dropped.  Equal starts go in key order; keys are whole numbers.

    An interval that ends where it starts never holds a track: it is shown if a
    track is free when its turn comes.  Of the others only those that end later
    than the second latest end before them, at the same start, can matter.
    """
    _whole(df, start)
    df = df.select(lane, F.col(key).cast("long").alias("key"), F.col(start).alias("start"), F.col(end).alias("end"))
    long, brief = df.filter("end > start"), df.filter("end <= start")
    same_end = F.row_number().over(W.partitionBy(lane, "start", "end").orderBy("key"))
    long = long.withColumn("nth", same_end).filter(F.col("nth") <= TRACKS).drop("nth")
    before = W.partitionBy(lane, "start").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    long = long.withColumn("top", F.max("end").over(before))
    lesser = F.when(F.col("top").isNotNull(), F.least("end", "top"))
    long = long.withColumn("lesser", lesser).withColumn("second", F.max("lesser").over(before))
    long = long.filter(F.col("second").isNull() | (F.col("end") > F.col("second"))).select(lane, "key", "start", "end")
    mark = brief.select(lane, "start").distinct().select(
        lane, F.lit(None).cast("long").alias("key"), "start", F.lit(None).cast(dict(df.dtypes)["end"]).alias("end"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf[lane].iloc[0]
        pdf = pdf.sort_values(["start", "key"], na_position="last")
        active: list[tuple] = [(float("-inf"), None)] * TRACKS      # (end, key)
        shown: dict[int, int] = {}
        turns: list[list] = []
        for s, k, e in zip(pdf.start.to_numpy(), pdf.key.to_numpy(), pdf.end.to_numpy()):
            if not turns or turns[-1][1] != s:
                free = [t for t, a in enumerate(active) if a[0] <= s]
                free += [None] * (TRACKS - len(free))
                turns.append([name, s, free[0], None, free[1], None])
            if pd.isna(k):
                continue
            t = next((t for t, a in enumerate(active) if a[0] <= s), None)
            if t is None:
                t = min(range(TRACKS), key=lambda i: active[i][0])
                if e <= active[t][0]:
                    continue
                del shown[active[t][1]]
            else:
                # This one ends the wait for a free track at its place in line.
                turns[-1][3 if turns[-1][3] is None else 5] = int(k)
            active[t] = (e, int(k))
            shown[int(k)] = t
        kept = pd.DataFrame([(name, k, t) for k, t in shown.items()], columns=[lane, "key", "track"])
        turn = pd.DataFrame(turns, columns=[lane, "start", "t0", "k0", "t1", "k1"])
        return pd.concat([kept, turn], ignore_index=True).astype(
            {c: "Int64" for c in ("key", "track", "start", "t0", "k0", "t1", "k1")})

    shape = f"`{lane}` {dict(df.dtypes)[lane]}, key long, track int, start long, t0 int, k0 long, t1 int, k1 long"
    run = cut(long.unionByName(mark).groupBy(lane).applyInPandas(pack, shape), "tracks")
    turns = run.filter("start IS NOT NULL").select(lane, F.col("start").alias("start"), "t0", "k0", "t1", "k1")
    track = (F.when(F.col("k0").isNull() | (F.col("key") < F.col("k0")), F.col("t0"))
             .when(F.col("k1").isNull() | (F.col("key") < F.col("k1")), F.col("t1")))
    shown_brief = brief.join(broadcast_if_small(turns), [lane, "start"]).select(lane, "key", track.alias("track"))
    out = run.filter("key IS NOT NULL").select(lane, "key", "track").unionAll(shown_brief.filter("track IS NOT NULL"))
    return out.withColumnRenamed("key", key)
