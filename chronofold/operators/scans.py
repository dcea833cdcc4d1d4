"""Running values over long ordered groups, split into chunks.

A plain window puts one group into one task.  Here the caller gives a chunk
column that never decreases along the order (a day, a block of positions), so
the window runs per (group, chunk) and only one summary row per chunk is
scanned along the group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F


@dataclass(frozen=True)
class Running:
    """One running value.

    kind: "last" (latest non-null so far), "next" (earliest non-null from here
    on) or "sum".  inclusive=False leaves the current row out.
    """

    kind: str
    column: Column
    inclusive: bool = True


def running(df: DataFrame, group: list[str], chunk: str, order: list[str],
            values: dict[str, Running]) -> DataFrame:
    """df with each running value added, whatever the size of a group."""
    keys = [*group, chunk]
    pos = F.struct(*order)
    df = df.withColumns({f"__{n}": v.column for n, v in values.items()})

    summaries = {}
    for name, v in values.items():
        c = F.col(f"__{name}")
        at = F.when(c.isNotNull(), pos)
        summaries[name] = {"last": F.max_by(c, at), "next": F.min_by(c, at),
                           "sum": F.sum(c)}[v.kind].alias(f"__{name}")
    chunks = df.groupBy(*keys).agg(*summaries.values())
    before = W.partitionBy(*group).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*group).orderBy(chunk).rowsBetween(1, W.unboundedFollowing)
    carry = []
    for name, v in values.items():
        c = F.col(f"__{name}")
        carry.append({"last": lambda: F.last(c, True).over(before),
                      "next": lambda: F.first(c, True).over(after),
                      "sum": lambda: F.coalesce(F.sum(c).over(before), F.lit(0))}[v.kind]()
                     .alias(f"__carry_{name}"))
    chunks = chunks.select(*keys, *carry)

    inner = W.partitionBy(*keys).orderBy(*order)
    local = {}
    for name, v in values.items():
        c = F.col(f"__{name}")
        edge = 0 if v.inclusive else 1
        back = inner.rowsBetween(W.unboundedPreceding, -edge)
        ahead = inner.rowsBetween(edge, W.unboundedFollowing)
        local[name] = {"last": lambda: F.last(c, True).over(back),
                       "next": lambda: F.first(c, True).over(ahead),
                       "sum": lambda: F.coalesce(F.sum(c).over(back), F.lit(0))}[v.kind]()
    joined = df.withColumns(local).join(chunks, keys)
    final = {n: (F.col(n) + F.col(f"__carry_{n}")) if v.kind == "sum"
             else F.coalesce(F.col(n), F.col(f"__carry_{n}"))
             for n, v in values.items()}
    return joined.withColumns(final).drop(
        *[f"__{n}" for n in values], *[f"__carry_{n}" for n in values])


def ordinals(df: DataFrame, group: list[str], chunk: Column, order: list[str],
             name: str = "ordinal", start: int = 0) -> DataFrame:
    """Dense position of each row inside its group."""
    df = df.withColumn("__chunk", chunk)
    out = running(df, group, "__chunk", order, {name: Running("sum", F.lit(1), False)})
    return out.withColumn(name, F.col(name) + F.lit(start)).drop("__chunk")
