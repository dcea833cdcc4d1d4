"""From band buckets to verified components, without making the pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronofold.llm.components import components
from chronofold.runtime import Work, broadcast_if_small

#: Rows of narrow id tables (a few longs, under 64 MB) that may be broadcast.
NARROW_ROWS = 1_000_000
#: Members in one group of a round; hubs in one.
MEMBERS, HUBS = 512, 256

SetsOf = Callable[[pa.Array], Iterator[np.ndarray]]
LINK = "u long, v long"


def buckets(keys: DataFrame, work: Work, repeats: bool = False) -> DataFrame:
    """(key, id, hub): the rows of buckets that hold more than one id; hub is the smallest.

    keys: (id, keys array<long>); repeats: an id may have several rows.  Keys are counted with map-side partial
    aggregates, so a bucket of any size is one small row before it meets the
    rows again.
    """
    rows = keys.select(F.explode("keys").alias("key"), "id")
    shared = (rows.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"))
              .where("hub < last").select("key", "hub"))
    shared = work.cut(shared, "shared")
    out = rows.join(broadcast_if_small(shared, 2 * NARROW_ROWS), "key")
    out = work.cut(out.distinct() if repeats else out, "buckets")
    work.drop(shared)
    return out


class HubIndex:
    """The sets of a group's hubs; one look-up counts what a set shares with each of them."""

    def __init__(self, ids: list[int], parts: list[int], sets: list[np.ndarray]) -> None:
        self.ids, self.parts = np.array(ids), np.array(parts)
        if len(sets) == 1:
            self.values = sets[0]
            return
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.values, first = np.unique(flat[order], return_index=True)
        self.ends = np.append(first, len(flat))

    def linked(self, part: int, s: np.ndarray, percent: int) -> list[int]:
        """Hubs of other components that are near enough, one for each component."""
        if len(self.ids) == 1:
            if 100 * min(len(s), len(self.values)) < percent * max(len(s), len(self.values)):
                return []
            at = np.searchsorted(self.values, s)
            both = np.count_nonzero(self.values[np.minimum(at, len(self.values) - 1)] == s)
            near = both and part != self.parts[0] and 100 * both >= percent * (len(self.values) + len(s) - both)
            return self.ids.tolist() if near else []
        at = np.searchsorted(self.values, s)
        at = at[at < len(self.values)] if len(at) and at[-1] >= len(self.values) else at
        at = at[self.values[at] == s[:len(at)]]
        a, n = self.ends[at], self.ends[at + 1] - self.ends[at]
        spots = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(self.owners[spots], minlength=len(self.ids))
        near = np.flatnonzero((both > 0) & (self.parts != part) & (100 * both >= percent * (self.sizes + len(s) - both)))
        return self.ids[near[np.unique(self.parts[near], return_index=True)[1]]].tolist()


def verified(needs: DataFrame, with_texts: Callable[[DataFrame], DataFrame], sets_of: SetsOf, percent: int) -> DataFrame:
    """(u, v): each member's links to the hubs of its group in other components, by full sets.

    needs: (g, salt, id, side, component); side is 0 for hubs, 1 for members of group (g, salt).
    with_texts adds the text to a table with the column id.
    """
    ordered = (with_texts(needs).select("g", "salt", "side", "id", "component", "text")
               .repartition("g", "salt").sortWithinPartitions("g", "salt", "side", "id"))

    def compare(batches):
        group, hubs, index = None, [], None
        for batch in batches:
            us, vs = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("g", "salt", "side", "id", "component")))
            for (g, salt, side, id_, part), s in zip(rows, sets_of(batch.column("text"))):
                if group != (g, salt):
                    group, hubs, index = (g, salt), [], None
                if side == 0 and len(s):
                    hubs.append((id_, part, s))
                elif hubs and len(s):
                    index = index or HubIndex(*map(list, zip(*hubs)))
                    for u in index.linked(part, s, percent):
                        us.append(u)
                        vs.append(id_)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return ordered.mapInArrow(compare, LINK)


def _stars(members: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """The first round: every bucket's smallest id with the ids it meets in any bucket, and the given pairs."""
    stars = members.where("hub != id").select(F.col("hub").alias("g"), "id")
    pairs = (stars if pairs is None else stars.unionAll(pairs.select("u", "v"))).distinct()
    sizes = pairs.groupBy("g").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    rows = (pairs.join(broadcast_if_small(sizes.where("salts > 1"), NARROW_ROWS), "g", "left")
            .select("g", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), "id", F.lit(1).alias("side"), F.col("id").alias("component")))
    hubs = rows.select("g", "salt").distinct().select("g", "salt", F.col("g").alias("id"), F.lit(0).alias("side"), F.col("g").alias("component"))
    return hubs.unionAll(rows)


def linked(members: DataFrame, with_texts: Callable[[DataFrame], DataFrame], sets_of: SetsOf, percent: int,
           work: Work, several: int = HUBS, pairs: DataFrame | None = None, unit: Callable[[Column], Column] = lambda id_: id_) -> tuple[DataFrame, DataFrame]:
    """(id, component) of all linked ids and the edges (u, v) that tie them, over the pairs that share a bucket.

    members: (key, id, hub).  with_texts adds the text to a table with the column id.
    pairs: (u, v) that are compared besides, in the first round.  unit: of an id, that of what it stands for; labels and
    edges are of these, so ids of one unit are one.

    First each bucket's smallest id is compared with the others.  A bucket whose ids are
    then in one component is done.  In the others, the ids outside the bucket's
    largest component are compared with all its ids: any pair of two components has such an
    id.  Where these are more than `several`, about so many of them are taken, twice as many
    in each round, which as a rule joins most of the rest.  Ids that were
    compared with the whole bucket leave it.  So no pair of different
    components stays uncompared, the rounds grow with the logarithm of the largest bucket, and
    a bucket's rows move once a round for each HUBS of its hubs, not once a pair.
    """
    def units(found: DataFrame) -> DataFrame:
        return found.select(unit(F.col("u")).alias("u"), unit(F.col("v")).alias("v"))

    needs = work.cut(_stars(members, pairs), "needs")
    edges = work.cut(units(verified(needs, with_texts, sets_of, percent)), "links")  # later: what ties the components so far
    work.drop(needs)
    rest = members.where("hub != id").select("key", "id")
    while True:
        labels = work.cut(components(edges, work), "labels")
        rows = work.cut(rest.withColumn("unit", unit(F.col("id"))).join(broadcast_if_small(labels.withColumnRenamed("id", "unit"), NARROW_ROWS), "unit", "left")
                        .select("key", "id", F.coalesce("component", "unit").alias("component")), "rows")
        parts = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
        open_ = (parts.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("parts"))
                 .where("parts > 1").select("key", "n", F.col("top.component").alias("top"), (F.col("n") - F.col("top.c")).alias("outside")))
        open_ = work.cut(open_, "open")
        work.drop(members)
        if open_.isEmpty():
            work.drop(rows, open_)
            return labels, edges
        live = rows.join(broadcast_if_small(open_, NARROW_ROWS), "key")
        share = F.pmod(F.xxhash64("key", "id", F.lit(several)), F.lit(1 << 30)) * F.col("outside") < F.lit(several << 30)
        hub = (F.col("component") != F.col("top")) & ((F.col("outside") <= several) | share)
        live = live.select("key", "id", "component", "n", hub.alias("hub"), F.when(F.col("outside") <= several, F.col("outside")).otherwise(F.lit(several)).alias("hubs"))
        salts, blocks = F.ceil(F.col("n") / MEMBERS).cast("int"), F.ceil(F.col("hubs") / HUBS).cast("int")
        block = lambda b: F.xxhash64("key", b)
        to_hubs = (live.where("hub").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
                   .select(block(F.pmod(F.xxhash64("id"), blocks).cast("int")).alias("g"), "salt", "id", F.lit(0).alias("side"), "component"))
        to_members = (live.withColumn("b", F.explode(F.sequence(F.lit(0), blocks - 1)))
                      .select(block(F.col("b")).alias("g"), F.pmod(F.xxhash64("id", F.lit(1)), salts).cast("int").alias("salt"), "id", F.lit(1).alias("side"), "component"))
        needs = work.cut(to_hubs.unionAll(to_members), "needs")
        found = units(verified(needs, with_texts, sets_of, percent))
        more = work.cut(labels.select(F.col("component").alias("u"), F.col("id").alias("v")).where("u != v").unionAll(found), "links")
        members = work.cut(live.where("not hub").select("key", "id"), "members")
        work.drop(needs, edges, labels, rows, open_)
        edges, rest, several = more, members, 2 * several
