"""The prefix tree of conversations, built as a z-fast trie of compacted nodes.

A conversation is a sequence of turns; every prefix is known by its length and a 128-bit hash.  A compacted node is
an edge: the prefixes of lengths above its parent's up to its own (its extent).  It is hashed at its handle, the prefix whose length
is the two-fattest number of these lengths (the one that the highest power of two divides).  A fat binary search
asks for the two-fattest length of an interval, so it takes as many look-ups as the logarithm of a conversation's length.

Conversations are inserted in batches.  All those that wait are located at once; where several leave the tree at one place by the
same next turn, one of them, drawn by a hash, is inserted, the edges they leave are split, and the others are located again,
further down.  A draw leaves, on average, no more than half of a place's conversations on one way, so rounds grow with the logarithm of the table.

Long conversations are cut into pieces of PIECE turns, with a node at each cut, so that no row is long.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronofold.operators import scans
from chronofold.runtime import Work, broadcast_if_small

#: Turns of a piece, a power of two; conversations whose numbers are joined before they are hashed.
PIECE, NUMBERS = 1024, 1024
#: Nodes whose handles (seven numbers each) may be broadcast.
HANDLES = 200_000
NOTHING = hashlib.sha256(b"").hexdigest()

_KEY = ["depth", "h1", "h2"]


# --- Sequences

def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, no, role, digest, points): the turns of each conversation, numbered from 0.

    By turn, null first; equal ones by role, then by the digest of the text.  Texts themselves stay behind.
    """
    text = F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.md5(text).alias("digest"), F.char_length(text).cast("long").alias("points"))
    chunk = F.coalesce(F.floor(F.col("turn") / PIECE), F.lit(-(1 << 60)))
    return scans.ordinals(rows, ["conv_id"], chunk, ["turn", "role", "digest"], "no").drop("turn")


def with_shared_openings(turns: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and their turns (conv_id, pos, role, digest, points) once rebuilt.

    Conversation c opens with the first h turns of conversation c - c % 100, h = crc32(decimal c) % 6; then come its own after the
    first h.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({
        "opener": F.expr("conv_id - conv_id % 100"), "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6})
    length = convs.select(F.col("conv_id").alias("opener"), F.col("n").alias("opened"))
    shared = F.least("h", F.coalesce("opened", F.lit(0))).alias("shared")
    made = work.cut(convs.join(length, "opener", "left").select("conv_id", "opener", "h", shared), "made")
    opening = (made.where("h > 0").join(turns.where("no < 5").withColumnRenamed("conv_id", "opener"), "opener").where("no < h")
               .select("conv_id", (F.col("no") + 1).alias("pos"), "role", "digest", "points"))
    own = (turns.join(broadcast_if_small(made), "conv_id").where("no >= h")
           .select("conv_id", (F.col("shared") + F.col("no") - F.col("h") + 1).alias("pos"), "role", "digest", "points"))
    return made.select("conv_id"), opening.unionAll(own)


def _pieces(turns: DataFrame, work: Work) -> DataFrame:
    """(conv_id, base, end, path): pieces of conversations, path the prefixes base + 1 to end as (h1, h2, points so far).

    A prefix's hash is the exclusive or of its turns' hashes, which include their position.
    """
    turn = [F.xxhash64(F.lit(i), "pos", "role", "digest").alias(f"h{i}") for i in (1, 2)]
    rows = turns.select("conv_id", "pos", F.expr(f"(pos - 1) div {PIECE}").alias("piece"), *turn, "points")
    run = W.partitionBy("conv_id", "piece").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("conv_id", "piece", "pos", F.bit_xor("h1").over(run).alias("h1"), F.bit_xor("h2").over(run).alias("h2"), F.sum("points").over(run).alias("points"))
    pieces = rows.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "points"))).alias("path"))
    pieces = work.cut(pieces, "pieces")
    # What the pieces before the last one of a long conversation add to those behind them.
    last = F.try_element_at("path", F.lit(-1))
    whole = pieces.where(F.size("path") == PIECE).select("conv_id", "piece", last["h1"].alias("b1"), last["h2"].alias("b2"), last["points"].alias("bp"))
    past = W.partitionBy("conv_id").orderBy("piece").rowsBetween(W.unboundedPreceding, 0)
    before = whole.select("conv_id", (F.col("piece") + 1).alias("piece"), F.bit_xor("b1").over(past).alias("b1"), F.bit_xor("b2").over(past).alias("b2"),
                          F.sum("bp").over(past).alias("bp"))
    moved = F.transform("path", lambda x: F.struct(x["h1"].bitwiseXOR(F.coalesce("b1", F.lit(0))).alias("h1"), x["h2"].bitwiseXOR(F.coalesce("b2", F.lit(0))).alias("h2"),
                                                   (x["points"] + F.coalesce("bp", F.lit(0))).alias("points")))
    base = F.col("piece") * PIECE
    start = F.struct(F.coalesce("b1", F.lit(0)).alias("h1"), F.coalesce("b2", F.lit(0)).alias("h2"), F.coalesce("bp", F.lit(0)).alias("points")).alias("start")
    return (pieces.join(broadcast_if_small(before), ["conv_id", "piece"], "left")
            .select("conv_id", base.alias("base"), (base + F.size("path")).alias("end"), start, moved.alias("path")))


# --- The z-fast trie
#
# Nodes: above, depth (its prefixes have lengths above + 1 to depth), top (the parent's prefix), path (its prefixes).

NODE = "above long, depth long, top struct<h1:long,h2:long,points:long>, path array<struct<h1:long,h2:long,points:long>>"


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the highest power of two divides."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return high.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), bits))


def _at(path: Column, base: Column, depth: Column) -> Column:
    """The prefix of a length, null outside the path."""
    i = (depth - base).cast("int")
    return F.when((i > 0) & (i <= F.size(path)), F.get(path, i - 1))


def _look_up(rows: DataFrame, table: DataFrame, prefix: str, on: str) -> DataFrame:
    """rows with a table's columns where its (on_depth, on_1, on_2) is the prefix of that name, at length prefix_depth."""
    same = ((F.col(f"{prefix}_depth") == F.col(f"{on}_depth")) & (F.col(f"{prefix}.h1") == F.col(f"{on}_1")) & (F.col(f"{prefix}.h2") == F.col(f"{on}_2")))
    return rows.join(table, same, "left").drop(f"{on}_depth", f"{on}_1", f"{on}_2")


def _located(waiting: DataFrame, nodes: DataFrame, few: bool, steps: int) -> DataFrame:
    """Where each waiting piece leaves the tree: `low`, the length of the last node on its way; `exit`, how long a prefix is in the tree;
    edge, the node in whose edge that is (null where it is a node itself)."""
    f = fattest(F.col("above"), F.col("depth"))
    handle = _at(F.col("path"), F.col("above"), F.col("handle_depth"))
    last = F.try_element_at("path", F.lit(-1))
    handles = (nodes.select("above", "depth", "path", f.alias("handle_depth"))
               .select("handle_depth", handle["h1"].alias("handle_1"), handle["h2"].alias("handle_2"), F.col("above").alias("n_above"), F.col("depth").alias("n_depth"),
                       last["h1"].alias("n_1"), last["h2"].alias("n_2")))
    first = F.try_element_at("path", F.lit(1))
    names = nodes.select((F.col("above") + 1).alias("name_depth"), first["h1"].alias("name_1"), first["h2"].alias("name_2"),
                         F.struct("above", "depth", "path").alias("edge"))
    if few:
        handles, names = F.broadcast(handles), F.broadcast(names)
    rows = waiting.withColumns({"a": F.col("low"), "b": F.col("end"), "found": F.lit(None).cast("struct<above:long,depth:long,h1:long,h2:long>")})
    for _ in range(steps):
        rows = rows.withColumn("p_depth", F.when(F.col("a") < F.col("b"), fattest(F.col("a"), F.col("b"))))
        rows = rows.withColumn("p", _at(F.col("path"), F.col("base"), F.col("p_depth")))
        hit = F.col("n_depth").isNotNull()
        rows = _look_up(rows, handles, "p", "handle").withColumns({
            "found": F.when(hit, F.struct(F.col("n_above").alias("above"), F.col("n_depth").alias("depth"), F.col("n_1").alias("h1"), F.col("n_2").alias("h2"))).otherwise(F.col("found")),
            "a": F.coalesce("n_depth", "a"), "b": F.when(hit | F.col("p_depth").isNull(), F.col("b")).otherwise(F.col("p_depth") - 1),
        }).drop("n_above", "n_depth", "n_1", "n_2", "p", "p_depth")
    # The last node whose handle is on the way: the piece passes its extent, or leaves in its edge.
    here = _at(F.col("path"), F.col("base"), F.col("found.depth"))
    passed = F.coalesce((here["h1"] == F.col("found.h1")) & (here["h2"] == F.col("found.h2")), F.lit(False))
    rows = rows.withColumn("low", F.when(F.col("found").isNull(), F.col("low")).when(passed, F.col("found.depth")).otherwise(F.col("found.above")))
    rows = rows.withColumn("q_depth", F.col("low") + 1).withColumn("q", _at(F.col("path"), F.col("base"), F.col("q_depth")))
    rows = _look_up(rows, names, "q", "name")
    ahead = F.slice("path", (F.col("low") - F.col("base") + 1).cast("int"), F.size("edge.path"))
    same = F.zip_with(ahead, F.slice("edge.path", F.lit(1), F.size(ahead)), lambda x, y: (x["h1"] == y["h1"]) & (x["h2"] == y["h2"]))
    differs = F.array_position(same, False)
    length = F.when(differs > 0, differs - 1).otherwise(F.size(same))
    return (rows.withColumn("exit", F.col("low") + F.when(F.col("edge").isNull(), 0).otherwise(length))
            .withColumn("edge", F.when(F.col("exit") < F.col("edge.depth"), F.struct(F.col("edge.above").alias("above"), F.col("q.h1").alias("h1"), F.col("q.h2").alias("h2"))))
            .drop("a", "b", "found", "q", "q_depth"))


def _split(nodes: DataFrame, cuts: DataFrame, few: bool) -> DataFrame:
    """Nodes cut at the lengths that cuts (above, c1, c2, at) names for them."""
    first = F.try_element_at("path", F.lit(1))
    cuts = cuts.groupBy("above", "c1", "c2").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    cuts = cuts.select(F.col("above").alias("c_above"), "c1", "c2", "ats")
    rows = nodes.join(F.broadcast(cuts) if few else cuts, (F.col("above") == F.col("c_above")) & (first["h1"] == F.col("c1")) & (first["h2"] == F.col("c2")), "left")
    ends = F.concat(F.array("above"), F.coalesce("ats", F.array().cast("array<bigint>")), F.array("depth"))
    rows = rows.select("above", "top", "path", F.posexplode(F.slice(ends, F.lit(2), F.size(ends) - 1)).alias("i", "to"), ends.alias("ends"))
    rows = rows.withColumn("from", F.get("ends", F.col("i")))
    return rows.select(F.col("from").alias("above"), F.col("to").alias("depth"),
                       F.when(F.col("i") == 0, F.col("top")).otherwise(_at(F.col("path"), F.col("above"), F.col("from"))).alias("top"),
                       F.slice("path", (F.col("from") - F.col("above") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int")).alias("path"))


def compacted_nodes(pieces: DataFrame, work: Work, few: int = HANDLES) -> tuple[DataFrame, int]:
    """The nodes of the trie over pieces (conv_id, base, end, start, path), see NODE, and a bound of their number.  The root has no row."""
    last = F.try_element_at("path", F.lit(-1))
    # Equal pieces are one from here on.
    waiting = (pieces.groupBy("end", last["h1"].alias("e1"), last["h2"].alias("e2")).agg(F.min(F.struct("conv_id", "base", "start", "path")).alias("p"))
               .select("p.conv_id", "p.base", "end", "p.start", "p.path", F.col("p.base").alias("low")))
    waiting = work.cut(waiting, "waiting")
    nodes, most = work.cut(work.spark.createDataFrame([], NODE), "nodes"), 0
    while True:
        steps, n = waiting.agg(F.max(F.col("end") - F.col("low")), F.count("*")).first()
        if not n:
            work.drop(waiting)
            return nodes, most
        small, all_few = most <= few, n <= few
        most += 2 * n  # a piece adds one leaf and cuts one edge at most
        located = work.cut(_located(waiting, nodes, small, int(steps).bit_length() + 1), "located")
        out = F.col("exit") < F.col("end")
        following = _at(F.col("path"), F.col("base"), F.col("exit") + 1)
        draw = F.struct(F.xxhash64("conv_id", "base").alias("draw"), "conv_id", "base")
        drawn = (located.where(out).groupBy("exit", following["h1"].alias("f1"), following["h2"].alias("f2")).agg(F.min(draw).alias("d"))
                 .select("d.conv_id", "d.base"))
        drawn = work.cut(drawn, "drawn")
        inside = F.broadcast(drawn) if all_few else drawn
        from_ = F.when(F.col("exit") == F.col("base"), F.col("start")).otherwise(_at(F.col("path"), F.col("base"), F.col("exit")))
        tail = F.slice("path", (F.col("exit") - F.col("base") + 1).cast("int"), (F.col("end") - F.col("exit")).cast("int"))
        leaves = located.join(inside, ["conv_id", "base"], "left_semi").select(F.col("exit").alias("above"), F.col("end").alias("depth"), from_.alias("top"), tail.alias("path"))
        cuts = (located.where("edge is not null and exit > edge.above")
                .select(F.col("edge.above").alias("above"), F.col("edge.h1").alias("c1"), F.col("edge.h2").alias("c2"), F.col("exit").alias("at")))
        more = work.cut(_split(nodes, cuts, all_few).unionAll(leaves), "nodes")
        rest = work.cut(located.where(out).join(inside, ["conv_id", "base"], "left_anti").select(*waiting.columns), "waiting")
        work.drop(waiting, nodes, located, drawn)
        waiting, nodes = rest, more


# --- The tree

def _up(nodes: DataFrame, jumps: list[DataFrame], values: dict[str, Column], work: Work, small: bool) -> DataFrame:
    """nodes with sums (or least values) over subtrees, themselves included, by jumps of 1, 2, 4, ... levels."""
    at = [F.col(f"p_{k}").alias(k) for k in _KEY]
    for jump in jumps:
        far = nodes.select(*_KEY, *values).join(_hint(jump, small), _KEY)
        sums = far.groupBy(*at).agg(*[v.alias(f"s_{n}") for n, v in values.items()])
        both = {n: (F.least(n, f"s_{n}") if n == "conv_id" else F.col(n) + F.coalesce(f"s_{n}", F.lit(0))) for n in values}
        old, nodes = nodes, work.cut(nodes.join(_hint(sums, small), _KEY, "left").withColumns(both).drop(*[f"s_{n}" for n in values]), "sums")
        work.drop(old)
    return nodes


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _jumps(nodes: DataFrame, work: Work, small: bool) -> list[DataFrame]:
    """(key, p_key): each node's ancestor 1, 2, 4, ... levels up, as far as there is one."""
    jump = work.cut(nodes.where("depth > 0").select(*_KEY, F.col("above").alias("p_depth"), F.col("top.h1").alias("p_h1"), F.col("top.h2").alias("p_h2")), "jump")
    out = []
    while not jump.isEmpty():
        out.append(jump)
        up = jump.select(*[F.col(k).alias(f"p_{k}") for k in _KEY], *[F.col(f"p_{k}").alias(f"q_{k}") for k in _KEY])
        jump = work.cut(jump.join(_hint(up, small), [f"p_{k}" for k in _KEY]).select(*_KEY, *[F.col(f"q_{k}").alias(f"p_{k}") for k in _KEY]), "jump")
    return out


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, h1, h2, digest): SHA-256 of the numbers of the conversations that end at each prefix.

    NUMBERS of them are joined at a time; what is left to one task a prefix is to hash these strings in order.
    """
    parts = (ends.groupBy(*_KEY, F.floor(F.col("conv_id") / NUMBERS).alias("part")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
             .select(*_KEY, "part", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")))

    def run(batches):
        at, hashed = None, None
        for batch in batches:
            keys, digests = [], []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids"))):
                if key != at:
                    if at is not None:
                        keys.append(at)
                        digests.append(hashed.hexdigest())
                    at, hashed = key, hashlib.sha256(ids.encode())
                else:
                    hashed.update(b"," + ids.encode())
            yield record(keys, digests)
        if at is not None:
            yield record([at], [hashed.hexdigest()])

    def record(keys, digests):
        return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int64()) for i in range(3)), pa.array(digests, pa.string())], [*_KEY, "digest"])

    return parts.repartition(*_KEY).sortWithinPartitions(*_KEY, "part").mapInArrow(run, "depth long, h1 long, h2 long, digest string")


def prefix_tree(convs: DataFrame, turns: DataFrame, work: Work, few: int = HANDLES) -> DataFrame:
    """A row for each different prefix of the conversations, the empty one included.

    convs: conv_id, without repeats; turns: (conv_id, pos, role, digest, points), pos 1, 2, ... without gaps, points the code points of
    the turn's text.  Returns conv_id (the smallest of the conversations that begin so), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.  Work grows with the turns, times the logarithm of their number.
    """
    pieces = work.cut(_pieces(turns, work), "paths")
    nodes, most = compacted_nodes(pieces, work, few)
    small = most <= few  # what has a row a node may be broadcast
    last = F.try_element_at("path", F.lit(-1))
    ending = pieces.groupBy("conv_id").agg(F.max(F.struct(F.col("end").alias("depth"), last["h1"].alias("h1"), last["h2"].alias("h2"))).alias("e"))
    ends = convs.join(ending, "conv_id", "left").select("conv_id", *[F.coalesce(f"e.{k}", F.lit(0)).alias(k) for k in _KEY])
    ends = work.cut(ends, "ends")
    here = ends.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    # The root stands above all, if there is a conversation.
    none = F.struct(F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("points"))
    root = convs.limit(1).select(F.lit(None).cast("long").alias("above"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast(nodes.schema["top"].dataType).alias("top"),
                                 F.array().cast(nodes.schema["path"].dataType).alias("path"))
    own = F.coalesce(last, none)
    all_ = nodes.unionAll(root).withColumns({"h1": own["h1"], "h2": own["h2"]})
    below = nodes.groupBy(F.col("above").alias("depth"), F.col("top.h1").alias("h1"), F.col("top.h2").alias("h2")).agg(F.count("*").alias("n_children"))
    tree = (all_.join(_hint(here, small), _KEY, "left").join(_hint(below, small), _KEY, "left")
            .withColumns({"n_convs": F.coalesce("n_convs", F.lit(0)), "n_children": F.coalesce("n_children", F.lit(0))})
            .withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")))
    tree = work.cut(tree, "tree")
    jumps = _jumps(tree, work, small)
    narrow = tree.select(*_KEY, "conv_id", "n_convs", "n_leaves", (own["points"] - F.coalesce("top.points", F.lit(0))).alias("points"))
    counts = _up(narrow, jumps, {"conv_id": F.min("conv_id"), "n_convs": F.sum("n_convs"), "n_leaves": F.sum("n_leaves")}, work, small)
    saving = counts.withColumn("saved", (F.col("n_convs") - 1) * F.col("points"))
    saved = _up(saving, jumps, {"saved": F.sum("saved")}, work, small)
    parents = saved.select(F.col("depth").alias("above"), F.col("h1").alias("t1"), F.col("h2").alias("t2"), F.col("conv_id").alias("above_id"))
    whole = (tree.select(*_KEY, "above", "top", "path", "n_children", F.col("top.h1").alias("t1"), F.col("top.h2").alias("t2")).join(_hint(saved, small), _KEY)
             .join(_hint(parents, small), ["above", "t1", "t2"], "left").join(_hint(_digests(ends), small), _KEY, "left"))
    at = F.when(F.col("depth") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.col("above") + 1, F.col("depth")))
    rows = whole.withColumn("at", F.explode(at)).withColumn("lowest", F.col("at") == F.col("depth"))
    before = F.when(F.col("at") == F.col("above") + 1, F.col("top.points")).otherwise(_at(F.col("path"), F.col("above"), F.col("at") - 1)["points"])
    # On an edge, what is saved above a prefix is not saved in its subtree.
    skipped = (F.col("n_convs") - 1) * (before - F.col("top.points"))
    return rows.select(
        "conv_id", F.col("at").alias("depth"), F.when(F.col("at") == F.col("above") + 1, F.col("above_id")).when(F.col("at") > 0, F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(F.col("lowest"), F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") - F.coalesce(skipped, F.lit(0))).alias("saved_tokens"),
        F.when(F.col("lowest"), F.coalesce("digest", F.lit(NOTHING))).otherwise(F.lit(NOTHING)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The prefix tree of rebuilt conversations: see with_shared_openings and prefix_tree.

    conversations: conv_id (integer), turn, role, text; other columns are not read.  A null role or text is empty.  Rows with a null
    conv_id belong to no conversation and are left out.  Repeated rows are turns of their own.  An empty table gives no rows.
    """
    work = Work(conversations.sparkSession, "trie")
    turns = work.cut(turns_in_order(conversations), "turns")
    convs, rebuilt = with_shared_openings(turns, work)
    return prefix_tree(convs, rebuilt, work)
