"""The members of long arrays in JSON documents, one document of any size read by many tasks.

A document is cut behind every closing brace (the reader's line separator), so a file is split like any text file.  Where a
split begins, nothing tells whether it is inside a string or how deep.  So each split is first summed up for both
cases: whether its quotes change the state, and how far its brackets lead.  A running value over the splits' summaries
gives each one's true start, and a second reading cuts the members out.  What crosses a split is put together from its parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from chronofold.runtime import Work, broadcast_if_small

#: Bytes of text looked through at one time.
SLAB = 1 << 20
_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1
_MARK = _STEP != 0
_MARK[ord(",")] = True


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _slabs(batches) -> Iterator[tuple[str, int, dict, bytes]]:
    """(file, block, first row, bytes): the text of each split in order, a slab at a time."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        file, block, value = (batch.column(c) for c in ("file", "block", "value"))
        new = np.ones(batch.num_rows, bool)
        new[1:] = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1])).to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(value).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(new).tolist() + [batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            while a < b:
                end = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:b]), SLAB, "right")))
                yield file[a].as_py(), block[a].as_py(), batch, a, ("}".join(value[a:min(end, b)].to_pylist()) + "}").encode()
                a = end


def _quotes(b: np.ndarray) -> np.ndarray:
    """Where a string begins or ends; an odd run of backslashes before it makes a quote a plain character."""
    quote = b == 34
    back = np.flatnonzero(b == 92)
    if len(back):
        last = np.append(np.diff(back) > 1, True)
        first = np.concatenate(([True], np.diff(back) > 1))
        behind = back[last][(back[last] - back[first]) % 2 == 0] + 1
        quote[behind[behind < len(b)]] = False
    return quote


def _summaries(batches):
    """(file, block, odd, outside, inside): whether the split's quotes are odd in number; how deep it leads if it begins outside a string, or inside one."""
    at, total = None, (0, 0, 0)
    for file, block, _, _, data in _slabs(batches):
        if at != (file, block):
            if at is not None:
                yield _summary(at, total)
            at, total = (file, block), (0, 0, 0)
        b = np.frombuffer(data, np.uint8)
        state = (np.cumsum(_quotes(b)) + total[0]) & 1
        step = _STEP[b]
        total = int(state[-1]), total[1] + int(step[state == 0].sum()), total[2] + int(step[state == 1].sum())
    if at is not None:
        yield _summary(at, total)


def _summary(at, total):
    return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, *total)], ["file", "block", "odd", "outside", "inside"])


#: What a row is: a member, a document without its members, or the array that was begun last in a split.
MEMBER, FRAME, LAST = 0, 1, 2
#: All of it, or the part at the end of a split, at the start of one, or all of a split.
WHOLE, HEAD, TAIL, MIDDLE = 0, 1, 2, 3

ROWS = "file string, block long, what int, part int, array string, n long, text string"


class _Item:
    """The member or document being read, in the parts that its splits hold."""

    def __init__(self, what: int, out: list, open_: bool) -> None:
        self.what, self.out, self.text, self.n, self.inherited = what, out, [], 0, open_

    def add(self, text: bytes) -> None:
        self.text.append(text)

    def end(self, array: str | None) -> None:
        self._put(TAIL if self.inherited else WHOLE, array)

    def cut(self, array: str | None) -> None:
        self._put(MIDDLE if self.inherited else HEAD, array)

    def _put(self, part: int, array: str | None) -> None:
        text = b"".join(self.text)
        text = text.lstrip(b" \t\r\n") if part in (WHOLE, HEAD) else text
        text = text.rstrip(b" \t\r\n") if part in (WHOLE, TAIL) else text
        if text or part != WHOLE:
            self.out.append((self.what, part, array, None if self.inherited else self.n, text.decode()))
            self.n += not self.inherited
        self.text, self.inherited = [], False


class _Split:
    """Cuts the members at some depth out of one split."""

    def __init__(self, depth: int, block: int, start: int, inside: bool) -> None:
        self.at, self.block, self.depth, self.inside = depth, block, start, inside
        self.rows: list[tuple] = []
        self.member, self.frame = _Item(MEMBER, self.rows, start >= depth), _Item(FRAME, self.rows, start > 0)
        self.array, self.arrays = None, 0

    def read(self, data: bytes) -> None:
        b = np.frombuffer(data, np.uint8)
        state = (np.cumsum(_quotes(b)) + self.inside) & 1
        spots = np.flatnonzero(_MARK[b] & (state == 0))
        step = _STEP[b[spots]]
        after = self.depth + np.cumsum(step)
        before = after - step
        opens, ends = (step > 0) & (after == self.at), (step < 0) & (before == self.at)
        event = opens | ends | ((step == 0) & (after == self.at)) | ((step < 0) & (after == 0))
        within, done = self.depth >= self.at, 0
        for p, opened, ended, depth in zip(*(x[event].tolist() for x in (spots, opens, ends, after))):
            if opened:
                self.arrays += 1
                self.array = f"{self.block}:{self.arrays}"
                mark = f'"{self.array}"'.encode() if data[p] == 0x5B else b""
                self.frame.add(data[done:p + 1] + mark)
                self.member.n, within, done = 0, True, p + 1
                continue
            if within:
                self.member.add(data[done:p])
                self.member.end(self.array)
                within, done = not ended, p if ended else p + 1
            if depth == 0:
                self.frame.add(data[done:p + 1])
                self.frame.end(None)
                done = p + 1
        (self.member if within else self.frame).add(data[done:])
        if len(spots):
            self.depth = int(after[-1])
        self.inside = bool(state[-1])

    def close(self) -> list[tuple]:
        if self.depth >= self.at:
            self.member.cut(self.array)
        if self.depth > 0:
            self.frame.cut(None)
        self.rows.append((LAST, WHOLE, self.array, None, ""))
        return self.rows


def _cut_out(depth: int):
    def run(batches):
        at, split = None, None
        for file, block, batch, row, data in _slabs(batches):
            if at != (file, block):
                if split is not None:
                    yield record(at, split.close())
                at = file, block
                start, string = batch.column("start")[row].as_py(), batch.column("string")[row].as_py()
                if start is None:
                    raise RuntimeError(f"{file} was split otherwise when it was read again, at {block}")
                split = _Split(depth, block, start, bool(string))
            split.read(data)
            if split.rows:
                yield record(at, split.rows)
                split.rows.clear()
        if split is not None:
            yield record(at, split.close())

    def record(at, rows):
        what, part, array, n, text = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([at[0]] * len(rows)), pa.array([at[1]] * len(rows), pa.int64()), pa.array(what, pa.int32()), pa.array(part, pa.int32()),
             pa.array(array, pa.string()), pa.array(n, pa.int64()), pa.array(text, pa.string())], ["file", "block", "what", "part", "array", "n", "text"])

    return run


def _whole(rows: DataFrame) -> DataFrame:
    """(file, block, array, n, text): items of one kind, those in several parts put together; block is where an item begins."""
    w = W.partitionBy("file").orderBy("block", F.col("part") == HEAD).rowsBetween(W.unboundedPreceding, 0)
    parts = rows.where(F.col("part") != WHOLE).withColumn("begun", F.last(F.when(F.col("part") == HEAD, F.col("block")), True).over(w))
    head = F.col("part") == HEAD
    joined = (parts.groupBy("file", F.col("begun").alias("block"))
              .agg(F.max(F.when(head, F.col("array"))).alias("array"), F.max(F.when(head, F.col("n"))).alias("n"),
                   F.array_sort(F.collect_list(F.struct("block", F.when(head, 0).otherwise(1).alias("o"), "text"))).alias("ts"))
              .select("file", "block", "array", "n", F.array_join(F.col("ts.text"), "").alias("text")))
    return rows.where(F.col("part") == WHOLE).select("file", "block", "array", "n", "text").unionAll(joined).where("text <> ''")


@dataclass(frozen=True)
class Documents:
    """members: (file, array, pos, text), the members of every array at a depth, pos from 0 in each.
    frames: (file, block, n, text), the documents in order of block and n, each such array holding its name alone."""

    members: DataFrame
    frames: DataFrame

    def arrays(self, shape: str, at: Column) -> DataFrame:
        """(file, array, d): the frames' arrays at a column of d, the frame read by a schema."""
        d = self.frames.select("file", "block", "n", F.from_json("text", shape).alias("d"))
        return d.select("file", F.get(at, F.lit(0)).alias("array"), "d")

    def members_of(self, arrays: DataFrame) -> DataFrame:
        """Members of some arrays (file, array, and any other columns)."""
        return self.members.join(broadcast_if_small(arrays), ["file", "array"])


def read_documents(spark: SparkSession, path: str, depth: int) -> Documents:
    """The documents of files, split at the arrays that lie `depth` deep: 1 for a list, 2 for the members of
    {"features": [...]}, 3 for {"results": {"bindings": [...]}}.

    A file may hold several documents, one behind the other; text is UTF-8.  What is left of a document without these members has to fit
    a row, as has each member; the file has not.  Members of objects at that depth are in no array and are dropped.
    """
    work = Work(spark, "json")
    pieces = _pieces(spark, path)
    sums = work.cut(pieces.mapInArrow(_summaries, "file string, block long, odd long, outside long, inside long"), "splits")
    past = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("odd").over(past), F.lit(0)) % 2
    starts = sums.withColumn("string", odd).withColumn("deeper", F.when(F.col("string") == 0, F.col("outside")).otherwise(F.col("inside")))
    starts = work.cut(starts.select("file", "block", "string", F.coalesce(F.sum("deeper").over(past), F.lit(0)).alias("start")), "starts")
    # One row a split, so this is small beside the files; the rows of a split stay together and in order.
    rows = pieces.join(F.broadcast(starts), ["file", "block"], "left").mapInArrow(_cut_out(depth), ROWS)
    rows = work.cut(rows, "rows")
    work.drop(sums, starts)
    last = rows.where(F.col("what") == LAST).select("file", "block", F.last("array", True).over(past).alias("last"))
    members = _whole(rows.where(F.col("what") == MEMBER)).join(broadcast_if_small(last), ["file", "block"])
    members = members.select("file", "block", F.coalesce("array", "last").alias("array"), "n", "text")
    counts = members.groupBy("file", "array", "block").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("file", "array").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = work.cut(counts.select("file", "array", "block", before.alias("before")).where("before > 0"), "counts")
    members = (members.join(broadcast_if_small(counts), ["file", "array", "block"], "left")
               .select("file", "array", (F.col("n") + F.coalesce("before", F.lit(0))).cast("int").alias("pos"), "text"))
    frames = _whole(rows.where(F.col("what") == FRAME)).select("file", "block", "n", "text")
    return Documents(members, frames)
