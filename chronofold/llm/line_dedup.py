"""Fuzzy line deduplication: MinHash of character shingles, banding, exact Jaccard, one line per component."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chronofold.llm import kernels as K
from chronofold.llm.linking import NARROW_ROWS, linked
from chronofold.llm.session import long_batches
from chronofold.runtime import Work, broadcast_if_small

#: Characters in a shingle where one width serves lines of every length.
SHINGLE = 8
#: 12 bands of 3: a pair at similarity 0.8 shares no band with probability 1.8e-4.
BANDS, ROWS = 12, 3


@dataclass(frozen=True)
class Width:
    """Lines of least to below-most characters, compared by shingles of some characters in bands of rows.

    windows: bands by which sets of K.Windows.LEAST shingles or more meet, if not by MinHash.
    """

    shingle: int
    least: int
    most: int
    bands: int
    rows: int
    windows: int = 0

    @property
    def marked(self) -> bool:
        """Whether sets are so small that their marks tell them apart."""
        return self.most <= 1 << COUNT


#: Widths by length.  One changed character spoils `shingle` shingles, so that a copy stays at 0.8 from 10 * shingle - 1 characters
#: on: 19, 29, 49 and 79, each below what its width begins to serve alone.  Neighbours overlap by a quarter, the most that
#: lengths of lines at 0.8 differ by.  Short shingles are common, so they have more rows a band; a pair at 0.8 shares no band with
#: probability 1.5e-4, 1.5e-4, 1.6e-4 and 1.8e-4 at most.  A line has two widths at most.
BY_LENGTH = (Width(2, 16, 36, 29, 6), Width(3, 0, 100, 29, 6), Width(5, 80, 240, 22, 5, 20), Width(8, 192, 1 << 62, BANDS, ROWS, BANDS))
#: Bits of a mark that count the set; the others are parities of the shingles that fall on them.
COUNT = 7
#: Characters whose shingles are hashed at one time, and lines.
BLOCK, LINES = 1 << 20, 1 << 16
#: Band keys that one task gathers at most, but for keys of many lines.
KEYS = 2_000_000
#: A bucket of more members, or of more pairs a member that may link, is left to the rounds of `linked`; pairs looked at together.
CROWD, LINKS, PAIRS = 1024, 8, 1 << 20

#: One random number for each character of the first plane.
LETTER = K.mix(np.arange(1, (1 << 16) + 1, dtype=K.U64) * K.ODD[9])


def normal(line: str) -> str:
    """What lines are compared by: small letters, one space between words."""
    return " ".join(line.lower().split())


#: White space but for the line feed and the space.
OTHER_SPACE = [c for c in map(chr, range(1 << 16)) if c.isspace() and c not in " \n"]


def _normal_lines(text: str) -> list[str]:
    """normal() of each line; most texts hold no space that it would change."""
    lines = text.lower().split("\n")
    if "  " in text or any(c in text for c in (OTHER_SPACE[:8] if text.isascii() else OTHER_SPACE)):
        return [" ".join(x.split()) for x in lines]
    return [x.strip(" ") for x in lines]


def _shingle_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width characters, in order: a polynomial of the characters' random numbers."""
    h = letters = LETTER[codes & 0xFFFF] + (codes >> 16) * K.ODD[10]
    step = 1
    while 2 * step <= width:
        h = h[:-step] * K.ODD[10 + step] + h[step:]
        step *= 2
    while step < width:
        h = h[:-1] * K.ODD[20 + step] + letters[step:]
        step += 1
    return h


def _line_hashes(line: str, width: int) -> np.ndarray:
    """Shingle hashes of one normalised line; a shorter line is one shingle."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < width:
        codes = np.concatenate([codes, np.full(width - len(codes), 0x110000, np.uint32)])
    parts = [_shingle_hashes(codes[lo:lo + BLOCK + width - 1], width) for lo in range(0, len(codes) - width + 1, BLOCK)]
    return np.concatenate(parts)


def _blocks(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of lines, LINES at most, that together stay below BLOCK characters, or of one long line."""
    at = 0
    while at < len(lengths):
        end, size = at, 0
        while end < len(lengths) and end - at < LINES and (end == at or size + lengths[end] < BLOCK):
            size += lengths[end]
            end += 1
        yield at, end
        at = end


def _placed(lines: list[str], width: int) -> np.ndarray:
    """Distinct shingles of a block of lines, ordered by line and place."""
    if len(lines) == 1:
        hashes = _line_hashes(lines[0], width)
        return K.placed(hashes, np.zeros(len(hashes), K.U64), np.zeros(0, np.int64))
    padded = [x if len(x) >= width else x + "\ud800" * (width - len(x)) for x in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    if any(len(x) < width for x in lines):
        codes = np.where(codes == 0xD800, np.uint32(0x110000), codes)
    lengths = np.array([len(x) for x in padded])
    ends = np.cumsum(lengths)
    hashes = _shingle_hashes(codes, width)
    bad = (ends[:, None] - np.arange(1, width)).ravel()  # these reach into the next line
    return K.placed(hashes, np.repeat(np.arange(len(lines), dtype=K.U64), lengths)[:len(hashes)], bad[bad < len(hashes)])


def _ends(c: np.ndarray, n: int) -> np.ndarray:
    """Where each line's shingles begin, and the end of the last."""
    return np.searchsorted(c, np.arange(n, dtype=K.U64) << K.U64(K.PLACE)).tolist() + [len(c)]


def _mark(c: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The size of each set below the parities of what falls on each of the other bits.

    Sets differ in at least as many shingles as their marks in parities.
    """
    bits = K.U64(1) << ((c & K.PLACES) % K.U64(64 - COUNT) + K.U64(COUNT))
    return (np.bitwise_xor.reduceat(bits, ends[:-1]) | np.diff(ends).astype(K.U64)).view(np.int64)


def _serving(widths: tuple[Width, ...], line: str) -> list[int]:
    """Which widths a line is compared by, one or two."""
    return [i for i, w in enumerate(widths) if w.least <= len(line) < w.most]


KEYED = "id long, h2 long, doc_id long, line_no int, mark long, keys binary"


def _line_keys(widths: tuple[Width, ...], percent: int):
    """A row for each different line of a block of documents and each of its widths: two hashes, where it is first, mark and band keys.

    The lowest bit of id tells the second width from the first.
    """
    def keyed(seen: dict[str, tuple[int, int]], hashing: list[K.Circulant], order: list[K.Windows | None]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(b"".join(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in seen), np.int64).reshape(-1, 2)
        places = np.array(list(seen.values()), np.int64)
        lines = list(seen)
        sizes = np.array([len(x) for x in lines])
        slot = np.zeros(len(lines), np.int64)

        def rows(at: np.ndarray, mark: np.ndarray, keys: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array((marks[at, 0] & -2) | slot[at]), pa.array(marks[at, 1]), pa.array(places[at, 0]), pa.array(places[at, 1].astype(np.int32)),
                 pa.array(mark), K.packed(keys, lengths)], ["id", "h2", "doc_id", "line_no", "mark", "keys"])

        for w, width in enumerate(widths):
            serves = np.flatnonzero((sizes >= width.least) & (sizes < width.most))
            for lo, hi in _blocks(sizes[serves].tolist()):
                at = serves[lo:hi]
                c = _placed([lines[i] for i in at], width.shingle)
                ends = _ends(c, len(at))
                n = np.diff(ends)
                # Of two near sets both have LEAST shingles, or neither has more than near ones of fewer have.
                large = np.flatnonzero(n >= order[w].LEAST) if order[w] else n[:0]
                small = np.flatnonzero(percent * n < 100 * order[w].LEAST) if order[w] else np.arange(len(at))
                lengths = np.zeros(len(at), np.int64)
                flat = []
                if len(small):
                    places_of = (c & K.PLACES) << K.U64(64 - K.PLACE)
                    flat.append((small, hashing[w].keys(places_of[ends[i]:ends[i + 1]] for i in small) ^ K.ODD[50 + w].view(np.int64)))
                if len(large):
                    flat.append((large, order[w].keys(c, large) ^ K.ODD[55 + w].view(np.int64)))
                for of, keys in flat:
                    lengths[of] += keys.shape[1]
                values = np.zeros(lengths.sum(), np.int64)
                begin = np.cumsum(lengths) - lengths
                for of, keys in flat:
                    values[begin[of][:, None] + np.arange(keys.shape[1])] = keys
                    begin[of] += keys.shape[1]
                yield rows(at, _mark(c, ends) if width.marked else np.zeros(len(at), np.int64), values, lengths)
            slot[serves] += 1
        alone = np.flatnonzero(slot == 0)
        if len(alone):
            none = np.zeros(len(alone), np.int64)
            yield rows(alone, none, none[:0], none)

    def run(batches):
        hashing = [K.Circulant(w.bands, w.rows) for w in widths]
        order = [K.Windows(w.windows, w.rows) if w.windows else None for w in widths]
        for batch in batches:
            seen: dict[str, tuple[int, int]] = {}
            size = 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                if text is None or doc is None:
                    continue
                for no, line in enumerate(_normal_lines(text)):
                    if line and (line not in seen or (doc, no) < seen[line]):
                        size += len(line)
                        seen[line] = (doc, no)
                if size > 4 * BLOCK:
                    yield from keyed(seen, hashing, order)
                    seen, size = {}, 0
            if seen:
                yield from keyed(seen, hashing, order)
    return run


def _may_link(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """False where marks tell that two sets are not near: too different in size, or in too many parities."""
    n, m = a & ((1 << COUNT) - 1), b & ((1 << COUNT) - 1)
    differ = np.bitwise_count((a ^ b).view(K.U64) >> K.U64(COUNT)).astype(np.int64)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * differ <= (100 - percent) * (n + m))


DEALT = "part int, keys binary, ids binary, marks binary"


def _deal(parts: int):
    """The keys of a block of lines with the lines' ids and marks, a row for each part; a key decides its part."""
    def run(batches):
        for batch in batches:
            keys, sizes = K.unpacked(batch.column("keys"))
            owners = np.repeat(np.arange(len(sizes)), sizes)
            part = (keys.view(K.U64) % K.U64(parts)).astype(np.int32)
            order = np.argsort(part)
            sizes = np.bincount(part, minlength=parts)
            some = np.flatnonzero(sizes)
            owners = owners[order]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), K.packed(keys[order], sizes[some]), K.packed(batch.column("id").to_numpy()[owners], sizes[some]),
                 K.packed(batch.column("mark").to_numpy()[owners], sizes[some])], ["part", "keys", "ids", "marks"])
    return run


def _meet(percent: int):
    """What the whole buckets of a part link: pairs (null, u, v) that may be near, or the members (key, id, hub) of a bucket with very
    many of them."""
    def run(batches):
        rows = [[K.unpacked(b.column(c))[0] for c in ("keys", "ids", "marks")] for b in batches]
        if not rows:
            return
        keys, ids, marks = (np.concatenate(x) for x in zip(*rows))
        del rows
        order = np.argsort(keys)
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        several = np.zeros(len(keys), bool)
        several[1:] |= same
        several[:-1] |= same
        keys, order = keys[several], order[several]
        ids, marks = ids[order], marks[order]
        order = np.lexsort((ids, keys))
        keys, ids, marks = keys[order], ids[order], marks[order]
        once = np.ones(len(keys), bool)
        once[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        keys, ids, marks = keys[once], ids[once], marks[once]
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(begin, len(keys)))
        for size in np.unique(sizes[sizes > 1]).tolist():
            of = begin[sizes == size]
            i, j = np.triu_indices(size, 1) if size <= CROWD else (np.zeros(0, np.int64),) * 2
            step = max(1, PAIRS // max(len(i), size))
            for at in range(0, len(of), step):
                rows = of[at:at + step, None]
                near = _may_link(marks[rows + i], marks[rows + j], percent)
                crowded = (near.sum(axis=1) > LINKS * size) | (size > CROWD)
                bucket, k = np.nonzero(near & ~crowded[:, None])
                x, y = rows[bucket, 0] + i[k], rows[bucket, 0] + j[k]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.array(ids[x]), pa.array(ids[y])], ["key", "u", "v"])
                rows = (rows[crowded] + np.arange(size)).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys[rows]), pa.array(ids[rows]), pa.array(np.repeat(ids[of[at:at + step][crowded]], size))], ["key", "u", "v"])
    return run


def _line_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of lines, each behind a character that tells the width; a block of lines at a time."""
    lines = column.to_pylist()
    for lo, hi in _blocks([len(x) for x in lines]):
        by_width: dict[str, list[str]] = {}
        for x in lines[lo:hi]:
            by_width.setdefault(x[0], []).append(x[1:])
        sets = {}
        for mark, xs in by_width.items():
            c = _placed(xs, ord(mark))
            ends = _ends(c, len(xs))
            c &= K.PLACES
            sets[mark] = iter([c[a:b] for a, b in zip(ends[:-1], ends[1:])])
        for x in lines[lo:hi]:
            yield next(sets[x[0]])


def _pick_lines(widths: tuple[Width, ...]):
    """The normalised text of the lines that a document is asked for, behind the character of its width."""
    def run(batches):
        for batch in batches:
            ids, texts = [], []
            wanted = batch.column("wanted")
            numbers, nodes = (wanted.flatten().field(c).to_pylist() for c in ("line_no", "id"))
            at = 0
            for text, n in zip(batch.column("text"), wanted.value_lengths().to_pylist()):
                lines = text.as_py().split("\n")
                for no, node in zip(numbers[at:at + n], nodes[at:at + n]):
                    if no < len(lines):
                        line = normal(lines[no])
                        serving = _serving(widths, line)
                        if node & 1 < len(serving):
                            ids.append(node)
                            texts.append(chr(widths[serving[node & 1]].shingle) + line)
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
    return run


def _keep_lines(text_column: str, keep: str, dropped: str | None):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            texts, gone = [], []
            for text, kept in zip(batch.column(at), batch.column(keep).to_pylist()):
                text = text.as_py()
                if text is not None and kept is not None:
                    lines, left = text.split("\n"), set(kept)
                    gone.append([i for i, x in enumerate(lines) if i not in left and x and not x.isspace()])
                    if gone[-1]:
                        out = set(gone[-1])
                        text = "\n".join([x for i, x in enumerate(lines) if i not in out])
                else:
                    gone.append([])
                texts.append(text)
            batch = batch.set_column(at, text_column, pa.array(texts, pa.string())).drop_columns([keep])
            yield batch.append_column(dropped, pa.array(gone, pa.list_(pa.int32()))) if dropped else batch
    return run


def dedup_lines(docs: DataFrame, percent: int = 80, bands: int = BANDS, rows: int = ROWS, dropped: str | None = None,
                widths: tuple[Width, ...] | None = None) -> DataFrame:
    """docs with one line kept of each class of near-equal lines, the others taken out of the texts.

    docs: doc_id (integer), text, and any other columns, which stay as they are.
    Lines end at a line feed and are compared in small letters with white space
    collapsed.  A line's set is its distinct shingles, or the whole
    line if shorter; two lines are linked when 100 * intersection >= percent *
    union, and a class is what links reach.  Shingles have 8 characters, in bands and rows as given; with
    widths (BY_LENGTH) they have those of the line's length, and lines are linked that are near enough
    by a width that serves both: so a copy with one changed character is linked from 19 characters on.  The line that is first by
    (doc_id, line number) stays.  Lines of white space alone belong to no class
    and stay.  No row is removed: a text whose lines all go becomes
    empty, a null text stays null, a row with a null doc_id is left as it is.  Rows that repeat
    a doc_id keep the same line numbers, so copies of a row stay equal.
    dropped: name for a new column of the removed line numbers; it may not clash.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    work = Work(spark, "lines")
    widths = widths or (Width(SHINGLE, 0, 1 << 62, bands, rows),)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = work.cut(narrow.mapInArrow(_line_keys(widths, percent), KEYED), "lines")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() * max(w.bands for w in widths) // KEYS))
    with long_batches(spark):  # of some numbers a row
        dealt = lines.select("id", "mark", "keys").mapInArrow(_deal(parts), DEALT)
        met = work.cut(dealt.repartitionById(parts, "part").mapInArrow(_meet(percent), "key long, u long, v long"), "met")
    pairs = work.cut(met.where("key is null").select("u", "v").distinct(), "pairs")
    members = met.where("key is not null").select("key", F.col("u").alias("id"), F.col("v").alias("hub"))
    # The texts of all lines that may be near another one are picked from the documents once.
    ids = work.cut(pairs.select(F.col("u").alias("id")).unionAll(pairs.select("v")).unionAll(members.select("id")).distinct(), "ids")
    first = (lines.select("id", "doc_id", "line_no").join(broadcast_if_small(ids, NARROW_ROWS), "id", "left_semi").groupBy("id")
             .agg(F.min(F.struct("doc_id", "line_no")).alias("p")).select("id", "p.*"))
    wanted = work.cut(first.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "id")).alias("wanted")), "wanted")
    texts = work.cut(narrow.where("text is not null").join(broadcast_if_small(wanted, NARROW_ROWS // 4), "doc_id")
                     .mapInArrow(_pick_lines(widths), "id long, text string"), "texts")
    work.drop(wanted, ids)

    def with_texts(needs: DataFrame) -> DataFrame:
        return texts.join(broadcast_if_small(needs, NARROW_ROWS), "id")

    def first_width(id_: Column) -> Column:
        """A line is one under both of its widths, so what it is linked to by either is one class."""
        return id_.bitwiseAND(F.lit(-2).cast("long"))

    labels, _ = linked(members, with_texts, _line_sets, percent, work, several=64, pairs=pairs, unit=first_width)
    lines_once = lines.where(F.col("id") == first_width(F.col("id"))).select("id", "h2", "doc_id", "line_no")
    groups = (lines_once.join(broadcast_if_small(labels, NARROW_ROWS), "id", "left")
              .groupBy(F.coalesce("component", "id").alias("g"), F.when(F.col("component").isNull(), F.col("h2")).alias("h"))
              .agg(F.min(F.struct("doc_id", "line_no")).alias("p")))
    kept = work.cut(groups.groupBy(F.col("p.doc_id").alias("__llm_id")).agg(F.collect_list("p.line_no").alias("__llm_keep")), "kept")
    work.drop(lines, texts, met, pairs)
    out = docs.join(kept, F.col("doc_id").cast("long") == F.col("__llm_id"), "left").drop("__llm_id")
    # A document with lines of which none is kept has no row in kept.
    out = out.withColumn("__llm_keep", F.when(F.col("doc_id").isNotNull(), F.coalesce("__llm_keep", F.array().cast("array<int>"))))
    schema = T.StructType([*docs.schema.fields, *([T.StructField(dropped, T.ArrayType(T.IntegerType()))] if dropped else [])])
    return out.mapInArrow(_keep_lines("text", "__llm_keep", dropped), schema)
