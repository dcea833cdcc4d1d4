"""Array kernels of the text index, run inside tasks: texts of a block to the places of their trigrams, and places to ids.

Texts are taken in slices of about a megabyte, so that memory does not follow the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Places of a block, and the bits of a place.
PLACE_BITS = 15
PLACES = 1 << PLACE_BITS
#: From so many places on, a gram's places are a bit each; below, two bytes each.
AS_BITS = PLACES // 16
SLICE_BYTES = 1 << 20
#: Runs of places that are kept before a block's postings are given out; the rest of the block comes as further rows.
KEPT = 1 << 18
#: Bytes of a block's texts that are tested at one time.
TESTED_BYTES = 1 << 24


def _slices(words: pa.Array) -> Iterator[tuple[int, int]]:
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(words), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    lo = 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE_BYTES, "right")) - 1)
        yield lo, hi
        lo = hi


def _characters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, one after the other, and how many each has."""
    words = words.cast(pa.large_string())
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    if not len(data) or data.max() < 128:
        return data, np.diff(offsets)
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:  # bytes that are no text
        texts = [np.frombuffer(w.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for w in words.cast(pa.large_binary()).to_pylist()]
        return np.concatenate(texts), np.array([len(t) for t in texts])
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, np.diff(begins[offsets - offsets[0]])


def _grams(words: pa.Array, places: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Each run of three characters with the places of its texts, in order and once each."""
    points, lengths = _characters(words)
    if len(points) < 3:
        return
    place = np.repeat(np.arange(len(words)), lengths)
    within = np.flatnonzero(place[:-2] == place[2:])
    if not len(within):
        return
    if points.dtype == np.uint8:
        c = points.astype(np.int64)
        runs = ((c[:-2] << 14 | c[1:-1] << 7 | c[2:]) << PLACE_BITS | places[place[:-2]])[within]
        runs.sort()
        runs = runs[np.concatenate([[True], runs[1:] != runs[:-1]])]
        codes, at = runs >> PLACE_BITS, runs & (PLACES - 1)
        bits = 7
    else:
        c = points.astype(np.int64)
        codes, at = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[within], places[place[:-2]][within]
        order = np.lexsort((at, codes))
        codes, at = codes[order], at[order]
        once = np.concatenate([[True], (codes[1:] != codes[:-1]) | (at[1:] != at[:-1])])
        codes, at = codes[once], at[once]
        bits = 21
    begins = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    at = at.astype(np.uint16)
    mask = (1 << bits) - 1
    for code, lo, hi in zip(codes[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(at)]):
        yield chr(code >> 2 * bits) + chr(code >> bits & mask) + chr(code & mask), at[lo:hi]


def packed(at: np.ndarray) -> bytes:
    """Different places as bytes: two for each, or a bit for each place of a block if they are many."""
    if len(at) < AS_BITS:
        return at.astype(np.uint16).tobytes()
    held = np.zeros(PLACES, bool)
    held[at] = True
    return np.packbits(held, bitorder="little").tobytes()


def unpacked(held: bytes) -> np.ndarray:
    if len(held) < 2 * AS_BITS:
        return np.frombuffer(held, np.uint16)
    return np.flatnonzero(np.unpackbits(np.frombuffer(held, np.uint8), bitorder="little"))


def _among(at: np.ndarray, held: bytes) -> np.ndarray:
    """Those of the places (in order) that are held."""
    if len(held) < 2 * AS_BITS:
        other = np.frombuffer(held, np.uint16)
        if not len(other):
            return at[:0]
        found = np.minimum(np.searchsorted(other, at), len(other) - 1)
        return at[other[found] == at]
    bits = np.frombuffer(held, np.uint8)
    return at[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words, block, place), a block's rows together and in order, to (gram, block, n, held): the places of each gram in each block.

    A long block may give a gram several rows, of different places.
    """
    now, seen, kept = None, {}, 0

    def rows() -> pa.RecordBatch:
        grams = list(seen)
        at = [np.concatenate(v) if len(v) > 1 else v[0] for v in seen.values()]
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(np.full(len(grams), now, np.int64)), pa.array([len(a) for a in at], pa.int64()),
                                           pa.array([packed(a) for a in at], pa.binary())], ["gram", "block", "n", "held"])

    for batch in batches:
        blocks, places, words = batch.column("block").to_numpy(), batch.column("place").to_numpy(), batch.column("words")
        ends = [*(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)] if len(blocks) else []
        lo = 0
        for hi in ends:
            if blocks[lo] != now:
                if seen:
                    yield rows()
                now, seen, kept = int(blocks[lo]), {}, 0
            for a, b in _slices(words[lo:hi]):
                for gram, at in _grams(words[lo + a:lo + b], places[lo + a:lo + b].astype(np.int64)):
                    seen.setdefault(gram, []).append(at)
                    kept += 1
                if kept >= KEPT:
                    yield rows()
                    seen, kept = {}, 0
            lo = hi
    if seen:
        yield rows()


class Needles:
    """Search texts by their number, each with its grams, the rarest first."""

    def __init__(self, needles: list[tuple[int, str, list[str]]]) -> None:
        self.numbers = np.array([n for n, _, _ in needles], np.int64)
        self.texts = [t for _, t, _ in needles]
        self.others = [g[1:] for _, _, g in needles]
        self.led: dict[str, list[int]] = {}
        for i, (_, _, g) in enumerate(needles):
            self.led.setdefault(g[0], []).append(i)

    def candidates(self, held: dict[str, bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(needle, places) of a block that hold all of a needle's grams."""
        for lead in self.led.keys() & held.keys():
            first = unpacked(held[lead])
            for i in self.led[lead]:
                at = first
                for g in self.others[i]:
                    at = _among(at, held[g]) if g in held else at[:0]
                    if not len(at):
                        break
                if len(at):
                    yield i, at

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, bytes], pa.RecordBatch | None]]:
        """(block, its postings, a run of its texts or none) of rows in order of block, the postings (place -1) first.  The last of a block has none."""
        now, held = None, {}
        for batch in batches:
            blocks, places = batch.column("block").to_numpy(), batch.column("place").to_numpy()
            ends = [*(np.flatnonzero((blocks[1:] != blocks[:-1]) | ((places[1:] < 0) != (places[:-1] < 0))) + 1).tolist(), len(blocks)] if len(blocks) else []
            lo = 0
            for hi in ends:
                if blocks[lo] != now:
                    if now is not None:
                        yield now, held, None
                    now, held = int(blocks[lo]), {}
                run = batch.slice(lo, hi - lo)
                if places[lo] >= 0:
                    yield now, held, run
                else:
                    for gram, more in zip(run.column("gram").to_pylist(), run.column("held").to_pylist()):
                        held[gram] = packed(np.union1d(unpacked(held[gram]), unpacked(more))) if gram in held else more
                lo = hi
        if now is not None:
            yield now, held, None

    def places(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(no, block, place) of candidates, by postings alone."""
        for block, held, _ in self.rows(batches):
            for i, at in self.candidates(held):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), self.numbers[i])), pa.array(np.full(len(at), block, np.int64)), pa.array(at.astype(np.int32))], ["no", "block", "place"])

    def found(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, nos): each text that holds needles, with their numbers."""
        texts: list[pa.RecordBatch] = []
        size, asked = 0, None
        for _, held, run in self.rows(batches):
            if run is not None:
                asked = list(self.candidates(held)) if asked is None else asked
                if asked:
                    texts.append(run)
                    size += run.column("words").nbytes
            if texts and (run is None or size >= TESTED_BYTES):
                yield from self._tested(pa.Table.from_batches(texts).combine_chunks(), asked)
                texts, size = [], 0
            if run is None:
                asked = None

    def _tested(self, texts: pa.Table, asked: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        place, words, ids = (texts.column(c).combine_chunks() for c in ("place", "words", "id"))
        place = place.to_numpy()
        row_of = np.full(PLACES, -1)
        row_of[place] = np.arange(len(place))
        rows, which = [], []
        for i, at in asked:
            row = row_of[at]
            row = row[row >= 0]
            if len(row) and len(self.texts[i]) > 3:  # a needle of three characters is its gram
                row = row[pc.match_substring(words.take(pa.array(row)), self.texts[i]).to_numpy(zero_copy_only=False)]
            if len(row):
                rows.append(row)
                which.append(np.full(len(row), i))
        if not rows:
            return
        rows, which = np.concatenate(rows), np.concatenate(which)
        order = np.argsort(rows, kind="stable")
        rows, nos = rows[order], self.numbers[which[order]]
        begins = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        ends = np.concatenate([begins, [len(rows)]])
        most = 10_000
        for lo in range(0, len(begins), most):
            hi = min(lo + most, len(begins))
            lists = pa.ListArray.from_arrays(pa.array((ends[lo:hi + 1] - ends[lo]).astype(np.int32)), pa.array(nos[ends[lo]:ends[hi]]))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[begins[lo:hi]])), lists], ["id", "nos"])
