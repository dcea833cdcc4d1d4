"""Array kernels that run inside tasks: texts of an Arrow batch to word and shingle hashes.

Every kernel works on slices of about a megabyte of text, so that its memory
does not follow the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
U64 = np.uint64
#: Random odd multipliers; the same in every task.
ODD = _rng.integers(1 << 62, (1 << 63) - 1, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)
#: One random number for each byte; capitals have those of small letters.
BYTE = _rng.integers(1, (1 << 63) - 1, 256, dtype=np.int64).astype(U64)
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = int(ODD[0]) | 5


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base & (2**64 - 1)))
    out[0] = U64(1)
    return np.multiply.accumulate(out)


class Powers:
    """base^i and base^-i modulo 2^64, made longer when a longer slice comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = _powers(BASE, n)
            self.down = _powers(pow(BASE, -1, 2**64), n)
        return self.up, self.down


POWERS = Powers()


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of whole texts; null is empty."""
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def _words_of_block(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of a block; breaks: where a text begins."""
    word = ~SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    np.logical_not(word[:-1], out=first[1:])
    first[breaks[breaks < len(data)]] = True
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = first[1:] | ~word[1:]
    starts = np.flatnonzero(first & word)
    ends = np.flatnonzero(last & word) + 1
    up, down = POWERS.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE[data] * up[:len(data)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, and the number of the first word of each text (one more at the end)."""
    if len(data) == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    starts, hashes, lo = [], [], 0
    while lo < len(data):
        hi = min(len(data), lo + 2 * SLICE_BYTES)
        if hi < len(data):
            gaps = np.flatnonzero(SPACE[data[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
            else:  # one very long word: up to its end
                ahead = np.flatnonzero(SPACE[data[hi:]])
                hi = hi + int(ahead[0]) + 1 if len(ahead) else len(data)
        s, h = _words_of_block(data[lo:hi], offsets[(offsets >= lo) & (offsets < hi)] - lo)
        starts.append(s + lo)
        hashes.append(h)
        lo = hi
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingles(hashes: np.ndarray, firsts: np.ndarray, n: int) -> list[np.ndarray]:
    """For each text the hashes of its distinct n-word shingles, sorted; with fewer words, of the whole sequence."""
    if len(hashes) >= n:
        all_ = hashes[:len(hashes) - n + 1] * ODD[1]
        for j in range(1, n):
            all_ = all_ + hashes[j:len(hashes) - n + 1 + j] * ODD[1 + j]
        all_ = mix(all_ + ODD[20 + n])
    out = []
    for a, b in zip(firsts[:-1], firsts[1:]):
        if b - a >= n:
            s = np.sort(all_[a:b - n + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = mix((hashes[a:b] * ODD[1:1 + b - a]).sum(keepdims=True) + ODD[20 + (b - a)])
        else:
            s = np.zeros(0, U64)
        out.append(s)
    return out


class Circulant:
    """MinHash signatures from two permutations of 2^20 places.

    The first permutation is the shingle's hash, which gives its place; the
    second numbers the places, and coordinate k reads it shifted by k in a
    circle.  A shingle's numbers for all coordinates are therefore one
    contiguous run of the second permutation.
    """

    BITS = 20

    def __init__(self, bands: int, rows: int, seed: int = 7) -> None:
        self.bands, self.rows = bands, rows
        k = bands * rows
        numbers = np.random.default_rng(seed).permutation(1 << self.BITS).astype(np.uint32)
        # Overlapping records of k numbers: one is copied at a time, and a block of them stays in the cache.
        self.runs = np.ndarray(1 << self.BITS, dtype=f"V{4 * k}", buffer=np.concatenate([numbers, numbers[:k]]), strides=(4,))
        self.step = max(64, (1 << 17) // k)

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        return self.runs[(hashes >> U64(64 - self.BITS)).astype(np.int64)].view(np.uint32).reshape(len(hashes), -1)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        best = self._numbers(hashes[:self.step]).min(axis=0)
        for lo in range(self.step, len(hashes), self.step):
            np.minimum(best, self._numbers(hashes[lo:lo + self.step]).min(axis=0), out=best)
        return best

    def _blocks(self, sets: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
        """Minima of each set; small sets are taken together, a block of places at a time."""
        block: list[np.ndarray] = []
        size = 0
        for s in sets:
            if len(s) >= self.step:
                yield from self._together(block)
                block, size = [], 0
                yield self.minima(s)
                continue
            if size + len(s) > self.step:
                yield from self._together(block)
                block, size = [], 0
            block.append(s)
            size += len(s)
        yield from self._together(block)

    def _together(self, block: list[np.ndarray]) -> np.ndarray | tuple[()]:
        if not block:
            return ()
        ends = np.cumsum([len(s) for s in block])
        return np.minimum.reduceat(self._numbers(np.concatenate(block)), np.concatenate([[0], ends[:-1]]), axis=0)

    def keys(self, sets: Iterable[np.ndarray]) -> np.ndarray:
        """One row of band keys for each (non-empty) set of shingle hashes."""
        sig = np.stack(list(self._blocks(sets))).astype(U64)
        sig = sig.reshape(-1, self.bands, self.rows)
        out = np.zeros(sig.shape[:2], U64) + np.arange(1, self.bands + 1, dtype=U64) * ODD[40]
        for j in range(self.rows):
            out = mix(out + sig[:, :, j] * ODD[41 + j])
        return out.view(np.int64)


#: Bits of a hash that order a set; the owner's number stands above them.
PLACE = 44
PLACES = U64((1 << PLACE) - 1)


def placed(hashes: np.ndarray, owners: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Sorted distinct (owner, place) numbers of the hashes, but for those at bad; owners: below 2^19, one for each hash."""
    c = hashes >> U64(64 - PLACE)
    c |= owners << U64(PLACE)
    c[bad] = U64(2**64 - 1)
    c.sort()
    c = c[:len(c) - len(bad)]
    first = np.empty(len(c), bool)
    first[:1] = True
    np.not_equal(c[1:], c[:-1], out=first[1:])
    return c[first]


class Windows:
    """Band keys from one order: each key is of the places that follow one of `bands` fixed points of a circle, `rows` of them.

    Sets at similarity s share a key with probability s^rows a band, as MinHash has it, but bands that do not
    overlap are drawn without replacement, which misses less.  For sets of at least LEAST.
    """

    LEAST = 64

    def __init__(self, bands: int, rows: int) -> None:
        self.bands, self.rows = bands, rows
        self.points = np.array([(i << PLACE) // bands for i in range(bands)], U64)

    def keys(self, c: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """One row of keys for each owner, in order; c as `placed` gives it."""
        owners = owners.astype(U64)
        lo = np.searchsorted(c, owners << U64(PLACE))
        n = np.searchsorted(c, (owners + U64(1)) << U64(PLACE)) - lo
        at = np.searchsorted(c, ((owners << U64(PLACE))[:, None] | self.points).ravel()).reshape(-1, self.bands) - lo[:, None]
        out = np.zeros(at.shape, U64) + np.arange(1, self.bands + 1, dtype=U64) * ODD[40]
        for j in range(self.rows):
            out = mix(out + (c[(at + j) % n[:, None] + lo[:, None]] & PLACES) * ODD[41 + j])
        return out.view(np.int64)


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Arrow list array from flat values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


def packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Arrow binary array of eight-byte numbers from flat values."""
    offsets = np.concatenate([[0], np.cumsum(8 * lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, lengths) of what `packed` gives."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]].view(np.int64), np.diff(offsets) // 8
