"""Near-duplicate documents by SimHash: fingerprints meet at the words of covering codes.

Fingerprints have 64 bits.  Two that differ in at most d bits differ in at most floor(d / 2) of one half, so each
half has its own anchors: the words of a covering code.  A fingerprint's home is the anchor within covering radius of its
half; it is also replicated to every anchor within covering radius plus floor(d / 2), and each home fingerprint is compared
with all that come to its anchor.  The codes are products of perfect codes (binary Golay and Hamming codes, single bits), for which
radius and excess are counted block by block: that is never less than what a pair needs, and far fewer anchors than
the whole ball holds (one code over all 64 bits, two Golay blocks, takes 1,237 anchors a fingerprint; two halves take 44 to 211).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from chronofold.llm import kernels as K
from chronofold.llm.components import components
from chronofold.runtime import Work, broadcast_if_small

#: Words of a shingle; bits that linked fingerprints may differ in.
WORDS, DISTANCE = 4, 4
SEED = 42
#: Shingles hashed at one time; texts above this many bytes are folded with arrays.
BLOCK, LONG = 1 << 16, 1 << 20
#: Comparisons a fingerprint that a code may need on average before one with more anchors is taken.
COMPARISONS = 50_000
#: Members and home fingerprints of a group; an anchor with more is cut into several groups.
MEMBERS, HUBS = 1 << 14, 1 << 11
#: Cells of a block of comparisons; fingerprints replicated by one task.
CELLS, A_TASK = 1 << 20, 50_000

U64 = np.uint64
SMALL = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Each byte with its eight bits spread over the bytes of a long, so that sums of up to 255 of them count bits.
SPREAD = np.array([sum((b >> k & 1) << (8 * k) for k in range(8)) for b in range(256)], U64)


# --- Fingerprints

def _one_space(text: bytes) -> bytes:
    """The words of a text in small letters, one space between them."""
    text = text.translate(SMALL)
    if len(text) <= LONG:
        return b" ".join(text.split())
    data = np.frombuffer(text, np.uint8)
    space = K.SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]
    return np.where(space, np.uint8(32), data)[keep].tobytes().strip(b" ")


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The unsigned fingerprint of a text; 0 where it has no word."""
    line = _one_space(text)
    if not line:
        return 0
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(line))
    n = max(1, len(starts) - words + 1)
    starts, ends = starts[:n], ends[-n:]
    counts = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_digest
    for lo in range(0, n, BLOCK):
        spans = zip(starts[lo:lo + BLOCK].tolist(), ends[lo:lo + BLOCK].tolist())
        raw = np.frombuffer(b"".join([hashed(line[a:b], SEED) for a, b in spans]), np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(SPREAD[raw], np.arange(0, len(raw), 255), axis=0)
        counts += sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "big")


def _fingerprints(words: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("id")
            for lo, hi, data, offsets in K.texts_of(batch.column("text")):
                data, ends = data.tobytes(), offsets.tolist()
                found = [fingerprint(data[a:b], words) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(np.array(found, U64).view(np.int64))], ["id", "fp"])
    return run


# --- Covering codes

@dataclass(frozen=True)
class Block:
    """A cyclic code on some bits: the multiples of a polynomial over two elements; every word is within radius of one of them."""

    bits: int
    generator: int
    radius: int

    @property
    def checks(self) -> int:
        return self.generator.bit_length() - 1

    def syndrome(self, word: int) -> int:
        while word.bit_length() > self.checks:
            word ^= self.generator << (word.bit_length() - 1 - self.checks)
        return word

    def patterns(self, excess: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, syndrome, excess) of all patterns of up to radius + excess bits; excess counts from the radius on."""
        unit = [self.syndrome(1 << i) for i in range(self.bits)]
        rows = []
        for weight in range(min(self.bits, self.radius + excess) + 1):
            at = np.array(list(combinations(range(self.bits), weight)), np.int64).reshape(comb(self.bits, weight), weight)
            words = (np.int64(1) << at).sum(axis=1)
            checks = np.bitwise_xor.reduce(np.array(unit, np.int64)[at], axis=1)
            rows.append((words, checks, np.full(len(words), max(0, weight - self.radius), np.int64)))
        return tuple(np.concatenate(x) for x in zip(*rows))


# The generator polynomials of the binary Golay and the Hamming code, as in any textbook.
GOLAY = Block(23, 0b110001110101, 3)
HAMMING = Block(7, 0b1011, 1)
BIT = Block(1, 1, 0)


class Code:
    """The product of some blocks over the low bits of a half; what bits are left over does not count."""

    def __init__(self, blocks: tuple[Block, ...], excess: int) -> None:
        self.checks = sum(b.checks for b in blocks)
        bits = sum(b.bits for b in blocks)
        self.anchors = 1 << (bits - self.checks)
        self.mask = (1 << bits) - 1
        patterns, checks, over = (np.zeros(1, np.int64),) * 3
        units, at, row = [0] * 32, 0, 0
        for b in blocks:
            p, c, e = b.patterns(excess)
            kept = []
            for had in range(excess + 1):
                i, j = np.flatnonzero(over == had), np.flatnonzero(e <= excess - had)
                kept.append(((patterns[i][:, None] | p[j] << at).ravel(), (checks[i][:, None] | c[j] << row).ravel(), (had + e[j] + 0 * i[:, None]).ravel()))
            patterns, checks, over = (np.concatenate(x) for x in zip(*kept))
            for i in range(b.bits):
                units[at + i] = b.syndrome(1 << i) << row
            at, row = at + b.bits, row + b.checks
        order = np.argsort(checks, kind="stable")
        self.patterns, self.home = patterns[order], over[order] == 0
        self.first = np.searchsorted(checks[order], np.arange((1 << self.checks) + 1))
        #: Syndromes of the four bytes of a half.
        self.bytes = np.zeros((4, 256), np.int64)
        for i in range(4):
            for b in range(256):
                for k in range(8):
                    self.bytes[i, b] ^= units[8 * i + k] if b >> k & 1 else 0

    @property
    def replicas(self) -> float:
        """Anchors to which a half goes, on average."""
        return len(self.patterns) / (1 << self.checks)

    def places(self, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, home) of every anchor within radius plus excess of each half (a word of 32 bits)."""
        s = self.bytes[0][halves & 255] ^ self.bytes[1][halves >> 8 & 255] ^ self.bytes[2][halves >> 16 & 255] ^ self.bytes[3][halves >> 24]
        n = self.first[s + 1] - self.first[s]
        rows = np.repeat(np.arange(len(halves)), n)
        at = np.arange(len(rows)) + np.repeat(self.first[s] - (np.cumsum(n) - n), n)
        return rows, (halves[rows] ^ self.patterns[at]) & self.mask, self.home[at]


#: From few anchors and replicas to many: 2^12 and 22 a half, 2^16 and 40, 2^21 and 106, with two differing bits a half.
CODES = ((GOLAY,), (GOLAY, HAMMING), (GOLAY, *[BIT] * 9))


@lru_cache(maxsize=2)
def code(blocks: tuple[Block, ...], excess: int) -> Code:
    return Code(blocks, excess)


def code_for(fingerprints: int, excess: int) -> tuple[Block, ...]:
    """The code with the fewest replicas that leaves COMPARISONS a fingerprint, the finest one beyond.  Each finds every pair."""
    for blocks in CODES[:-1]:
        c = code(blocks, excess)
        if 2 * fingerprints * c.replicas / c.anchors <= COMPARISONS:
            return blocks
    return CODES[-1]


def _replicas(blocks: tuple[Block, ...], excess: int):
    """(key, fp, home): each fingerprint at all its anchors of both halves."""
    def run(batches):
        c = code(blocks, excess)
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for half in (0, 1):
                rows, anchors, home = c.places(fps >> (32 * half) & 0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays([pa.array(anchors | half << 32), pa.array(fps[rows]), pa.array(home)], ["key", "fp", "home"])
    return run


# --- Comparison at an anchor

#: Rows of a group: a home fingerprint to compare with the members, one that is a member too, a member alone.
HUB, BOTH, MEMBER = 0, 1, 2


def links(fps: np.ndarray, kinds: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links within distance between hubs and members of a group: as many as tie together what such links connect.

    A hub is compared with the members outside its component so far.
    """
    nodes, where = np.unique(fps, return_inverse=True)
    hubs, members = np.unique(where[kinds != MEMBER]), np.unique(where[kinds != HUB])
    us: list[int] = []
    vs: list[int] = []
    if len(nodes) < 2 or not len(hubs):
        return us, vs
    bits, labels = nodes.view(U64), np.arange(len(nodes))
    while len(hubs):
        own, counts = np.unique(labels[hubs], return_counts=True)
        top = own[counts.argmax()]
        against = members
        if counts.max() > 1:  # hubs of one component together
            inside = labels[hubs] == top
            hubs = np.concatenate([hubs[inside], hubs[~inside]])
            against = members[labels[members] != top]
        size = max(1, CELLS // max(1, len(against)))
        block = hubs[:min(size, counts.max())] if counts.max() > 1 else hubs[:size]
        hubs = hubs[len(block):]
        row, col = np.nonzero(np.bitwise_count(bits[block][:, None] ^ bits[against]) <= distance)
        ends = np.searchsorted(row, np.arange(len(block) + 1))
        for i in np.unique(row):
            near, hub = against[col[ends[i]:ends[i + 1]]], block[i]
            parts, first = np.unique(labels[near], return_index=True)
            other = parts != labels[hub]
            if other.any():
                for v in near[first[other]]:
                    us.append(int(nodes[hub]))
                    vs.append(int(nodes[v]))
                labels[np.isin(labels, parts)] = labels[hub]
    return us, vs


def _compare(distance: int):
    def run(batches):
        left = None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("key", "part", "salt", "fp", "kind")]
            rows = rows if left is None else [np.concatenate(x) for x in zip(left, rows)]
            key, part, salt, fps, kinds = rows
            new = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (salt[1:] != salt[:-1])) + 1
            if len(new) == 0:
                left = rows
                continue
            yield found(fps, kinds, np.concatenate(([0], new)))
            left = [x[new[-1]:] for x in rows]
        if left is not None:
            yield found(left[3], left[4], np.array([0, len(left[3])]))

    def found(fps, kinds, ends):
        us, vs = [], []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if b - a > 1:
                u, v = links(fps[a:b], kinds[a:b], distance)
                us += u
                vs += v
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def fingerprint_links(fps: DataFrame, distance: int, work: Work, blocks: tuple[Block, ...] | None = None,
                      members: int = MEMBERS, hubs: int = HUBS) -> DataFrame:
    """(u, v): links between fingerprints that differ in at most `distance` bits, enough to tie each component together.

    fps: fp long, without repeats.  An anchor with more than `members` members or `hubs` home
    fingerprints is cut into groups, each pair of which meets in one, so that no anchor is one task.
    """
    excess = distance // 2
    n = fps.count()
    blocks = blocks or code_for(n, excess)
    parts = max(fps.sparkSession.sparkContext.defaultParallelism, -(-n // A_TASK))
    at = work.cut(fps.select("fp").repartition(parts, "fp").mapInArrow(_replicas(blocks, excess), "key long, fp long, home boolean"), "anchors")
    large = (at.groupBy("key").agg(F.count("*").alias("n"), F.count_if("home").alias("h")).where((F.col("n") > members) | (F.col("h") > hubs))
             .select("key", F.ceil(F.col("n") / members).cast("int").alias("salts"), F.ceil(F.greatest("h", F.lit(1)) / hubs).cast("int").alias("parts")))
    large = work.cut(large, "large")
    kind = F.when(F.col("home"), BOTH).otherwise(MEMBER)
    if large.isEmpty():
        rows = at.select("key", F.lit(0).alias("part"), F.lit(0).alias("salt"), "fp", kind.alias("kind"))
    else:
        marked = at.join(broadcast_if_small(large), "key", "left")
        salt, part = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
        cut = marked.where("salts is not null")
        rows = (marked.where("salts is null").select("key", F.lit(0).alias("part"), F.lit(0).alias("salt"), "fp", kind.alias("kind"))
                .unionAll(cut.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), salt.alias("salt"), "fp", F.lit(MEMBER)))
                .unionAll(cut.where("home").select("key", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "fp", F.lit(HUB))))
    grouped = rows.repartition("key", "part", "salt").sortWithinPartitions("key", "part", "salt")
    out = work.cut(grouped.mapInArrow(_compare(distance), "u long, v long"), "found")
    work.drop(at, large)
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """Each document's SimHash fingerprint and its class of near copies.

    docs: doc_id (integer) and text; other columns are not read.  Words are runs of bytes other than
    ASCII white space, A-Z lower-cased; shingles are `words` words with one space between them, repeats included, or the
    whole sequence if shorter.  A bit is 1 if it is set in more than half of the shingles' XXH64 (seed 42).  A text that
    is null or has no word has fingerprint zero.  Documents are linked when their fingerprints differ in at most
    `distance` bits, zero fingerprints like any other.

    Returns doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable), a row for each row
    of docs.  A null doc_id has a null component and links nothing.  Rows that repeat a doc_id are one document: if their
    fingerprints differ, links of any of them count.  An empty table gives no rows.
    """
    work = Work(docs.sparkSession, "simhash")
    narrow = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    signed = work.cut(narrow.mapInArrow(_fingerprints(words), "id long, fp long"), "signed")
    real = signed.where("id is not null")
    classes = work.cut(real.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    found = fingerprint_links(classes, distance, work).distinct()
    u, v = (classes.select(F.col("fp").alias(x), F.col("rep").alias(f"rep_{x}")) for x in "uv")
    edges = found.join(u, "u").join(v, "v").select(F.col("rep_u").alias("u"), F.col("rep_v").alias("v"))
    # An id whose rows differ ties the classes they are in.
    several = real.groupBy("id").agg(F.min("fp").alias("fp"), F.max("fp").alias("other")).where("fp < other").select("id")
    several = work.cut(real.join(several, "id", "left_semi").distinct(), "several")
    if not several.isEmpty():
        tied = several.join(classes, "fp").select("id", "rep")
        edges = edges.unionAll(tied.join(tied.groupBy("id").agg(F.min("rep").alias("u")), "id").select("u", F.col("rep").alias("v")))
    labels = components(work.cut(edges, "edges"), work)
    of = work.cut(classes.join(labels, classes.rep == labels.id, "left").select("fp", F.coalesce("component", "rep").alias("component")), "of")
    return (signed.join(broadcast_if_small(of), "fp", "left")
            .select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id")))
