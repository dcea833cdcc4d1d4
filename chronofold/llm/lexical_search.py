"""Ranked search without a document index: an automaton of all item terms counts them in the documents' text.

Terms are guarded by a space on either side, and so is every term of a text once the characters between
terms are spaces; so the automaton finds whole terms only, neighbours sharing their space.  Its outputs are the numbers of
terms, and each number leads to the items that hold the term.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from chronofold.llm import kernels as K
from chronofold.runtime import Work

#: Documents listed for an item.
MOST = 10
#: Terms are runs of characters other than these: ASCII but for digits and letters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of the terms of one automaton, each with what it costs beside its text; more items make several automata.
BLOCK_BYTES, A_TERM = 1 << 22, 24
#: Bytes of text counted at one time; cells and spots of a block of scores.
PIECE, CELLS = 1 << 20, 1 << 19

_TABLE = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Finds every whole term; the output is its number in the list."""
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, t in enumerate(terms):
        out.add_word(f" {t} ", i)
    out.make_automaton()
    return out


def pieces(text: bytes) -> Iterator[bytes]:
    """A text as small letters and spaces, in pieces that begin and end with a space and cut no term."""
    line = b" " + text.translate(_TABLE) + b" "
    lo, last = 0, len(line) - 1
    while lo < last:
        hi = last
        if hi - lo > PIECE:
            hi = line.rfind(b" ", lo + 1, lo + PIECE)
            hi = line.find(b" ", lo + PIECE) if hi < 0 else hi
        yield line[lo:hi + 1]
        lo = hi


_built: tuple[str, ahocorasick.Automaton] | None = None


def _counts(terms, name: str):
    """(doc_id, n, terms, tfs) of each document with a term: how many, and which of the automaton's how often."""
    def run(batches):
        global _built
        if _built is None or _built[0] != name:
            _built = name, automaton(terms.value)  # one for all tasks of a worker
        find, number = _built[1].iter, itemgetter(1)
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, _, data, offsets in K.texts_of(batch.column("text")):
                data, ends = data.tobytes(), offsets.tolist()
                rows, ns, sizes, found, often = [], [], [], [], []
                for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                    n, tf = 0, Counter()
                    for piece in pieces(data[a:b]):
                        n += len(piece.split())
                        tf.update(map(number, find(piece.decode("utf-8", "replace"))))
                    if n:
                        rows.append(lo + i)
                        ns.append(n)
                        sizes.append(len(tf))
                        found += tf.keys()
                        often += tf.values()
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows, pa.int64())), pa.array(ns, pa.int64()), K.lists(np.array(found, np.int32), np.array(sizes, np.int64)),
                     K.lists(np.array(often, np.int64), np.array(sizes, np.int64))], ["doc_id", "n", "terms", "tfs"])
    return run


class Postings:
    """Which items hold each term, and what an occurrence is worth to them."""

    def __init__(self, item_ids: list[int], rows: list[tuple[int, int, int]], weights: np.ndarray) -> None:
        """rows: (term, item, repeats) in the order of terms."""
        term, item, repeats = (np.array(x, np.int64) for x in zip(*rows))
        self.item_ids, self.items = np.array(item_ids, np.int64), item
        self.worth = weights[term] * repeats
        self.first = np.searchsorted(term, np.arange(len(weights) + 1))
        # Below 2^53 sums of doubles are exact; an occurrence counts less than 10^6 times its worth.
        self.small = np.bincount(item, self.worth.astype(float)).max() * 1e6 < 2**53

    def scores(self, terms: np.ndarray, impacts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A row of all items' scores for each document; sizes: terms a document."""
        n, width = self.first[terms + 1] - self.first[terms], len(self.item_ids)
        at = np.arange(n.sum()) + np.repeat(self.first[terms] - (np.cumsum(n) - n), n)
        cells = np.repeat(np.repeat(np.arange(len(sizes)) * width, sizes), n) + self.items[at]
        points = self.worth[at] * np.repeat(impacts, n)
        if self.small:
            out = np.bincount(cells, points, len(sizes) * width).astype(np.int64)
        else:
            out = np.zeros(len(sizes) * width, np.int64)
            np.add.at(out, cells, points)
        return out.reshape(len(sizes), width)


class Best:
    """The highest scores of each item so far, equal ones by ascending document."""

    def __init__(self, items: int, most: int) -> None:
        self.most, self.least = most, np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64)] * 3
        self.more: list[list[np.ndarray]] = []
        self.waiting = 0

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.least)
        self.more.append([item, docs[doc], scores[doc, item]])
        self.waiting += len(doc)
        if self.waiting > max(CELLS, 2 * self.most * len(self.least)):
            self.settle()

    def settle(self) -> list[np.ndarray]:
        item, doc, score = (np.concatenate(x) for x in zip(self.rows, *self.more))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        self.least[item[rank == self.most - 1]] = score[rank == self.most - 1]
        kept = rank < self.most
        self.rows, self.more, self.waiting = [item[kept], doc[kept], score[kept]], [], 0
        return self.rows


def _best(postings, n_docs: int, n_terms: int, most: int):
    """(item_id, doc_id, score): each item's best documents among those of a task."""
    def run(batches):
        p: Postings = postings.value
        best = Best(len(p.item_ids), most)
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            docs, ns = batch.column("doc_id").to_numpy(), batch.column("n").to_pylist()
            lengths = np.array([25 + 75 * n * n_docs // n_terms for n in ns], np.int64)
            column = batch.column("terms")
            terms, tfs = column.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
            sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
            impacts = 1_000_000_000 * tfs // (1000 * tfs + 8 * np.repeat(lengths, sizes))
            spots = np.concatenate(([0], np.cumsum(p.first[terms + 1] - p.first[terms])))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            lo = 0
            while lo < len(docs):
                hi = int(np.searchsorted(spots[ends], spots[ends[lo]] + CELLS, "right")) - 1
                hi = min(len(docs), max(lo + 1, min(hi, lo + max(1, CELLS // len(p.item_ids)))))
                a, b = ends[lo], ends[hi]
                best.add(docs[lo:hi], p.scores(terms[a:b], impacts[a:b], sizes[lo:hi]))
                lo = hi
        item, doc, score = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(p.item_ids[item]), pa.array(doc), pa.array(score)], ["item_id", "doc_id", "score"])
    return run


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, repeats)."""
    terms = F.regexp_extract_all(F.translate("text", CAPITALS, SMALL), F.lit(TERM), F.lit(0))
    return (items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms).alias("term"))
            .groupBy("item_id", "term").agg(F.count("*").alias("repeats")))


def search(docs: DataFrame, items: DataFrame, most: int = MOST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The `most` documents that fit each item best.

    docs: doc_id (integer) and text; items: item_id (integer) and text; other columns are not read.  Terms are the maximal
    runs of characters other than ASCII controls, spaces and punctuation, A-Z lower-cased.  With N documents that hold a term, L
    terms in all, n in a document, df documents that hold a term and tf its occurrences in one: a term weighs
    floor(1000 * ln((2N+2) / (2df+1))), a document has m = 25 + 75*n*N div L, and its score sums weight * (10^9*tf div
    (1000*tf + 8m)) over the item's terms, repeats included.

    Returns item_id, rank (int, from 1), doc_id, score: scores above 0, equal ones by ascending doc_id.  Null texts hold no
    term; rows with a null doc_id count in N, L and df and are not listed; rows that repeat a doc_id are
    documents of their own.  Items with a null id have no result; rows that repeat an item_id are one item with
    all their terms.  Empty tables give no rows.

    Items are taken in blocks whose terms make up at most about `block_bytes`: a block's terms are broadcast as one automaton, the documents are
    read once for it, and its broadcasts end with it.  A task keeps `most` documents an item.
    """
    spark = docs.sparkSession
    work = Work(spark, "lexical")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = work.cut(_item_terms(items), "terms")
    size = wanted.agg(F.sum(F.octet_length("term") + A_TERM)).first()[0] or 0
    blocks = -(-size // block_bytes)
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # bounded by block_bytes
        if not rows:
            continue
        number = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
        item_ids = sorted({r.item_id for r in rows})
        terms = spark.sparkContext.broadcast(list(number))
        hits = work.cut(narrow.mapInArrow(_counts(terms, uuid4().hex), "doc_id long, n long, terms array<int>, tfs array<long>"), "hits")
        n_docs, n_terms = hits.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holders = np.zeros(len(number), np.int64)
        for r in hits.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a term of the block
            holders[r.t] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holders.tolist()], np.int64)
        at = {x: i for i, x in enumerate(item_ids)}
        postings = spark.sparkContext.broadcast(Postings(item_ids, sorted((number[r.term], at[r.item_id], r.repeats) for r in rows), weights))
        if n_docs:
            out = out.unionAll(work.cut(hits.mapInArrow(_best(postings, n_docs, n_terms, most), out.schema), "best"))
        work.drop(hits)
        terms.destroy()
        postings.destroy()
    work.drop(wanted)
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")
