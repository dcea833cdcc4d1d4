"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronofold.llm import kernels as K
from chronofold.llm.components import components
from chronofold.llm.linking import NARROW_ROWS, buckets, linked
from chronofold.runtime import Work, broadcast_if_small

#: 40 bands of 5: a pair at similarity 0.8 shares no band with probability 1.3e-7.
BANDS, ROWS = 40, 5


def _signatures(words: int, bands: int, rows: int):
    def run(batches):
        hashing = K.Circulant(bands, rows)
        for batch in batches:
            ids = batch.column("id")
            for lo, hi, data, offsets in K.texts_of(batch.column("text")):
                sets = K.shingles(*K.words(data, offsets), words)
                n = np.array([len(s) for s in sets], np.int64)
                some = [s for s in sets if len(s)]
                keys = hashing.keys(some) if some else np.zeros((0, bands), np.int64)
                marks = np.zeros((2, len(sets)), K.U64)
                if some:  # two sums over the set, whatever its order: equal sets have equal marks
                    flat, at = np.concatenate(some), np.concatenate([[0], np.cumsum(n[n > 0])[:-1]])
                    for i in (0, 1):
                        marks[i, n > 0] = np.add.reduceat(K.mix(flat ^ K.ODD[50 + i]), at)
                yield pa.RecordBatch.from_arrays(
                    [ids[lo:hi], pa.array(n), *(pa.array(m.view(np.int64)) for m in marks),
                     K.lists(keys.ravel(), np.where(n > 0, bands, 0))], ["id", "n", "h1", "h2", "keys"])
    return run


def sets_of(words: int):
    """Texts of an Arrow column to their shingle sets."""
    def run(column: pa.Array) -> Iterator[np.ndarray]:
        for _, _, data, offsets in K.texts_of(column):
            yield from K.shingles(*K.words(data, offsets), words)
    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Each document's class of near copies.

    docs: doc_id (integer) and text; other columns are not read.  Words are runs of
    bytes other than ASCII white space, A-Z lower-cased; the set of a document
    is its distinct `words`-word shingles, or its whole sequence if shorter.
    Documents are linked when 100 * intersection >= percent * union.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable over
    links), kept (doc_id = component_id), a row for each row of docs.  Texts
    that are null or hold no word link with nothing.  A null doc_id has a null component
    and is kept.  Rows that repeat a doc_id are one document; if their texts
    differ, links of any of them count.  An empty table gives no rows.
    """
    work = Work(docs.sparkSession, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    signed = work.cut(docs.mapInArrow(_signatures(words, bands, rows), "id long, n long, h1 long, h2 long, keys array<long>"), "signed")
    real = signed.where("n > 0 and id is not null")
    # Equal sets are one class from here on; the map side folds copies first.
    classes = work.cut(real.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.min_by("keys", "id").alias("keys")), "classes")
    members = buckets(classes.select(F.col("rep").alias("id"), "keys"), work)

    def with_texts(needs: DataFrame) -> DataFrame:
        return docs.join(broadcast_if_small(needs, NARROW_ROWS), "id")

    labels, edges = linked(members, with_texts, sets_of(words), percent, work)
    of = work.cut(real.select("id", "h1", "h2", "n")
                  .join(broadcast_if_small(classes.select("h1", "h2", "n", "rep"), NARROW_ROWS), ["h1", "h2", "n"])
                  .select("id", "rep").distinct(), "of")
    # An id whose rows differ ties the classes they are in.
    several = of.groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("last")).where("u < last").select("id", "u")
    if not several.isEmpty():
        labels = components(edges.unionAll(of.join(several, "id").select("u", F.col("rep").alias("v"))), work)
    of = (of.join(broadcast_if_small(labels.withColumnRenamed("id", "rep"), NARROW_ROWS), "rep", "left")
          .groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component_id")))
    return (signed.select("id", "n").join(of, "id", "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "id").alias("component_id"),
                    F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept")))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each class of near copies, that of the smallest doc_id.

    All columns stay.  Of rows that repeat a doc_id one stays, that of the
    smallest text.  Rows with a null doc_id and texts without a word stay.
    """
    kept = near_duplicates(docs, words, percent).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = Work(docs.sparkSession, "near").cut(kept.select(F.col("doc_id").alias("__llm_id"), "n"), "kept")
    once, more = kept.where("n = 1").drop("n"), kept.where("n > 1").drop("n")
    same = F.col("doc_id").cast("long") == F.col("__llm_id")
    out = docs.join(broadcast_if_small(once, NARROW_ROWS), same, "left_semi").unionAll(docs.where("doc_id is null"))
    if not more.isEmpty():
        rows = docs.join(broadcast_if_small(more, NARROW_ROWS), same, "left_semi")
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        out = out.unionAll(rows.groupBy(F.col("doc_id").alias("__llm_id")).agg(F.min_by(whole, F.coalesce("text", F.lit(""))).alias("__llm_row"))
                           .select("__llm_row.*"))
    return out
