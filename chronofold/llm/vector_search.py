"""Nearest neighbours by inner product: a vantage-point tree in each shard, pruned by the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from chronofold.runtime import Work

#: Vectors of a shard, on average; one tree each.
SHARD_ROWS = 8192
#: Vectors of a leaf at most, unless they are all alike.
LEAF_ROWS = 64
#: Queries that are sent to all shards at one time (32 MB at 1,000 dimensions).
QUERY_BLOCK = 4096
#: A branch is passed over when `RELAX` times the k-th nearest distance does not reach it; 1 is exact.
RELAX = 0.8


class Tree:
    """Vantage-point tree over rows of `points`, by Euclidean distance.

    Each inner node takes one row as its vantage point and halves the others by
    their distance to it.  For each side it keeps the nearest and the farthest distance.
    """

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.vantage: list[int] = []
        self.leaves: list[np.ndarray] = []
        self.paths: list[list[tuple[int, float, float]]] = []
        work = [(np.arange(len(points)), [])]
        while work:
            rows, path = work.pop()
            if len(rows) <= leaf_rows:
                self._leaf(rows, path)
                continue
            # Of a few candidates the one that sees the others at the most different distances.
            best = None
            for c in rng.choice(rows, min(4, len(rows)), replace=False):
                some = rows[rng.integers(0, len(rows), min(64, len(rows)))]
                spread = np.linalg.norm(points[some] - points[c], axis=1).var()
                if best is None or spread > best[0]:
                    best = (spread, c)
            far = np.linalg.norm(points[rows] - points[best[1]], axis=1)
            order = np.argsort(far, kind="stable")
            half = len(rows) // 2
            if far[order[-1]] - far[order[0]] < 1e-12:  # all at one distance: nothing to tell them apart by
                self._leaf(rows, path)
                continue
            node = len(self.vantage)
            self.vantage.append(int(best[1]))
            for part in (order[:half], order[half:]):
                work.append((rows[part], [*path, (node, float(far[part[0]]), float(far[part[-1]]))]))

    def _leaf(self, rows: np.ndarray, path: list) -> None:
        self.leaves.append(rows)
        self.paths.append(path)

    def bounds(self, to_vantage: np.ndarray) -> np.ndarray:
        """(queries, leaves): no row of the leaf is nearer, by the triangle inequality along its path."""
        out = np.zeros((len(to_vantage), len(self.leaves)))
        for i, path in enumerate(self.paths):
            for node, near, far in path:
                d = to_vantage[:, node]
                np.maximum(out[:, i], np.maximum(near - d, d - far), out=out[:, i])
        return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, longest: float,
                 relax: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vec_id, score): each query's k best of the shard, found through its tree.

    A vector x gets one more component, the root of longest^2 - |x|^2, and a
    query a zero.  Then |q - x|^2 = |q|^2 + longest^2 - 2 q.x, so that the nearest are those of
    the largest product.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    lengths = np.einsum("ij,ij->i", vectors, vectors)
    lifted = np.hstack([vectors, np.sqrt(np.maximum(0, longest * longest - lengths))[:, None]])
    asked = np.hstack([queries, np.zeros((len(queries), 1))])
    tree = Tree(lifted)
    bounds = tree.bounds(_distances(asked, lifted[tree.vantage])) if tree.vantage else np.zeros((len(asked), len(tree.leaves)))
    top_score = np.full((len(asked), k), -np.inf)
    top_id = np.full((len(asked), k), np.iinfo(np.int64).max)
    own = np.einsum("ij,ij->i", queries, queries) + longest * longest

    def visit(leaf: int, at: np.ndarray) -> None:
        for lo in range(0, len(tree.leaves[leaf]), 4096):
            part = tree.leaves[leaf][lo:lo + 4096]
            score = queries[at] @ vectors[part].T
            score[query_ids[at][:, None] == ids[part][None]] = -np.inf
            better = (score.max(axis=1) >= top_score[at, -1])
            rows, score = at[better], score[better]
            score = np.hstack([top_score[rows], score])
            who = np.hstack([top_id[rows], np.broadcast_to(ids[part], (len(rows), len(part)))])
            best = np.lexsort((who, -score), axis=1)[:, :k]
            top_score[rows], top_id[rows] = np.take_along_axis(score, best, 1), np.take_along_axis(who, best, 1)

    first = bounds.argmin(axis=1)  # each query's likeliest leaf, for a first reach
    for leaf in np.unique(first):
        visit(leaf, np.flatnonzero(first == leaf))
    for leaf in np.argsort(bounds.mean(axis=0), kind="stable"):
        reach = np.sqrt(np.maximum(0, own - 2 * top_score[:, -1]))
        open_ = ~(bounds[:, leaf] > relax * reach * (1 + 1e-9) + 1e-9) & (first != leaf)
        if open_.any():
            visit(leaf, np.flatnonzero(open_))
    found = np.isfinite(top_score)
    return np.repeat(np.arange(len(asked)), found.sum(axis=1)), top_id[found], top_score[found]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _searching(sent, k: int, longest: float, relax: float):
    def search(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(group)
        query_ids, matrix = sent.value
        q, who, score = search_shard(np.concatenate([x.column("vec_id").to_numpy() for x in batches]),
                                     np.vstack([_matrix(x.column("v")) for x in batches]), query_ids, matrix, k, longest, relax)
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(who), pa.array(score)], ["query_id", "vec_id", "score"])
    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, relax: float = RELAX, shard_rows: int = SHARD_ROWS,
            query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest vectors other than its own row, nearest first.

    vectors and queries: vec_id (integer), embedding (array of numbers).  Nearness is the inner product, in
    double precision; ties go to the smaller vec_id.  Null, zero and non-finite vectors, and
    those that hold nulls, take no part; nor do rows with a null vec_id.  Rows that
    repeat a vec_id count as rows of their own; a query finds no row of its own id.  Vectors of
    several lengths are searched apart, each with its like.

    Every row is in the tree of its shard, which a hash of vec_id chooses; relax = 1 searches
    exactly.  Queries visit all shards in blocks of query_block, so that a block is
    small enough to be sent to every task whatever their number.
    """
    work = Work(vectors.sparkSession, "nearest")

    def usable(df: DataFrame) -> DataFrame:
        return (df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
                .where("vec_id is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
                       " and exists(v, x -> x != 0)"))

    rows = usable(vectors).withColumn("dim", F.size("v"))
    sizes = {r.dim: (r.n, r.longest) for r in rows.groupBy("dim").agg(
        F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).collect()}
    asked = work.cut(usable(queries).withColumn("dim", F.size("v")), "queries")
    parts = []
    for dim, (n, longest) in sorted(sizes.items()):
        shards = max(1, -(-n // shard_rows))
        own = asked.where(F.col("dim") == dim)
        blocks = -(-own.count() // query_block)
        index = rows.where(F.col("dim") == dim).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
        for b in range(blocks):
            block = own.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)) == b).select("vec_id", "v").toArrow()
            query_ids = block.column("vec_id").to_numpy()
            matrix = _matrix(block.column("v").combine_chunks()) if len(block) else np.zeros((0, dim))
            sent = vectors.sparkSession.sparkContext.broadcast((query_ids, matrix))

            parts.append(index.select("shard", "vec_id", "v").groupBy("shard")
                         .applyInArrow(_searching(sent, k, longest ** 0.5, relax), "query_id long, vec_id long, score double"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
