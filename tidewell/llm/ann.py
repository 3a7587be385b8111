"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Vectors with like orders are near each other: the footrule distance,
the sum over pivots of how far a pivot's places lie apart, orders the candidates, and the best of them are compared by their
vectors. A pivot outside the first K counts as at place K, so that the distance is K (K + 1) less twice the sum, over the
pivots that two vectors share, of the smaller of the two weights K - place: only the shared pivots' inverted lists are read.

The search is a grid. Vectors are dealt to blocks, queries to chunks; a task builds the inverted file of its block by and by
and holds one chunk of queries with the nearest found so far. Blocks and chunks number as the square root of the vectors, so
that a vector is sent to few tasks, and neither side is held as a whole anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, settle

#: Pivots are so many rows, the first by a hash of their id, and a vector is represented by the nearest of them.
PIVOTS, NEAREST = 256, 64
#: Candidates whose vectors are compared with a query: so many times the square root of the number of vectors.
SHARE = 40
#: A block's rows that are in one inverted file at a time, and queries that are scored at a time.
FILE, AT_ONCE = 8192, 256
#: A block has about as many rows as the square root of so many times all rows.
PER_BLOCK = 256


def _usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, v as doubles; of a repeated id the row with the least vector."""
    parts = only(vectors, vec_id, vector).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return parts.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten()).reshape(n, -1) if n else np.zeros((0, 0))


def _permuted(vectors: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """With each vector its nearest pivots in order (of equally near ones the first)."""

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-(_matrix(batch["v"]) @ pivots.T), axis=1, kind="stable")[:, :nearest].astype(np.int16)
            lists = pa.ListArray.from_arrays(np.arange(0, order.size + 1, order.shape[1], dtype=np.int32), order.ravel())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], lists], ["vec_id", "v", "pivots"])

    return vectors.select("vec_id", "v").mapInArrow(permute, "vec_id long, v array<double>, pivots array<short>")


class _Chunk:
    """Queries of one task, with the nearest found so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.v, self.pivots = k, [], [], []

    def add(self, batch: pa.RecordBatch) -> None:
        self.ids.append(np.asarray(batch["vec_id"]))
        self.v.append(_matrix(batch["v"]))
        self.pivots.append(_matrix(batch["pivots"]))

    def close(self) -> None:
        self.ids, self.v, self.pivots = np.concatenate(self.ids), np.concatenate(self.v), np.concatenate(self.pivots)
        self.found = [(np.empty(0), np.empty(0, np.int64))] * len(self.ids)

    def search(self, ids: np.ndarray, v: np.ndarray, pivots: np.ndarray, share: float, n_pivots: int) -> None:
        """Compare the queries with the rows of one inverted file, of which a share is compared by vectors."""
        order = np.argsort(ids, kind="stable")
        ids, v, pivots = ids[order], v[order], pivots[order]
        m, depth = pivots.shape
        by_pivot = np.argsort(pivots.ravel(), kind="stable")
        at = np.searchsorted(pivots.ravel()[by_pivot], np.arange(n_pivots + 1))
        take = min(m, math.ceil(share * m) + self.k)
        for start in range(0, len(self.ids), AT_ONCE):
            mine = self.pivots[start : start + AT_ONCE]
            shared = np.zeros((len(mine), m), np.int32)
            own = np.argsort(mine.ravel(), kind="stable")
            own_at = np.searchsorted(mine.ravel()[own], np.arange(n_pivots + 1))
            for p in range(n_pivots):
                posts, asked = by_pivot[at[p] : at[p + 1]], own[own_at[p] : own_at[p + 1]]
                if len(posts) and len(asked):
                    weights = np.minimum.outer((depth - asked % depth).astype(np.int32), (depth - posts % depth).astype(np.int32))
                    shared[np.ix_(asked // depth, posts // depth)] += weights
            # a larger shared weight is a smaller footrule distance; of equal ones the smaller id is first
            key = shared.astype(np.int64) * m + np.arange(m - 1, -1, -1)
            best = np.argpartition(-key, take - 1, axis=1)[:, :take] if take < m else np.broadcast_to(np.arange(m), (len(mine), m))
            for i, rows in enumerate(best):
                q = start + i
                rows = rows[ids[rows] != self.ids[q]]
                score = np.concatenate([(v[rows] * self.v[q]).sum(axis=1), self.found[q][0]])
                near = np.concatenate([ids[rows], self.found[q][1]])
                if len(score) > 8 * self.k:  # ties at the limit stay until the ids decide
                    keep = score >= np.partition(score, -self.k)[-self.k]
                    score, near = score[keep], near[keep]
                first = np.lexsort((near, -score))[: self.k]
                self.found[q] = (score[first], near[first])

    def rows(self) -> pa.RecordBatch:
        n = [len(f[0]) for f in self.found]
        return pa.RecordBatch.from_arrays(
            [np.repeat(self.ids, n), np.concatenate([f[1] for f in self.found]), np.concatenate([f[0] for f in self.found])], ["query_id", "vec_id", "score"]
        )


def nearest(vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, depth: int = NEAREST, share: float = SHARE) -> DataFrame:
    """The k nearest found of each query by inner product: (query_id, rank, vec_id, score), rank from 1.

    queries is a condition on vec_id (long). Score is the inner product in double precision; equal ones go to the smaller
    vec_id. All rows but the query's own are candidates; with k or fewer, all are found. Vectors that are null or empty, that are
    zero or hold null or non-finite components, rows without an id, and vectors of another dimension than the most frequent
    one (the smaller, of equally frequent ones) take no part. A repeated vec_id counts once, with its least vector. Further
    columns are ignored; no rows give none. Pivots are the `pivots` rows that come first by a hash of their id: that sample is
    of fixed size, everything else is over all rows.
    """
    every = settle(_usable(vectors, vec_id, vector), "vectors")
    sizes = every.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return every.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, n = sizes[0]
    every = every.where(F.size("v") == dimension)
    sample = np.array([r.v for r in every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").collect()])
    depth = min(depth, len(sample))
    indexed = settle(_permuted(every, sample, depth), "permutations")
    asked = indexed.where(queries)
    blocks = math.ceil(math.sqrt(n / PER_BLOCK))
    chunks = max(1, math.ceil(blocks * asked.count() / n))
    part = min(1.0, share / math.sqrt(n))
    n_pivots = len(sample)

    def deal(df: DataFrame, own: Column, others: int, first: bool) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return df.withColumn("own", own).withColumn("other", other).select((F.col("other") * chunks + F.col("own") if first else F.col("own") * chunks + F.col("other")).alias("cell"), F.lit(not first).alias("row"), "vec_id", "v", "pivots")

    grid = deal(asked, F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)), blocks, True).unionByName(deal(indexed, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), chunks, False))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, chunk, rows = None, None, []

        def flush(least: int) -> None:
            nonlocal rows
            while rows and sum(b.num_rows for b in rows) >= least:
                table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
                some = table.slice(0, FILE)
                chunk.search(np.asarray(some["vec_id"]), _matrix(some["v"]), _matrix(some["pivots"]), part, n_pivots)
                rows = [table.slice(FILE)] if table.num_rows > FILE else []

        def end() -> Iterator[pa.RecordBatch]:
            if chunk is not None and chunk.ids is not None and len(chunk.ids):
                if isinstance(chunk.ids, list):
                    chunk.close()
                flush(1)
                yield chunk.rows()

        for batch in batches:
            cells, is_row = np.asarray(batch["cell"]), np.asarray(batch["row"].cast(pa.int8()))
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(is_row) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                if cells[a] != cell:
                    yield from end()
                    cell, chunk, rows = cells[a], _Chunk(k), []
                if not is_row[a]:
                    chunk.add(batch.slice(a, b - a))
                elif len(chunk.ids):
                    if isinstance(chunk.ids, list):
                        chunk.close()
                    rows.append(batch.slice(a, b - a))
                    flush(FILE)
        yield from end()

    found = grid.repartition("cell").sortWithinPartitions("cell", "row").mapInArrow(search, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
