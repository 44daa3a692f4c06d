"""Approximate nearest neighbours by collision-counting hashing, for queries against all vectors, in blocks.

Vectors are scaled to length one, so that the nearest by cosine are the nearest by distance. Each of ``PROJECTIONS``
random directions gives one sorted array of a block's projections. A query looks at windows centred on its own
projections; a vector collides with it on a direction if it lies in that direction's window. All windows widen together
(virtual rehashing: radius 1, then ``GROWTH`` times as much, ...), and a vector that has collided on more than the
threshold's share of directions is verified by its exact cosine. A query stops once it has k verified vectors that are
nearer than its radius stands for, or has verified the whole block.

Every row is in one block. Each query first searches one block, its own; its k-th distance there bounds those of all
others, so in every other block it looks once, at windows of that radius (times ``SLACK``), and verifies what collides
enough. Queries are copied to the blocks, never vectors; a task reads one block, sorts its projections once, and then
lets the block's queries stream by, so that it holds a block and a batch of queries. Of a query's results, each
partition passes on its k best only (Spark limits the groups of a ranking before it shuffles them).

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part; rows, not ids, are told apart: of a repeated id each row is a query and a candidate by itself, and a query
leaves out its own row only; a null id takes no part; equal vectors tie and go by id; fewer candidates than k are all
returned; components of any finite size count (vectors are scaled by powers of two first); empty tables give an empty
result; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillion.llm import store
from quillion.llm.words import give_back

PROJECTIONS = 96
#: Share of the directions on which a vector has to collide.
THRESHOLD = 0.7
#: The first radius and its growth (distances of unit vectors), and a window's half-width at radius 1 in standard
#: deviations of a projected difference: at a vector's own distance it collides on three of four directions.
FIRST, GROWTH, WIDTH = 0.5, 1.12, 1.15
#: Radius of a query's windows in other blocks, in bounds from its own: below 1, as 0.7 of the directions are asked for and three of four collide.
SLACK = 0.97
#: Vectors in a block at most, about; and at least, where more blocks would keep more tasks busy.
BLOCK, LEAST = 32_768, 2_048

_FOUND = T.StructType([T.StructField("query_row", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two each, so that no product of theirs overflows; cosines stay exactly what they are."""
    vectors = vectors.astype(np.float64)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1]) if vectors.size else vectors


class Index:
    """Sorted projections of one block's unit vectors."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, seed: int = 11):
        self.rows, self.ids, self.vectors = rows, ids, scaled(vectors)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        d = vectors.shape[1]
        self.directions = np.random.default_rng(seed).standard_normal((d, PROJECTIONS))
        self.directions /= np.sqrt((self.directions**2).sum(axis=0))
        unit = self.vectors / self.norms[:, None]
        projected = unit @ self.directions
        order = np.argsort(projected, axis=0)
        # all sorted arrays one after another, each moved into its own range, so that one search places all windows
        self.moved = 4.0 * np.arange(PROJECTIONS)
        self.flat = (np.take_along_axis(projected, order, axis=0) + self.moved).T.ravel()
        self.at = order.T.ravel()
        self.edges = np.arange(PROJECTIONS + 1) * len(ids)
        self.single = unit.astype(np.float32)
        self.unit = WIDTH / np.sqrt(d)
        self.need = int(np.ceil(THRESHOLD * PROJECTIONS))
        self.verified = 0

    def search(self, row: int, query: np.ndarray, k: int, bound: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k nearest found, nearest first, ties by id. bound: the distance that k others are within."""
        n, query = len(self.ids), scaled(query[None])[0]
        norm = np.sqrt((query * query).sum())
        centre = (query / norm) @ self.directions + self.moved
        near = (query / norm).astype(np.float32)
        count, done = np.zeros(n, np.int64), self.rows == row
        low = np.clip(np.searchsorted(self.flat, centre), self.edges[:-1], self.edges[1:])
        high, radius = low, FIRST if bound is None else max(bound * SLACK, 1e-6)
        chosen: list[np.ndarray] = []
        cosines: list[np.ndarray] = []
        left = n - int(done.sum())
        while left:
            half = radius * self.unit
            a = np.clip(np.searchsorted(self.flat, centre - half), self.edges[:-1], low)
            b = np.clip(np.searchsorted(self.flat, centre + half, "right"), high, self.edges[1:])
            rings = [self.at[x:y] for x, y in zip([*a.tolist(), *high.tolist()], [*low.tolist(), *b.tolist()], strict=True) if x < y]
            if rings:
                count += np.bincount(np.concatenate(rings), minlength=n)
            low, high = a, b
            new = np.flatnonzero((count >= self.need) & ~done)
            if len(new):
                done[new] = True
                left -= len(new)
                self.verified += len(new)
                chosen.append(new)
                cosines.append(self._cosines(new, query, near, norm, k))
                if bound is None and sum(int((c >= 1 - radius * radius / 2).sum()) for c in cosines) >= k:
                    break
            if bound is not None:
                break
            radius *= GROWTH
        if not chosen:
            return np.empty(0, np.int64), np.empty(0)
        which, score = np.concatenate(chosen), np.concatenate(cosines)
        ids = self.ids[which]
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best]

    def _cosines(self, which: np.ndarray, query: np.ndarray, near: np.ndarray, norm: float, k: int) -> np.ndarray:
        """Cosines of the vectors: exact, in double precision, wherever single precision leaves a place among the k best open."""
        rough = self.single[which] @ near
        out = rough.astype(np.float64)
        floor = np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-4 if len(rough) > k else -np.inf
        sure = np.flatnonzero(rough >= floor)
        exact = which[sure]
        out[sure] = (self.vectors[exact] * query).sum(axis=1) / (self.norms[exact] * norm)
        return out


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    v = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _searched(vectors: DataFrame, asked: DataFrame, blocks: int, k: int) -> DataFrame:
    """(query_row, query_id, vec_id, score): what queries (row, id, vector, block, bound) find in the blocks of vectors (row, id, vector, block)."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        index = None
        for batch in batches:
            queries = batch.column("query").to_numpy(zero_copy_only=False)
            first = int(np.searchsorted(queries, True)) if index is None else 0
            if first:
                held.append(batch.slice(0, first))
            if first == batch.num_rows or (index is None and not held):
                continue
            if index is None:
                block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                index, held = Index(block.column("row").to_numpy(), block.column("id").to_numpy(), _matrix(block.column("vector"))), []
            part = batch.slice(first)
            found: list[tuple] = []
            for row, id_, v, bound in zip(part.column("row").to_pylist(), part.column("id").to_pylist(), _matrix(part.column("vector")), part.column("bound").to_pylist(), strict=True):
                ids, scores = index.search(row, v, k, bound)
                found += [(row, id_, i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
            columns = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.float64())], names=["query_row", "query_id", "vec_id", "score"])
        index = None
        give_back()

    none = F.lit(None).cast("double")
    both = vectors.select("row", "id", "vector", "block", F.lit(False).alias("query"), none.alias("bound")).unionByName(asked.select("row", "id", "vector", "block", F.lit(True).alias("query"), "bound"))
    return both.repartitionById(blocks, "block").sortWithinPartitions("query").mapInArrow(run, _FOUND)


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which ``queries`` (of the column ``id``) holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")) & F.col("id").isNotNull())
    rows = store.materialise(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    n, parts = size["count"] if size else 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // BLOCK), min(parts, n // LEAST))
    rows = rows.where(F.size("vector") == (size["d"] if size else 0)).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    asked = rows.where(F.coalesce(queries, F.lit(False)))
    found = store.materialise(_searched(rows, asked.withColumn("bound", F.lit(None).cast("double")), blocks, k), "nearest-own")
    if blocks > 1:
        # a query that finds fewer than k in its own block has no bound
        bounds = found.groupBy("query_row").agg(F.when(F.count("*") >= k, F.sqrt(F.greatest(2 - 2 * F.min("score"), F.lit(0.0)))).alias("bound"))
        others = asked.join(bounds, asked["row"] == bounds["query_row"], "left").select("row", "id", "vector", "bound", F.col("block").alias("own"))
        others = others.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where("block <> own")
        found = found.unionByName(_searched(rows, others, blocks, k))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
