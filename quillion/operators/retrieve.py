"""Vector retrieval: exact nearest neighbours by squared distance, thresholds, maximal marginal relevance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.operators.index import rank_similarity, top_k

#: Query vectors up to which they are broadcast: 64 dimensions in double precision make 0.5 KB each.
BROADCAST_QUERIES = 20_000
#: Vectors of a block, about: each is compared with all queries, which stream by.
BLOCK = 8_192
#: Results that a block passes on beyond the k nearest, as distances are rounded before they are ranked.
SPARE = 8
#: Vectors of a block, about, where each pair with a query is a row of the result: fewer, so that tasks stay short.
ROWS_BLOCK = 4_096
#: Cosines that a task holds at once.
PAIRS = 1 << 17


def vector_fetch(k: int) -> int:
    """How many vectors are fetched for k results."""
    return min(max(4 * k, 8), 30)


def bm25_fetch(k: int) -> int:
    return min(max(3 * k, 6), 20)


def fused_limit(k: int) -> int:
    return min(3 * k, 12)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def finite(v: Column) -> Column:
    """Whether a vector is there, isn't empty and has neither null nor non-finite components."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def pairs(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, q, v): every query with every vector but itself.

    For outputs that are all pairs; few queries are broadcast. Rankings go by ``nearest``, cosines by ``cosines``.
    """
    q = queries.select(F.col(id_col).alias("query_id"), doubles(F.col(vector_col)).alias("q"))
    v = vectors.select(F.col(id_col), doubles(F.col(vector_col)).alias("v"))
    if queries.count() <= BROADCAST_QUERIES:
        q = F.broadcast(q)
    return v.join(q, F.col(id_col) != F.col("query_id"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, same: bool = True) -> DataFrame:
    """(query_id, id, distance): for each of queries (query_id, q) the k nearest of vectors (id, v) by squared distance, and some more.

    Vectors are dealt into blocks, queries are copied to each; a task holds one block, lets the queries stream by and
    emits a bounded number of rows a query. With ``same`` a vector of the query's own id is left out. Arrays that are
    null, of another length than most, or hold a null or non-finite component take no part.
    """

    def run(batches):
        held, block = [], None
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            first = int(np.searchsorted(asks, True)) if block is None else 0
            if first:
                held.append(batch.slice(0, first))
            if first == batch.num_rows or (block is None and not held):
                continue
            if block is None:
                ids = np.concatenate([h.column("id").to_numpy() for h in held])
                block, held = np.concatenate([h.column("v").flatten().to_numpy().reshape(h.num_rows, -1) for h in held]), []
            part = batch.slice(first)
            out: list[list] = [[], [], []]
            for q, w in zip(part.column("id").to_pylist(), part.column("v").flatten().to_numpy().reshape(part.num_rows, -1), strict=True):
                apart = ((block - w) ** 2).sum(axis=1)
                if same:
                    apart[ids == q] = np.inf
                best = np.argpartition(apart, k + SPARE)[: k + SPARE] if len(ids) > k + SPARE else np.arange(len(ids))
                if len(ids) > k + SPARE:  # all that tie with the last, once rounded
                    best = np.flatnonzero(apart <= apart[best].max() + 1e-6)
                    best = best[np.lexsort((ids[best], np.round(apart[best], 6)))][: k + SPARE]
                best = best[np.isfinite(apart[best])]
                out[0] += [q] * len(best)
                out[1] += ids[best].tolist()
                out[2] += apart[best].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "id", "distance"])

    rows = vectors.where(finite(F.col("v")))
    n = rows.count()
    blocks = max(1, -(-n // BLOCK))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    fits = F.size("v") == (size["d"] if size else 0)
    dealt = rows.where(fits).select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"))
    asked = queries.select(F.col("query_id").alias("id"), F.col("q").alias("v")).where(F.col("v").isNotNull() & fits)
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(True))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("distance", T.DoubleType())])
    return dealt.unionByName(asked).repartitionById(blocks, "block").sortWithinPartitions("asks").mapInArrow(run, schema)


def vector_top(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance, similarity_score, rank_score): nearest by squared distance."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), doubles(F.col(vector_col)).alias("v"))
    q = queries.select(F.col(id_col).cast("long").alias("query_id"), doubles(F.col(vector_col)).alias("q"))
    scored = nearest(v, q, k).select("query_id", F.col("id").alias(id_col), F.round("distance", 6).alias("distance"))
    found = top_k(scored, "query_id", k, id_col, "distance", descending=False)
    return found.select("query_id", "rank", id_col, "distance", F.round(1 / (1 + F.greatest("distance", F.lit(0.0))), 6).alias("similarity_score"), F.round(rank_similarity(F.col("rank")), 6).alias("rank_score"))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def _by_size(rows: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, components and lengths of a batch's vectors by how many components they have; those without a length are left out."""
    size = np.where(rows.column("long").is_valid().to_numpy(zero_copy_only=False), pc.list_value_length(rows.column("v")).fill_null(-1).to_numpy(), -1)
    found = {}
    for d in np.unique(size[size >= 0]).tolist():
        at = np.flatnonzero(size == d)
        part = rows if len(at) == len(size) else rows.take(pa.array(at))
        found[d] = at, part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(at), d), part.column("long").to_numpy(zero_copy_only=False)
    return found


def _unit(x: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows of length one; NaN where a length is zero, isn't finite, or products of its square might leave the range of doubles."""
    return x / np.where((long > 1e-140) & (long < 1e140), long, np.nan)[:, None]


def _six_digits(x: np.ndarray) -> np.ndarray:
    """Rounded as Spark's ``round`` does: half up, by a number's decimal form."""
    found = np.rint(x * 1e6) / 1e6 + 0.0
    near = np.flatnonzero(np.abs(x * 1e6 - np.rint(x * 1e6)) > 0.5 - 1e-6)
    values, at = np.unique(x[near], return_inverse=True)
    found[near] = np.array([float(Decimal(repr(v)).quantize(Decimal("1e-6"), ROUND_HALF_UP)) for v in values.tolist()], float)[at]
    return found


def _all_cosines(q: np.ndarray, q_long: np.ndarray, v: np.ndarray, v_long: np.ndarray, v_unit: np.ndarray) -> np.ndarray:
    """Cosines of each q with each v, to six digits, as ``cosine`` in double precision has them.

    A product of matrices sums in another order. Where that could lead to another sixth digit, and where a vector has no
    unit form, the sum is made again in the order of the components.
    """
    with np.errstate(all="ignore"):
        value = (_unit(q, q_long) * 1e6) @ v_unit.T
        found = np.rint(value)
        value -= found
        i, j = np.nonzero(~(np.abs(value, out=value) < 0.5 - 1e-9 * (q.shape[1] + 8)))
        found /= 1e6
        found += 0.0  # no negative zeros
        if len(i):
            scale = q_long[i] * v_long[j]
            found[i, j] = 0.0
            i, j, scale = i[scale != 0], j[scale != 0], scale[scale != 0]
            total = np.zeros(len(i))
            for x, y in zip(q.T, v.T, strict=True):
                total += x[i] * y[j]
            found[i, j] = _six_digits(total / scale)
    return found


def _cosine_batches(batches: Iterable[pa.RecordBatch], names: list[str], at_once: int) -> Iterator[pa.RecordBatch]:
    """The cosines of a task's vectors, which come first, with each of the queries that stream by."""
    held, block = [], None
    for batch in batches:
        first = int(np.searchsorted(batch.column("asks").to_numpy(zero_copy_only=False), True))
        if first:
            held.append(batch.slice(0, first))
        if first == batch.num_rows or not held:
            continue
        if block is None:
            ids = pa.concat_arrays([h.column("id") for h in held])
            known = ids.dictionary_encode()
            block = _by_size(pa.RecordBatch.from_arrays([pa.concat_arrays([h.column(c) for h in held]) for c in ("v", "long")], names=["v", "long"]))
            with np.errstate(all="ignore"):
                block = {d: (at, v, long, _unit(v, long)) for d, (at, v, long) in block.items()}
        step = max(1, at_once // len(ids))
        for start in range(first, batch.num_rows, step):
            asked = batch.slice(start, min(step, batch.num_rows - start))
            found = np.zeros((asked.num_rows, len(ids)))  # 0 for vectors of other sizes, and for those without a length
            for d, (at, q, long) in _by_size(asked).items():
                if d in block:
                    found[np.ix_(at, block[d][0])] = _all_cosines(q, long, *block[d][1:])
            who = asked.column("id").take(pa.array(np.repeat(np.arange(asked.num_rows), len(ids))))
            out = pa.RecordBatch.from_arrays([who, pa.concat_arrays([ids] * asked.num_rows), pa.array(found.ravel())], names=names)
            own = pc.index_in(asked.column("id"), known.dictionary).fill_null(-1).to_numpy()
            if (own >= 0).any():
                out = out.filter(pa.array((known.indices.to_numpy() != own[:, None]).ravel()))
            yield out


def cosines(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Cosines of all pairs; a vector's length is made once, not once a pair.

    Vectors are dealt into blocks, queries are copied to each; a task holds one block, lets the queries stream by and emits
    their cosines as products of matrices, a bounded number at a time. Pairs are never shuffled.
    """
    of = doubles(F.col(vector_col))
    measured = lambda df: df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.sqrt(dot(of, of)).alias("long"))
    blocks = max(1, -(-vectors.count() // ROWS_BLOCK))
    every = vectors.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    asked = measured(queries).crossJoin(F.broadcast(every)).withColumn("asks", F.lit(True))
    dealt = measured(vectors).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("asks", F.lit(False))
    met = asked.unionByName(dealt).repartitionById(blocks, "block").sortWithinPartitions("asks").select("asks", "id", doubles(F.col("v")).alias("v"), "long")
    kind, names = met.schema["id"].dataType, ["query_id", id_col, "cosine"]
    schema = T.StructType([T.StructField(name, t) for name, t in zip(names, (kind, kind, T.DoubleType()), strict=True)])
    at_once = PAIRS
    return met.mapInArrow(lambda batches: _cosine_batches(batches, names, at_once), schema)


def above_threshold(vectors: DataFrame, queries: DataFrame, threshold: float, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest whose relevance 1 / (1 + squared distance) reaches the threshold."""
    found = vector_top(vectors, queries, k, id_col, vector_col)
    return found.where(F.col("similarity_score") >= threshold).select("query_id", "rank", id_col, "similarity_score")


def mmr(vectors: DataFrame, queries: DataFrame, k: int, fetch: int = 30, weight: float = 0.5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id): of each query's ``fetch`` nearest, k by maximal marginal relevance (cosine).

    Only the choice among the fetched, at most ``fetch`` rows a query, runs in Python.
    """
    nearest = vector_top(vectors, queries, fetch, id_col, vector_col).select("query_id", id_col, F.col("rank").alias("arrival"))
    rows = nearest.join(vectors.select(id_col, F.col(vector_col).alias("v")), id_col).join(queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("q")), "query_id")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        group = group.sort_values("arrival")
        v = np.stack(group["v"].to_numpy()).astype(float)
        q = np.asarray(group["q"].iloc[0], float)
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)
        v, q = unit(v), unit(q)
        relevance, chosen = v @ q, []
        while len(chosen) < min(k, len(v)):
            redundancy = (v @ v[chosen].T).max(axis=1) if chosen else np.zeros(len(v))
            value = weight * relevance - (1 - weight) * redundancy if chosen else relevance
            value[chosen] = -np.inf
            chosen.append(int(value.argmax()))
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "rank": range(1, len(chosen) + 1), id_col: group[id_col].to_numpy()[chosen]})

    return rows.groupBy("query_id").applyInPandas(choose, f"query_id long, rank int, {id_col} long")
