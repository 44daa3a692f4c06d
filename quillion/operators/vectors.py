"""A stored vector index: lists by trained centroids, product-quantised residuals, list pruning and exact re-ranking.

Vectors go to the list of their nearest centroid. What is left of a vector beside its centroid is coded in parts, each by
the nearest of 256 trained code words, and the code's own error (a distance) is kept beside it. A table in order of list
holds ids, codes, errors and the vectors themselves.

A search first probes each query's nearest lists. By the triangle inequality a vector's true distance differs from that to
its decoded form by its error at most, so each list's codes give bounds on all its distances, and only vectors whose lower
bound is under the k-th upper bound are measured exactly. An *exact* search then goes through every further list that can
hold something nearer: one whose centroid is farther from the query than the k-th distance and its radius together can't.
With ``exact=False`` the search ends after the first lists. Results have the distances of ``retrieve.vector_top`` either way.

Lists are dealt into cells of some ``BLOCK`` vectors. A task holds one cell, lets the queries that need one of its lists
pass by, measures where the vectors are and passes on a bounded number of rows a query, none beyond the k-th distance known
so far. So a query is copied to cells, not to lists, and neither bounds nor candidates are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillion.operators import index, retrieve
from quillion.sources.files import VersionedTable
from quillion.sources.shared import materialise

#: Vectors that centroids and code words are trained on, at most, chosen by a hash of their ids.
SAMPLE = 50_000
#: Dimensions of a part of a vector, and code words of each part.
PART, WORDS = 8, 256
#: Vectors of a cell, about: each is met by the queries of its lists, which stream by.
BLOCK = 32_768
#: Distances of queries from vectors that a task holds at once.
PAIRS = 1 << 20
#: Rows of numbers that are compared with all centroids at once.
ROWS = 2_048
#: Distances are rounded to six digits before they are ranked.
SLACK = 1e-5


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0.0)


def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, some rows at a time."""
    return np.concatenate([_squared(x[i : i + ROWS], centres).argmin(1) for i in range(0, max(1, len(x)), ROWS)])


def _trained(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spread starting rows; empty clusters keep their place."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _near(x, centres)
        n = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            centres[n > 0, d] = (np.bincount(near, x[:, d], k) / np.maximum(n, 1))[n > 0]
    return centres


class Codes:
    """Centroids and code words."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centroids = _trained(sample, lists)
        rest = sample - self.centroids[_near(sample, self.centroids)]
        self.starts = list(range(0, sample.shape[1], PART))
        self.words = [_trained(rest[:, s : s + PART], min(WORDS, len(sample))) for s in self.starts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, error of the code, distance to the centroid)."""
        near = _near(x, self.centroids)
        rest = x - self.centroids[near]
        codes = np.stack([_near(rest[:, s : s + PART], w) for s, w in zip(self.starts, self.words, strict=True)], axis=1).astype(np.uint8)
        return near, codes, np.sqrt(((rest - self.decode(codes)) ** 2).sum(1)), np.sqrt((rest * rest).sum(1))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], axis=1)


class VectorIndex:
    """An index at a path. Ids are whole numbers, one a vector; vectors that are null, of another length than most or not finite take no part."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, VersionedTable(spark, path)

    def part(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.table.current()}/{name}")

    def build(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None) -> str:
        """Write a version. ``lists``: about the square root of the number of vectors."""
        v = retrieve.doubles(F.col(vector_col))
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(retrieve.finite(F.col("v")) & F.col("id").isNotNull())
        size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if size is None:
            raise ValueError("no vector to index")
        rows, n = rows.where(F.size("v") == size["d"]), size["count"]
        chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, SAMPLE / n)))).select("v").toArrow()
        sample = _matrix(chosen["v"].combine_chunks()) if chosen.num_rows else _matrix(rows.limit(1).select("v").toArrow()["v"].combine_chunks())
        codes = Codes(sample, min(len(sample), lists or max(1, round(n**0.5))))
        shared = self.spark.sparkContext.broadcast(codes)

        def encode(batches):
            for batch in batches:
                near, code, error, apart = shared.value.encode(_matrix(batch.column("v")))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(code.shape[1]), len(code), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column("id"), packed, pa.array(error), pa.array(apart), batch.column("v")], ["list", "id", "codes", "error", "apart", "v"])

        made = materialise(rows.mapInArrow(encode, "list int, id long, codes binary, error double, apart double, v array<double>"), "vectors-coded")

        def write(folder: str) -> None:
            made.select("list", "id", "codes", "error", "v").repartition("list").sortWithinPartitions("list", "id").write.parquet(f"{folder}/vectors")
            sizes = made.groupBy("list").agg(F.count("*").alias("n"), F.max("apart").alias("radius"))
            centroids = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(codes.centroids)], "list int, centroid array<double>")
            centroids.join(sizes, "list", "left").write.parquet(f"{folder}/lists")
            words = [(i, j, w.tolist()) for i, x in enumerate(codes.words) for j, w in enumerate(x)]
            self.spark.createDataFrame(words, "part int, word int, v array<double>").write.parquet(f"{folder}/words")

        return self.table.commit(write)

    def _codes(self) -> tuple[Codes, np.ndarray, np.ndarray]:
        """Codes, and each list's size and radius: some hundred bytes a list."""
        lists = self.part("lists").orderBy("list").toArrow()
        codes = Codes.__new__(Codes)
        codes.centroids = _matrix(lists["centroid"].combine_chunks())
        codes.starts = list(range(0, codes.centroids.shape[1], PART))
        words = self.part("words").orderBy("part", "word").toArrow()
        part = words["part"].to_numpy()
        codes.words = [_matrix(words["v"].combine_chunks().filter(pa.array(part == i))) for i in range(len(codes.starts))]
        return codes, np.nan_to_num(lists["n"].to_numpy().astype(float)).astype(np.int64), np.nan_to_num(lists["radius"].to_numpy().astype(float))

    def _met(self, asks: DataFrame, codes: Codes, radii: np.ndarray, cells: tuple[np.ndarray, np.ndarray], k: int, same: bool) -> DataFrame:
        """(query_id, id, distance) of what can be among the k nearest in the asked cells. asks: (query_id, q, probed, most, cell).

        Without ``most`` the lists asked for are the probed ones; with it, all others that can hold a vector within it.
        """
        shared = self.spark.sparkContext.broadcast((codes, radii))
        dealt = self.spark.createDataFrame(list(zip(range(len(cells[0])), cells[0].tolist(), cells[1].tolist(), strict=True)), "list int, begin int, parts int")
        stored = self.part("vectors").join(F.broadcast(dealt), "list")  # a row a list
        cell = F.col("begin") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        stored = stored.select(cell.alias("cell"), F.lit(False).alias("asks"), "list", "id", "codes", "error", "v", F.lit(None).cast("array<int>").alias("probed"), F.lit(None).cast("double").alias("most"))
        copies = asks.select("cell", F.lit(True).alias("asks"), F.lit(None).cast("int").alias("list"), F.col("query_id").alias("id"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"), F.col("q").alias("v"), "probed", "most")

        def run(batches):
            now, held, block = None, [], None
            for whole in batches:
                keys = whole.column("cell").to_numpy()
                for a, b in zip(np.append(0, s := np.flatnonzero(np.diff(keys)) + 1).tolist(), np.append(s, len(keys)).tolist(), strict=True):
                    batch = whole.slice(a, b - a)
                    if b > a and keys[a] != now:
                        now, held, block = keys[a], [], None
                    asking = batch.column("asks").to_numpy(zero_copy_only=False)
                    own = batch.slice(0, int(np.count_nonzero(~asking)))
                    if own.num_rows:
                        held.append((own.column("list").to_numpy(), own.column("id").to_numpy(), np.frombuffer(b"".join(own.column("codes").to_pylist()), np.uint8).reshape(own.num_rows, -1), own.column("error").to_numpy(), _matrix(own.column("v"))))
                    part = batch.slice(own.num_rows)
                    if part.num_rows and held:
                        block = block or tuple(np.concatenate([h[i] for h in held]) for i in range(5))
                        held = [block]
                        yield _nearest(*shared.value, part, block, k, same)

        rows = stored.unionByName(copies).repartition("cell").sortWithinPartitions("cell", "asks", "list")
        return rows.mapInArrow(run, "query_id long, id long, distance double")

    def search(self, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", probes: int = 4, exact: bool = True, same: bool = True) -> DataFrame:
        """(query_id, rank, id, distance, similarity_score, rank_score) as ``retrieve.vector_top``. With ``same`` a vector of the query's own id is left out."""
        return self._search(queries, k, id_col, vector_col, probes, exact, same)[0]

    def coverage(self, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", probes: int = 4, exact: bool = True) -> DataFrame:
        """(query_id, lists, read): how many lists there are, and how many of them a search goes through for each query."""
        _, asked, lists = self._search(queries, k, id_col, vector_col, probes, exact, True)
        return asked.select("query_id", F.lit(lists).cast("long").alias("lists"), F.col("read").cast("long").alias("read"))

    def _search(self, queries, k, id_col, vector_col, probes, exact, same):
        codes, sizes, radii = self._codes()
        dimensions, full = codes.centroids.shape[1], np.flatnonzero(sizes > 0)
        # lists are dealt to cells one after the other, large ones to some of their own
        parts = np.where(sizes > BLOCK, -(-sizes // BLOCK), 1)
        begin = np.where(parts > 1, 0, np.cumsum(np.where(parts > 1, 0, sizes)) // BLOCK)
        alone = np.cumsum(np.where(parts > 1, parts, 0)) - parts + begin.max(initial=0) + 1
        cells = np.where(parts > 1, alone, begin), parts
        shared = self.spark.sparkContext.broadcast((codes.centroids, radii, full, cells))

        def asked(batches):
            """The cells of each query's first lists, or of the further ones that may hold something within ``most``, and how many lists these are."""
            centroids, radius, lists, (begins, each) = shared.value
            for batch in batches:
                for x in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                    apart = np.sqrt(_squared(_matrix(x.column("q")), centroids[lists]))
                    nearest = np.argsort(apart, 1, kind="stable")[:, :probes]
                    most = pc.fill_null(x.column("most"), np.inf).to_numpy()
                    wanted = np.zeros(apart.shape, bool)
                    np.put_along_axis(wanted, nearest, True, 1)
                    if x.column("further")[0].as_py():
                        wanted = ~wanted & (apart - radius[lists] <= most[:, None])
                    go = [np.unique(np.concatenate([np.arange(begins[i], begins[i] + each[i]) for i in lists[row]])) if row.any() else np.empty(0, int) for row in wanted]
                    offsets = np.append(0, np.cumsum([len(g) for g in go])).astype(np.int32)
                    probed = pa.ListArray.from_arrays(pa.array((np.arange(len(nearest) + 1) * nearest.shape[1]).astype(np.int32)), pa.array(lists[nearest].ravel().astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([x.column("query_id"), x.column("q"), x.column("most"), probed, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(go).astype(np.int32))), pa.array(wanted.sum(1))], ["query_id", "q", "most", "probed", "cells", "read"])

        def ask(rows: DataFrame, further: bool, tag: str) -> DataFrame:
            found = rows.withColumn("further", F.lit(further)).mapInArrow(asked, "query_id long, q array<double>, most double, probed array<int>, cells array<int>, read long")
            return materialise(found, tag)

        def met(asks: DataFrame) -> DataFrame:
            return self._met(asks.select("query_id", "q", "probed", "most", F.explode("cells").alias("cell")), codes, radii, cells, k, same)

        q = queries.select(F.col(id_col).cast("long").alias("query_id"), retrieve.doubles(F.col(vector_col)).alias("q")).where(retrieve.finite(F.col("q")) & (F.size("q") == dimensions))
        first = ask(q.withColumn("most", F.lit(None).cast("double")), False, "vectors-asked")
        found = materialise(index.top_k(met(first).withColumn("distance", F.round("distance", 6)), "query_id", k, "id", "distance", descending=False).drop("rank"), "vectors-first")
        read = first.select("query_id", "read")
        if exact:
            reached = found.groupBy("query_id").agg(F.max("distance").alias("far"), F.count("*").alias("n"))
            most = F.when(F.col("n") >= k, F.sqrt("far") + SLACK).otherwise(float("inf"))  # fewer: every list
            rest = ask(first.select("query_id", "q").join(reached, "query_id", "left").select("query_id", "q", most.alias("most")), True, "vectors-further")
            found = found.unionByName(met(rest).withColumn("distance", F.round("distance", 6)))
            read = first.select("query_id", "read").unionByName(rest.select("query_id", "read")).groupBy("query_id").agg(F.sum("read").alias("read"))
        best = index.top_k(found, "query_id", k, "id", "distance", descending=False)
        out = best.select("query_id", "rank", F.col("id").alias(id_col), "distance", F.round(1 / (1 + F.greatest("distance", F.lit(0.0))), 6).alias("similarity_score"), F.round(index.rank_similarity(F.col("rank")), 6).alias("rank_score"))
        return out, read, len(full)


def _nearest(codes: Codes, radii: np.ndarray, asks: pa.RecordBatch, cell: tuple, k: int, same: bool) -> pa.RecordBatch:
    """Of one cell, what can be among each query's k nearest: by bounds first, then by exact distances, and of those the k best with what ties."""
    lists, ids, code, error, v = cell
    query, q = asks.column("id").to_numpy(), _matrix(asks.column("v"))
    most = asks.column("most").to_numpy(zero_copy_only=False)  # none: not a number
    probed = np.asarray(asks.column("probed").flatten()).reshape(len(query), -1)
    cuts = np.flatnonzero(np.diff(lists)) + 1
    out = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(lists)).tolist(), strict=True):
        at = int(lists[a])
        mine = (probed == at).any(1)
        gap = np.sqrt(_squared(q, codes.centroids[at : at + 1]))[:, 0] - radii[at]
        asking = np.flatnonzero(np.where(np.isnan(most), mine, ~mine & (gap <= most)))
        decoded = codes.centroids[at] + codes.decode(code[a:b]) if len(asking) else None
        step = max(1, PAIRS // (b - a))
        for i in range(0, len(asking), step):
            some = asking[i : i + step]
            apart = np.sqrt(_squared(q[some], decoded))
            low, high = apart - error[a:b], apart + error[a:b]
            if same:
                high[ids[a:b] == query[some][:, None]] = low[ids[a:b] == query[some][:, None]] = np.inf
            limit = np.partition(high, k - 1, 1)[:, k - 1] if b - a > k else np.full(len(some), np.inf)
            limit = np.fmin(limit, most[some]) + SLACK
            row, one = np.nonzero((low <= limit[:, None]) & np.isfinite(low))
            for j in range(0, len(row), PAIRS // 16):
                r, o = some[row[j : j + PAIRS // 16]], a + one[j : j + PAIRS // 16]
                exact = ((v[o] - q[r]) ** 2).sum(axis=1)
                near = ~(np.sqrt(exact) > most[r] + SLACK)
                out.append((r[near], ids[o[near]], exact[near]))
            if sum(len(x[0]) for x in out) > PAIRS:
                out = [_best(*(np.concatenate(x) for x in zip(*out, strict=True)), k)]
    row, found, exact = _best(*(np.concatenate(x) for x in zip(*out, strict=True)), k)
    return pa.RecordBatch.from_arrays([pa.array(query[row]), pa.array(found), pa.array(exact)], ["query_id", "id", "distance"])


def _best(row: np.ndarray, ids: np.ndarray, exact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query in the order of rounded distances and ids, and some more, as distances are rounded before they are ranked."""
    order = np.lexsort((ids, np.round(exact, 6), row))
    row = row[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k + retrieve.SPARE
    return row[keep], ids[order][keep], exact[order][keep]
