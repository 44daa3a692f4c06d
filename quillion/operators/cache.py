"""Answer cache as a table: keys, lookups, latest-wins upserts, expiry, clearing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.functions import text as X


def namespace(model: Column, embedder: Column, corpus: Column) -> Column:
    return F.concat(F.lit("model="), model, F.lit("|embed="), embedder, F.lit("|corpus="), corpus)


def key(query: Column, namespace_: Column) -> Column:
    """MD5 of a JSON object of namespace and normalised query (which holds no character that JSON escapes)."""
    return F.md5(F.concat(F.lit('{"namespace": "'), namespace_, F.lit('", "query": "'), X.query_key(F.coalesce(query, F.lit(""))), F.lit('"}')))


def latest(rows: DataFrame, key_col: str = "query_hash", time: str = "timestamp", tie: str = "entry_id") -> DataFrame:
    """One row a key: the newest, of equal times the one with the largest tie. Partial maxima are made before the shuffle."""
    others = [c for c in rows.columns if c not in (key_col, time, tie)]
    best = rows.groupBy(key_col).agg(F.max(F.struct(time, tie, *others)).alias("r"))
    return best.select(key_col, *(F.col("r")[c].alias(c) for c in rows.columns if c != key_col))


def upsert(cache: DataFrame, new: DataFrame, **columns) -> DataFrame:
    """The cache with new rows; columns that either lacks are null."""
    return latest(cache.unionByName(new, allowMissingColumns=True), **columns)


def expired(time: Column, now: Column, ttl_seconds: float | None) -> Column:
    """Whether an entry is too old; no or a zero time to live means never."""
    return now - time > F.lit(float(ttl_seconds)) if ttl_seconds else F.lit(False)


def lookup(questions: DataFrame, cache: DataFrame, now: Column, ttl_seconds: float | None = None, key_col: str = "query_hash", time: str = "timestamp") -> DataFrame:
    """questions with the cache's columns and ``hit``; entries past their time are misses."""
    found = questions.join(cache, key_col, "left")
    return found.withColumn("hit", F.coalesce(F.col(time).isNotNull() & ~expired(F.col(time), now, ttl_seconds), F.lit(False)))


def misses(questions: DataFrame, cache: DataFrame, key_col: str = "query_hash") -> DataFrame:
    return questions.join(cache, key_col, "left_anti")


def swept(cache: DataFrame, now: Column, ttl_seconds: float | None, time: str = "timestamp") -> DataFrame:
    """The cache without entries past their time."""
    return cache.where(~expired(F.col(time), now, ttl_seconds))


def cleared(cache: DataFrame) -> tuple[DataFrame, int]:
    """An empty cache of the same columns, and how many entries went."""
    return cache.limit(0), cache.count()
