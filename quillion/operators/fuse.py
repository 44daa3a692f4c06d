"""Reciprocal rank fusion of two rankings, and removal of repeats over several queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANK_OFFSET = 60


def rrf(vector: DataFrame, lexical: DataFrame, by: str, key: str, limit: Column | int, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """(by, key, rank, rrf_score, similarity_score, vector_rank, bm25_rank, retrieval_source).

    Both inputs have (by, key, rank, similarity_score); weights are (lexical, vector). Without any lexical result for a
    question the vector list is cut instead. Ties: by vector rank, then by lexical rank, then by key.
    """
    one = vector.select(by, key, "rank", "similarity_score", F.lit("vector").alias("source"), F.lit(weights[1]).alias("w"))
    two = lexical.select(by, key, "rank", "similarity_score", F.lit("bm25").alias("source"), F.lit(weights[0]).alias("w"))
    is_vector = F.col("source") == "vector"
    merged = one.unionByName(two).groupBy(by, key).agg(
        F.sum(F.col("w") / (RANK_OFFSET + F.col("rank"))).alias("rrf"),
        F.array_join(F.sort_array(F.collect_set("source")), "+").alias("retrieval_source"),
        F.min(F.when(is_vector, F.col("rank"))).alias("vector_rank"),
        F.min(F.when(~is_vector, F.col("rank"))).alias("bm25_rank"),
        F.max(F.when(is_vector, F.col("similarity_score"))).alias("sv"),
        F.max(F.when(~is_vector, F.col("similarity_score"))).alias("sl"),
    )
    every = Window.partitionBy(by)
    merged = merged.withColumn("lexical", F.max(F.col("bm25_rank").isNotNull()).over(every))
    score = F.round("rrf", 8)
    similarity = F.coalesce("sv", "sl", F.lit(0.5))
    merged = merged.withColumn("rrf_score", F.when(F.col("lexical"), score)).withColumn("similarity_score", F.round(F.when(F.col("lexical"), F.greatest(similarity, 30 * F.col("rrf"))).otherwise(similarity), 6))
    order = Window.partitionBy(by).orderBy(F.desc("rrf_score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank"), key)
    out = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return out.select(by, key, "rank", "rrf_score", "similarity_score", "vector_rank", "bm25_rank", "retrieval_source")


def first_arrivals(results: DataFrame, by: str, key: str, variant: str = "variant_no", rank: str = "rank") -> DataFrame:
    """Of results of several query variants, each key's first by variant and rank, with its ``arrival`` number."""
    first = Window.partitionBy(by, key).orderBy(variant, rank)
    kept = results.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return kept.withColumn("arrival", F.row_number().over(Window.partitionBy(by).orderBy(variant, rank, key)))


def doc_key(source: Column, section_num: Column, section_title: Column, start_index: Column, content: Column) -> Column:
    """Stable key of a chunk: its place if any part of it is known, else a hash of its squeezed lower-case text."""
    from quillion.functions.text import squeeze

    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (source, section_num, section_title, start_index)]
    place = F.concat_ws("|", *parts)
    return F.when(F.concat(*parts) != "", place).otherwise(F.md5(squeeze(F.lower(content))))
