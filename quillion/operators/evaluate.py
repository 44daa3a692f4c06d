"""Evaluation of batches: outcomes, summaries, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome(success: Column, status: Column, error: Column) -> Column:
    """struct of success, status (0 if no answer came) and error."""
    return F.struct(F.coalesce(success, F.lit(False)).alias("success"), F.coalesce(status, F.lit(0)).alias("status"), error.alias("error"))


def summary(results: DataFrame, by: list[str], success: str = "success", seconds: str = "seconds") -> DataFrame:
    """Counts, shares in percent, total and mean seconds a group."""
    ok, n = F.count_if(F.col(success)), F.count("*")
    return results.groupBy(*by).agg(
        n.alias("n_questions"),
        ok.alias("n_success"),
        (n - ok).alias("n_error"),
        F.round(100.0 * ok / n, 6).alias("success_pct"),
        F.round(100.0 * (n - ok) / n, 6).alias("error_pct"),
        F.round(F.sum(seconds), 6).alias("total_seconds"),
        F.round(F.sum(seconds) / n, 6).alias("mean_seconds"),
    )


def with_total(docs: DataFrame, category: str) -> DataFrame:
    """(category, n) and a row TOTAL."""
    counted = docs.rollup(category).agg(F.count("*").alias("n"), F.grouping(category).alias("all"))
    return counted.select(F.when(F.col("all") == 1, "TOTAL").otherwise(F.col(category)).alias(category), "n")


def ingest_report(docs: DataFrame, chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row: documents, characters, chunks, and characters a chunk (whole)."""
    a = docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("long").alias("n_chars"))
    b = chunks.agg(F.count("*").alias("n_chunks"))
    return a.crossJoin(b).withColumn("avg_chars", F.expr("n_chars div greatest(n_chunks, 1)"))


def source_lines(sources: Column) -> Column:
    """Sources of an answer as text lines; unknown categories aren't shown."""
    return F.array_join(F.transform(sources, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["title"], F.when(s["category"] != "Unknown", F.concat(F.lit(" ("), s["category"], F.lit(")"))).otherwise(""))), "\n")
