"""Small helpers that every operator uses, and the shared storage for intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillion.sources.shared import fresh_path, materialise, scratch, shared_dir

__all__ = ["documents", "free_name", "fresh_path", "has_rows", "held_out", "labelled_sample", "materialise", "scratch", "shared_dir"]


def has_rows(df: DataFrame) -> bool:
    return bool(df.take(1))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents whose labels are never learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of about ``bound`` labelled rows at most, chosen by a hash of the id; held-out rows never appear.

    Rows whose label, id or text is null take no part; of several labels for one id, the largest counts.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).where(~held_out(F.col("_id")) & F.col("label").isNotNull()).groupBy("_id").agg(F.max("label").alias("label"))
    n = known.count()
    parts = 1_000_000
    if n > bound:
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(parts)) < int(parts * bound / n))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < int(parts * bound / n))
    return rows.join(known, rows["doc_id"] == known["_id"]).select("doc_id", "text", "label")
