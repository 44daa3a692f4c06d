"""Feature-based reranking as column expressions, and reranking by an injected cross-encoder."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillion.functions import text as X
from quillion.functions.vocabulary import KEYWORD_STOP_WORDS, RERANK_VAGUE_WORDS, TAXONOMY


def keywords(question: Column) -> Column:
    return X.tokens(question, 3, KEYWORD_STOP_WORDS)


def hits(words: Column, folded: Column) -> Column:
    """How many of the words a text holds as substrings."""
    return F.size(F.filter(words, lambda w: F.contains(folded, w)))


def coverage(words: Column, content: Column) -> Column:
    low = F.lower(content)
    return F.when(F.size(words) == 0, 0.0).otherwise(F.least(hits(words, low) / F.greatest(F.size(words), F.lit(1)), F.lit(1.0)))


def with_question(df: DataFrame, question: str = "question", taxonomy: dict[str, list[str]] | None = None) -> DataFrame:
    """df with what every score needs of its question: folded text, keywords, broad and specific."""
    taxonomy = taxonomy or TAXONOMY
    df = df.withColumn("_question", X.fold(F.coalesce(F.col(question), F.lit("")))).withColumn("_keywords", keywords(F.coalesce(F.col(question), F.lit(""))))
    return df.withColumn("_broad", X.contains_any(F.col("_question"), taxonomy["broad"])).withColumn("_specific", X.contains_any(F.col("_question"), taxonomy["specific"]))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))


def with_metadata_score(df: DataFrame, content: str, filename: str, section_title: str, is_summary: str, reliability: str, density: str) -> DataFrame:
    """df (with a question's columns) plus ``metadata_score``; steps in a fixed order.

    Reliability and density may be null (then a half); is_summary null is false. Each step is a column of its own: as one
    nested expression, the score before a step would stand in it several times over.
    """
    words, question, broad, specific = F.col("_keywords"), F.col("_question"), F.col("_broad"), F.col("_specific")
    name = X.fold(F.replace(F.replace(F.coalesce(F.col(filename), F.lit("")), F.lit("_"), F.lit(" ")), F.lit(".html"), F.lit("")))
    df = df.withColumn("_name", name).withColumn("_title", X.fold(F.coalesce(F.col(section_title), F.lit(""))))
    summary = F.coalesce(F.col(is_summary), F.lit(False))
    asks = question.contains("comment") | question.contains("quoi")  # the third word of this list has an accent, which folded questions lack
    df = df.withColumn("_n", hits(words, F.col("_name"))).withColumn("_t", F.size(F.filter(F.transform(words, X.fold), lambda w: F.contains(F.col("_title"), w))))
    s = F.col("_s")
    df = df.withColumn("_s", F.when(F.col("_n") >= 2, 0.9).when(F.col("_n") == 1, 0.7).otherwise(0.5))
    df = df.withColumn("_s", F.when(summary, F.greatest(s, F.when(asks, 0.8).otherwise(0.4))).otherwise(s))
    df = df.withColumn("_s", F.when(summary & broad & ~specific, F.greatest(s, F.lit(0.85))).when(summary & specific, F.least(s, F.lit(0.35))).otherwise(s))
    df = df.withColumn("_s", F.when(F.col("_t") > 0, F.least(F.lit(1.0), s + F.least(F.col("_t") * 0.08, F.lit(0.20)))).otherwise(s))
    df = df.withColumn("_s", s * 0.85 + _unit(F.coalesce(F.col(reliability), F.lit(0.5))) * 0.15)
    d = F.coalesce(F.col(density), F.lit(0.5))
    df = df.withColumn("_s", F.when(d < 0.18, s * 0.9).when(d > 0.45, F.least(F.lit(1.0), s + 0.05)).otherwise(s))
    text = F.coalesce(F.col(content), F.lit(""))
    df = df.withColumn("_s", F.when((F.length(text) < 200) & F.lower(text).contains("whaller"), s * 0.6).otherwise(s))
    return df.withColumn("metadata_score", F.least(s, F.lit(1.0))).drop("_s", "_n", "_t", "_name", "_title")


def score(df: DataFrame, content: str = "content", similarity: str = "similarity_score", filename: str = "filename", section_title: str = "section_title", is_summary: str = "is_summary", reliability: str = "reliability_score", density: str = "information_density") -> DataFrame:
    """df (with a question's columns) plus ``metadata_score`` and ``rerank_score``: two gates, then a weighted sum.

    What several steps read is made once, in columns of its own.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    df = df.withColumn("_folded", X.fold(text)).withColumn("_exact", hits(F.col("_keywords"), F.col("_folded")))
    df = with_metadata_score(df, content, filename, section_title, is_summary, reliability, density)
    base = F.coalesce(F.col(similarity), F.lit(0.5))
    short = F.length(X.strip(text)) < 150
    redirect = F.col("_folded").contains("consulter") & F.col("_folded").contains("whaller")
    df = df.withColumn("_cover", coverage(F.col("_keywords"), text))
    cover = F.col("_cover")
    cover = F.when(F.col("_exact") >= 2, F.least(cover * 1.5, F.lit(1.0))).otherwise(cover)
    structure = F.least(F.greatest(X.sentence_number(text), F.lit(1)) / 15.0, F.lit(1.0))
    total = F.least(base, F.lit(1.0)) * 0.50 + F.least(F.length(text) / 4000.0, F.lit(1.0)) * 0.12 + structure * 0.08 + cover * 0.20 + F.col("metadata_score") * 0.10
    value = F.when(short & redirect & (base > 0.30), 0.60).when(short, 0.15).when((base < 0.30) & (F.col("_exact") < 2), 0.10).otherwise(total)
    return df.withColumn("rerank_score", value).drop("_cover")


def _kept(df: DataFrame, by: str, passes: Column, again: Column | None, k: Column | int, order: list[Column]) -> DataFrame:
    """The k best of each group that pass; if fewer than two do, those that pass ``again``; if none does, the best one."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    every = Window.partitionBy(by)
    ranked = ranked.withColumn("_pass", passes).withColumn("_again", passes if again is None else again)
    ranked = ranked.withColumn("_n", F.count_if("_pass").over(every)).withColumn("_m", F.count_if("_again").over(every))
    least = 2 if again is not None else 1
    chosen = F.when(F.col("_n") >= least, F.col("_pass")).when(F.col("_m") >= 1, F.col("_again")).otherwise(F.col("rank") == 1)
    return ranked.where(chosen & (F.col("rank") <= k)).drop("_pass", "_again", "_n", "_m")


def top(df: DataFrame, by: str, k: Column | int = 5, arrival: str = "arrival") -> DataFrame:
    """Reranked results: the k best above the threshold for the question's kind, with fallbacks; ``rank`` from 1.

    df is what ``score`` gives. Scores are compared to six places, ties go by arrival.
    """
    value = F.round("rerank_score", 6)
    vague = X.contains_any(F.col("_question"), RERANK_VAGUE_WORDS + TAXONOMY["broad"])
    return _kept(df.withColumn("rerank_score", value), by, F.col("rerank_score") > F.when(vague, 0.32).otherwise(0.38), F.col("rerank_score") > F.when(vague, 0.28).otherwise(0.32), k, [F.desc("rerank_score"), F.asc(arrival)])


def cross_metadata(words: Column, filename: Column, content: Column) -> Column:
    """What the metadata adds to a cross-encoder's score."""
    name = F.replace(F.replace(F.lower(F.coalesce(filename, F.lit(""))), F.lit("_"), F.lit(" ")), F.lit(".html"), F.lit(""))
    n = hits(words, name)
    return F.when(n >= 2, 0.10).when(n == 1, 0.05).otherwise(0.0) - F.when(F.length(F.coalesce(content, F.lit(""))) < 200, 0.15).otherwise(0.0)


def cross_normalised(raw: Column) -> Column:
    return _unit((raw + 10) / 20)


def cross_top(df: DataFrame, by: str, k: Column | int = 5, raw: str = "cross_encoder_raw", content: str = "content", filename: str = "filename", arrival: str = "arrival") -> DataFrame:
    """Results by a cross-encoder's raw score (in column ``raw``), cut at 0.25, at least the best one."""
    value = F.round(_unit(cross_normalised(F.col(raw)) + cross_metadata(F.col("_keywords"), F.col(filename), F.col(content))), 6)
    return _kept(df.withColumn("rerank_score", value), by, F.col("rerank_score") > 0.25, None, k, [F.desc("rerank_score"), F.asc(arrival)])


def cross_scores(df: DataFrame, model: Callable[[list[tuple[str, str]]], list[float]], question: str = "question", content: str = "content", batch: int = 16, chars: int = 1500) -> DataFrame:
    """df with ``cross_encoder_raw`` by an injected model, in batches of pairs, content cut to ``chars``."""

    @F.pandas_udf("double")
    def run(q: pd.Series, c: pd.Series) -> pd.Series:
        pairs = [(a or "", (b or "")[:chars]) for a, b in zip(q, c, strict=True)]
        return pd.Series([float(s) for i in range(0, len(pairs), batch) for s in model(pairs[i : i + batch])], dtype="float64")

    return df.withColumn("cross_encoder_raw", run(question, content))
