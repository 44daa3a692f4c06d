"""Routing of questions: how many results, whether and how to expand."""

from __future__ import annotations

import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.functions import text as X
from quillion.functions.vocabulary import TAXONOMY


def matches(question: Column, taxonomy: dict[str, list[str]] | None = None) -> dict[str, Column]:
    folded = X.fold(F.coalesce(question, F.lit("")))
    return {name: X.contains_any(folded, ws) for name, ws in (taxonomy or TAXONOMY).items()}


def dynamic_k(question: Column, most: int = 8, taxonomy: dict[str, list[str]] | None = None) -> Column:
    """4 for specific questions, 8 for broad ones or those of over 12 words, else 6; never more than ``most``."""
    m = matches(question, taxonomy)
    broad = m["broad"] | (X.word_count(F.coalesce(question, F.lit(""))) > 12)
    return F.least(F.when(m["specific"] & ~broad, 4).when(broad, 8).otherwise(6), F.lit(most))


def expansion(question: Column, taxonomy: dict[str, list[str]] | None = None) -> Column:
    """How many variants are used, and whether a language model makes some: 0 none, 1 by rules, 2 with a model."""
    m, q = matches(question, taxonomy), F.coalesce(question, F.lit(""))
    folded = X.fold(q)
    off = m["specific"] | ((X.word_count(q) <= 10) & (folded.contains("comment") | folded.contains("quoi")))
    return F.when(off, 0).when(m["vague"], 2).otherwise(1)


def authorised(given: str | None, expected: str | None) -> bool:
    """Whether a request's key is the expected one, compared in constant time; without an expected key every request is."""
    return not expected or hmac.compare_digest((given or "").encode(), expected.encode())


def validated(questions: DataFrame, question: str = "question", most: int = 1000) -> DataFrame:
    """questions with ``error``: null, 'empty' (blank after stripping) or 'too long'."""
    q = F.coalesce(F.col(question), F.lit(""))
    return questions.withColumn("error", F.when(X.strip(q) == "", "empty").when(F.length(q) > most, "too long"))
