"""Models that are plugged in, and offline stand-ins that are deterministic but stand for no real model's quality."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]
Generator = Callable[[str, str], str]

#: Models by name, with whether they want their texts marked as queries or documents.
PREFIXED = "nomic-embed-text"


def prefixes(model: str) -> tuple[str, str]:
    """What goes before a query and before a document for the named embedding model."""
    return ("search_query: ", "search_document: ") if PREFIXED in model.split(":")[0] else ("", "")


def hashing_embedder(dimensions: int = 64) -> Embedder:
    """Words hashed into a vector of unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dimensions
            for w in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dimensions] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    return embed


def embedded(df: DataFrame, text: str, embed: Embedder, prefix: str = "", column: str = "embedding") -> DataFrame:
    """df with the embedding of its texts, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in embed([prefix + (t or "") for t in x])])

    return df.withColumn(column, run(text))


def extractive(question: str, context: str) -> str:
    """A stand-in for generation: the sources' sentences that share most words with the question, cited."""
    asked = set(re.findall(r"\w{4,}", question.lower()))
    found: list[tuple[int, int, str]] = []
    for number, body in re.findall(r'<source id="S(\d+)"[^>]*>\n(.*?)\n</source>', context, flags=re.S):
        for sentence in re.split(r"[.!?\n]+", body):
            words = set(re.findall(r"\w{4,}", sentence.lower()))
            if len(sentence.strip()) > 8:
                found.append((-len(words & asked), len(found), f"{sentence.strip()} [S{number}]."))
    return " ".join(s for _, _, s in sorted(found)[:3])


def generated(df: DataFrame, question: str, context: str, model: Generator = extractive, column: str = "response") -> DataFrame:
    @F.pandas_udf("string")
    def run(q: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([model(a or "", b or "") for a, b in zip(q, c, strict=True)], dtype=object)

    return df.withColumn(column, run(question, context))


class Strategies:
    """Named strategies of which the first that can be made is used; a fallback takes over from one that fails."""

    def __init__(self, **makers: Callable[[], object]):
        self.makers = makers

    def get(self, wanted: Iterable[str]) -> tuple[str, object]:
        problems = []
        for name in wanted:
            try:
                return name, self.makers[name]()
            except Exception as e:
                problems.append(f"{name}: {e}")
        raise RuntimeError("; ".join(problems))


def env_flag(value: str | None, default: bool = False) -> bool:
    return default if value is None else value.strip().lower() in {"1", "true", "yes", "on"}


def env_int(value: str | None, default: int | None = None) -> int | None:
    return int(value) if value and value.strip().lstrip("-").isdigit() else default


def similarity_of(distance: Column) -> Column:
    return 1 / (1 + F.greatest(distance, F.lit(0.0)))
