"""Query expansion: synonyms, plurals, an injected language model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillion.functions import text as X
from quillion.operators import patterns


def thesaurus(spark: SparkSession, terms: dict[str, list[str]]) -> DataFrame:
    """(term, alternative) rows."""
    return spark.createDataFrame([(t, a) for t, alternatives in terms.items() for a in alternatives], "term string, alternative string")


def synonyms(questions: DataFrame, terms: DataFrame, id_col: str, question: str = "question") -> DataFrame:
    """(id, variant): each term in the lower-case question replaced by each alternative, plain and capitalised.

    Terms are found by an automaton in one pass over the questions, so a thesaurus may be long.
    """
    low = questions.select(id_col, F.lower(question).alias("_low"))
    found = patterns.occurring(low, "_low", terms).join(terms, "term")
    made = found.select(id_col, F.replace("_low", "term", "alternative").alias("v"))
    return made.select(id_col, F.explode(F.array("v", X.capitalised(F.col("v")))).alias("variant")).distinct()


def plurals(question: Column) -> Column:
    """Array of plural variants of a question that ends in a word; rules for two endings and one for all."""
    q = F.lower(question)
    last = F.regexp_extract(q, r"([\p{L}\p{N}_]+)$", 1)
    rules = [(last, F.lit(True)), (last, last.rlike(r"[\p{L}\p{N}_]tion$")), (last, last.rlike(r"[\p{L}\p{N}_]ement$"))]
    made = F.array(*(F.when((last != "") & fits & (F.length(F.concat(w, F.lit("s"))) > 3), F.replace(q, w, F.concat(w, F.lit("s")))) for w, fits in rules))
    return F.array_distinct(F.filter(made, lambda v: v.isNotNull()))


def by_model(questions: DataFrame, model: Callable[[str], str], id_col: str, question: str = "question", n: int = 2) -> DataFrame:
    """(id, variant) from an injected model's answer: its first n lines of over five characters; none if it fails."""

    def run(batches):
        for batch in batches:
            out = []
            for i, q in zip(batch[id_col], batch[question], strict=True):
                try:
                    lines = [s.strip() for s in model(q).splitlines()]
                except Exception:  # a model that fails gives no variants
                    lines = []
                out += [(i, s) for s in [s for s in lines if len(s) > 5][:n]]
            yield pd.DataFrame(out, columns=[id_col, "variant"])

    rows = questions.select(id_col, question)
    return rows.mapInPandas(run, f"{id_col} {dict(rows.dtypes)[id_col]}, variant string")


def variants(questions: DataFrame, terms: DataFrame, id_col: str, question: str = "question", extra: DataFrame | None = None) -> DataFrame:
    """(id, variant_no, variant): the question and all its variants, distinct, in code-point order."""
    own = questions.select(id_col, F.col(question).alias("variant"))
    many = questions.select(id_col, F.explode(plurals(F.col(question))).alias("variant"))
    every = own.unionByName(synonyms(questions, terms, id_col, question)).unionByName(many)
    every = every if extra is None else every.unionByName(extra)
    sets = every.where(F.col("variant").isNotNull()).groupBy(id_col).agg(F.sort_array(F.collect_set("variant")).alias("v"))
    return sets.select(id_col, F.posexplode("v").alias("at", "variant")).select(id_col, (F.col("at") + 1).alias("variant_no"), "variant")
