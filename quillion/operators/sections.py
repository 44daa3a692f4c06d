"""Sections of documents: split at markers, summaries, neighbours, kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.functions import text as X
from quillion.functions.vocabulary import PROCESS_MARKERS

MARKER = r"\+-([^\n]+)"
TITLE_LINE = r"Titre du document : ([^\n]+)"


def doc_title(text: Column) -> Column:
    return F.coalesce(F.nullif(X.strip(F.regexp_extract(text, TITLE_LINE, 1)), F.lit("")), F.lit("Document"))


def doc_type(text: Column, amadeus: tuple[str, ...] = ("Formats utiles Amadeus", "Formats et TUTO utiles")) -> Column:
    """'amadeus', 'process' or 'structured', by phrases (case counts)."""
    def any_of(ws):
        out = F.lit(False)
        for w in ws:
            out = out | text.contains(w)
        return out

    return F.when(any_of(amadeus), "amadeus").when(any_of(PROCESS_MARKERS), "process").otherwise("structured")


def split(docs: DataFrame, id_col: str, text_col: str, anchored: bool = False) -> DataFrame:
    """(id, section_num, total_sections, section_title, prev_section_title, next_section_title, content, doc_title, doc_type) of texts with markers.

    A marker is ``+-Title`` anywhere in the text, or at line starts only if ``anchored``. Texts without one give no row.
    Everything is done within the row, on arrays, so nothing is shuffled.
    """
    marker = r"(?m)^" + MARKER if anchored else MARKER
    text = F.col(text_col)
    rows = docs.select(id_col, text.alias("_t"), F.regexp_extract_all(text, F.lit(marker), F.lit(1)).alias("_titles"))
    rows = rows.where(F.size("_titles") > 0)
    bodies = F.slice(F.split("_t", marker), 2, 2**30)  # a marker's whole line is the title, even if it holds another mark
    rows = rows.withColumn("_bodies", bodies).withColumn("_names", F.transform("_titles", X.strip))
    each = rows.select(id_col, "_t", "_names", F.size("_names").alias("total_sections"), F.posexplode("_bodies").alias("at", "body"))
    rest = X.strip(F.col("body"))
    name = F.get("_names", F.col("at"))
    return each.select(
        id_col,
        (F.col("at") + 1).alias("section_num"),
        "total_sections",
        name.alias("section_title"),
        F.when(F.col("at") > 0, F.get("_names", F.col("at") - 1)).otherwise("").alias("prev_section_title"),
        F.coalesce(F.get("_names", F.col("at") + 1), F.lit("")).alias("next_section_title"),
        F.concat(name, F.lit("\n\n"), rest).alias("content"),
        doc_title(F.col("_t")).alias("doc_title"),
        doc_type(F.col("_t")).alias("doc_type"),
    )


def summaries(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section_num 0, total_sections, section_title, content): a table of contents of each text with markers."""
    text = F.col(text_col)
    rows = docs.select(id_col, doc_title(text).alias("title"), F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)), X.strip).alias("names"), F.get(F.split(text, r"\+-(?=[^\n])"), F.lit(0)).alias("before")).where(F.size("names") > 0)
    intro = X.strip(F.regexp_replace(X.strip(F.col("before")), TITLE_LINE + r"\n?", ""))
    listed = F.array_join(F.transform("names", lambda t, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), t)), "\n")
    parts = F.filter(F.array(F.concat(F.lit("Document: "), F.col("title")), F.lit(""), F.lit("Sommaire:"), F.when(F.length(intro) > 50, F.concat(F.lit("\nIntroduction :\n"), F.left(intro, F.lit(400)))), F.lit("\nSections :"), listed), lambda x: x.isNotNull())
    return rows.select(id_col, F.lit(0).alias("section_num"), F.size("names").alias("total_sections"), F.col("title").alias("section_title"), F.array_join(parts, "\n").alias("content"))
