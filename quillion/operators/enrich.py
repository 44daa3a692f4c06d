"""Enrichment of chunks: reliability, freshness, categories, density, ids, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.functions import text as X
from quillion.functions.vocabulary import AUTO_CATEGORIES

DATE = r"(?i)(?<![\p{L}\p{N}_])(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2}\s+(janvier|février|mars|avril|mai|juin|juillet|aoû?t|septembre|octobre|novembre|décembre))(?![\p{L}\p{N}_])"
DAY = 86_400
#: Upper ends of text lengths, and chunk size and overlap below them.
CHUNKS = ((1500, 0, 0), (3000, 600, 100), (6000, 800, 150), (12_000, 1000, 200), (25_000, 1200, 250), (None, 1500, 300))
SIZES = ((2000, "very_short"), (5000, "short"), (10_000, "medium"), (20_000, "long"), (None, "very_long"))


def _steps(x: Column, steps, pick) -> Column:
    out = None
    for step in steps:
        if step[0] is not None:
            out = F.when(x < step[0], pick(step)) if out is None else out.when(x < step[0], pick(step))
    return out.otherwise(pick(steps[-1]))


def chunk_size(length: Column, has_sections: Column) -> Column:
    size = _steps(length, CHUNKS, lambda s: F.lit(s[1]))
    return F.when(has_sections, (size * 0.85).cast("int")).otherwise(size)


def chunk_overlap(length: Column, has_sections: Column) -> Column:
    overlap = _steps(length, CHUNKS, lambda s: F.lit(s[2]))
    return F.when(has_sections, (overlap * 0.85).cast("int")).otherwise(overlap)


def size_category(length: Column) -> Column:
    return _steps(length, SIZES, lambda s: F.lit(s[1]))


def freshness(date: Column, as_of: Column) -> Column:
    """1 to 0.3 by age in whole days; 0.5 for dates that are absent or can't be read. Dates without a zone are UTC."""
    ts = F.when(X.strip(F.coalesce(date.cast("string"), F.lit(""))) != "", F.try_to_timestamp(date.cast("string")))
    days = F.floor((F.unix_seconds(as_of) - F.unix_seconds(ts)) / DAY)
    return F.when(ts.isNull(), 0.5).when(days < 365, 1.0).when(days < 1095, 0.8).when(days < 1825, 0.6).when(days < 2920, 0.4).otherwise(0.3)


def signals(content: Column, freshness_: Column) -> dict[str, Column]:
    """The four signals of reliability."""
    low = F.lower(content)
    procedure = low.contains("étape") | low.contains("procédure") | low.contains("process") | low.contains("comment")
    return {
        "has_official_link": F.when(low.contains("whaller"), 1.0).otherwise(0.5),
        "is_procedure": F.when(procedure, 1.0).otherwise(0.5),
        "has_date_info": F.when(content.rlike(DATE), 1.0).otherwise(0.5),
        "document_freshness": freshness_,
    }


def reliability(signal: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for s in signal.values():
        total = total + s
    return total / len(signal)


def categories(content: Column) -> Column:
    low = F.lower(content)
    found = []
    for name, ws in AUTO_CATEGORIES.items():
        hit = F.lit(False)
        for w in ws:
            hit = hit | low.contains(w)
        found.append(F.when(hit, F.lit(name)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def density(content: Column) -> Column:
    ws = X.spaced_words(content)
    return F.size(F.array_distinct(ws)) / F.greatest(F.size(ws), F.lit(1))


def with_metadata(df: DataFrame, **changes: Column) -> DataFrame:
    """df with columns added or replaced; the given one stays as it is."""
    return df.withColumns(changes)


def with_parents(chunks: DataFrame, parents: DataFrame, parent_id: str = "parent_id", text: str = "text") -> DataFrame:
    """chunks with the text of the document or section that each is part of (null where it isn't known)."""
    return chunks.join(parents.select(parent_id, F.col(text).alias("parent_text")), parent_id, "left")


def chunk_ids(filename: Column, post_id: Column, section_num: Column, section_title: Column) -> dict[str, Column]:
    """parent_id, and child_id of a section, or of the whole text where section_num is null."""
    whole = X.stable_id(filename, post_id, F.lit("full"))
    return {"parent_id": X.stable_id(filename, post_id, F.lit("parent")), "child_id": F.when(section_num.isNull(), whole).otherwise(X.stable_id(filename, post_id, section_num, section_title))}


def row_type(doc_type: Column, is_summary: Column) -> Column:
    return F.when(doc_type.isNull(), "html").otherwise(F.concat(F.lit("html_"), doc_type, F.when(F.coalesce(is_summary, F.lit(False)), "_summary").otherwise("_section")))
