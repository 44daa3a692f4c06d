"""Context for generation: sources packed under a budget, prompts, projections for the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.functions import text as X

NO_CONTEXT = "Aucun contexte pertinent trouvé."
SYSTEM = "Réponds uniquement à partir des sources fournies et cite-les sous la forme [S1]."


def packed(docs: DataFrame, by: str, rank: str = "rank", content: str = "content", budget: int = 3000, least: int = 1000, strict: bool = False) -> DataFrame:
    """(by, docs: array of (rank, text, ...)): texts in rank order, each cut to its share of what the ones before left over.

    The share depends on the lengths of the cut texts before, so it is a fold over the group's array. A group is what
    one question retrieved. ``strict`` never goes beyond the budget, which the least share otherwise may.
    """
    cols = [c for c in docs.columns if c != by]
    groups = docs.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("_rank"), F.coalesce(content, F.lit("")).alias("_text"), *(F.col(c) for c in cols)))).alias("d"))
    n = F.size("d")
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("i"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, d: Column) -> Column:
        share = F.floor((F.lit(budget) - acc["total"]) / F.greatest(n - acc["i"], F.lit(1)))
        limit = F.greatest(F.lit(0 if strict else least), share).cast("int")
        cut = X.cut_at_sentence(d["_text"], limit)
        return F.struct((acc["total"] + F.length(cut)).alias("total"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], F.array(cut)).alias("out"))

    texts = groups.select(by, "d", F.aggregate("d", start, add, lambda acc: acc["out"]).alias("texts"))
    return texts.select(by, F.posexplode(F.arrays_zip("d", "texts")).alias("at", "z")).select(by, (F.col("at") + 1).alias("position"), F.col("z.texts").alias("packed_text"), *(F.col("z.d")[c].alias(c) for c in cols))


def source_block(position: Column, title: Column, category: Column, text: Column, doc_title: Column | None = None, section_title: Column | None = None, section_num: Column | None = None, total_sections: Column | None = None) -> Column:
    """One ``<source>`` element; the document and the place in it are given where they add something."""
    empty = F.lit("")
    document = empty
    if doc_title is not None and section_title is not None:
        differs = (F.coalesce(doc_title, empty) != "") & (F.coalesce(section_title, empty) != "") & (doc_title != section_title)
        document = F.when(differs, F.concat(F.lit(' document="'), X.escape_html(doc_title), F.lit('"'))).otherwise("")
    place = empty
    if section_num is not None and total_sections is not None:
        known = (F.coalesce(section_num, F.lit(0)) != 0) & (F.coalesce(total_sections, F.lit(0)) != 0)
        place = F.when(known, F.concat(F.lit(' position="'), section_num.cast("string"), F.lit("/"), total_sections.cast("string"), F.lit('"'))).otherwise("")
    return F.concat(F.lit('<source id="S'), position.cast("string"), F.lit('" title="'), X.escape_html(F.coalesce(title, empty)), F.lit('" category="'), X.escape_html(F.coalesce(category, empty)), F.lit('"'), document, place, F.lit(">\n"), X.escape_html(text), F.lit("\n</source>"))


def contexts(blocks: DataFrame, by: str, position: str = "position", block: str = "block") -> DataFrame:
    """(by, context): a group's blocks in order."""
    return blocks.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, block))), lambda x: x[block]), "\n\n").alias("context"))


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit(SYSTEM + "\n\nSources :\n"), F.coalesce(context, F.lit(NO_CONTEXT)), F.lit("\n\nQuestion : "), question)


def source_projection(df: DataFrame, url: str = "source_url", section_title: str = "section_title", filename: str = "filename", category: str = "category", content: str = "content") -> list[Column]:
    """Columns of a source as the answer shows it."""
    empty = F.lit("")
    title = F.coalesce(F.nullif(F.col(section_title), empty), F.replace(F.replace(F.coalesce(F.col(filename), empty), F.lit(".html"), empty), F.lit("_"), F.lit(" ")))
    return [F.nullif(F.col(url), empty).alias("source_url"), title.alias("title"), F.coalesce(F.nullif(F.col(category), empty), F.lit("Unknown")).alias("category"), X.preview(F.coalesce(F.col(content), empty)).alias("content_preview")]
