"""Table functions in SQL text against the DataFrame operators."""

import pytest
from pyspark.sql import functions as F

from quillion.operators import chunk, sections, tables

TEXTS = [
    "Titre du document : Guide\n\nintro\n+-Un\nCorps un FQBB++-FIRST fin\nencore\n+-Deux\n\nCorps deux\n",
    "no marker", None, "", "+-", "+-\n+-A +-B\nbody", "x" * 3000 + "\n\n" + "word " * 900 + "\n\n" + "\n+-é\n\n" * 30,
    "\n".join(f"+-T{i}\nline {i}" for i in range(5000)),
]


@pytest.fixture()
def docs(spark):
    tables.register(spark)
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)


def test_sections_by_lines(spark, docs):
    lines = docs.select(F.col("id").cast("string").alias("id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    text = "SELECT * FROM marked_sections(TABLE(SELECT id, line_no, line FROM {lines}) PARTITION BY id ORDER BY line_no)"
    got = spark.sql(text, lines=lines).select(F.col("id").cast("long"), "section_num", "total_sections", "section_title", "prev_section_title", "next_section_title", "content")
    want = sections.split(docs, "id", "text").drop("doc_title", "doc_type")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and want.where("total_sections = 5000").count() == 5000
    double = want.where("id = 5").collect()
    assert [(r["section_title"], r["content"]) for r in double] == [("A +-B", "A +-B\n\nbody")]


def test_chunks_in_lateral_joins_and_over_tables(spark, docs):
    size = F.when(F.col("id").isin(0, 4), 0).when(F.col("id") != 3, 40)
    asked = docs.select("*", size.alias("chunk_size"), F.when(F.col("id") % 2 == 0, F.lit(20)).alias("chunk_overlap"))
    want = chunk.chunked(asked, ["id"], "text").select("id", "chunk_index", "start_index", "chunk")
    lateral = spark.sql("SELECT d.id, c.* FROM {d} d, LATERAL text_chunks(d.text, d.chunk_size, d.chunk_overlap) c", d=asked)
    whole = spark.sql("SELECT CAST(id AS BIGINT) AS id, chunk_index, start_index, chunk FROM chunked_table(TABLE(SELECT CAST(id AS STRING) AS id, text AS content, chunk_size, chunk_overlap FROM {d}))", d=asked)
    assert want.count() > 1000
    for got in (lateral, whole):
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert lateral.where("false").isEmpty() and spark.sql("SELECT * FROM chunked_table(TABLE(SELECT CAST(id AS STRING) AS id, text AS content, chunk_size, chunk_overlap FROM {d} WHERE id < 0))", d=asked).isEmpty()
