"""From raw documents to packed training sequences: five stages, each an operator of ``quillion.llm``.

Each stage works on all rows that the one before it kept. It is written as a table in shared storage and read again as
the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import quillion
from quillion.llm import decontaminate, linededup, packing, probminhash, store, toxicity
from quillion.llm.queries import byte_bpe

#: Documents that score this or more go.
TOXIC = 0.5
END_ID = 0


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the toxicity grammar, learned from the labelled raw documents, scores below ``TOXIC``."""
    grammar = toxicity.fit(store.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.scorer(spark, grammar)("text") < TOXIC)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without lines that occur earlier (within the edits that their length allows); documents that keep no line go."""
    return linededup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each near-duplicate class."""
    return probminhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 1024 tokens at most, with the ids."""
    return packing.pack(docs, byte_bpe(), end_id=END_ID).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("packing", pack)]

#: Models, edit distances and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    quillion.attach(spark)
    docs = store.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
