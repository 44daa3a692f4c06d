"""Files in and out: HTML folders, question sets, versioned tables, corpus versions, reports."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def html_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, filename, html) of all .html and .htm files below a folder; files that aren't UTF-8 have a null html and stay visible."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{html,htm}").load(folder)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), text.alias("html"))


def quarantine(parsed: DataFrame, error: str = "page.error") -> tuple[DataFrame, DataFrame]:
    """Good rows and bad ones."""
    return parsed.where(F.col(error).isNull()), parsed.where(F.col(error).isNotNull())


def question_set(spark: SparkSession, path: str) -> DataFrame:
    """(category, question) from a JSON array of {category, questions}; a missing or invalid file is an error."""
    rows = spark.read.schema("category string, questions array<string>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select("category", F.explode("questions").alias("question"))


def loose_questions(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """At most ``limit`` (a feature of this loader) non-blank questions from a JSON array of {question} or {category, questions}."""
    rows = spark.read.schema("question string, questions array<string>").option("multiLine", True).json(path)
    every = rows.select(F.explode(F.coalesce("questions", F.array("question"))).alias("question"))
    return every.where(F.trim("question") != "").limit(limit)


def corpus_version(spark: SparkSession, folder: str, override: str | None = None) -> str:
    """A version of the files below a folder: the override if given, 'missing-corpus' if there is none, else a hash of the listing."""
    override = override or os.environ.get("QUILLION_CORPUS_VERSION")
    if override:
        return override
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
        # an order-free hash, so no task gathers the listing
        entry = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
        row = files.agg(F.count("*").alias("n"), F.bit_xor(entry).alias("x"), F.sum(F.shiftrightunsigned(entry, 16)).alias("s")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return "missing-corpus"
        raise
    return "missing-corpus" if not row["n"] else f"{row['n']}-{row['x'] & (2**64 - 1):016x}-{row['s']}"


class VersionedTable:
    """A table that is replaced as a whole: a new version is written beside the old, then a pointer moves.

    A failed write leaves the old version in place; ``restore`` moves the pointer back.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointer(self) -> DataFrame:
        return self.spark.read.schema("n long, version string").json(f"{self.path}/_versions")

    def versions(self) -> list[str]:
        try:
            return [r["version"] for r in self._pointer().orderBy("n").collect()]  # one short row a version
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def _point(self, version: str, n: int) -> None:
        self.spark.createDataFrame([(n, version)], "n long, version string").coalesce(1).write.mode("append").json(f"{self.path}/_versions")

    def commit(self, write: Callable[[str], None]) -> str:
        """A new version of what ``write`` puts into the folder that it is given (a table, or folders of several)."""
        n = len(self.versions())
        version = f"v{n:06d}-{uuid.uuid4().hex[:8]}"
        write(f"{self.path}/{version}")
        self._point(version, n)
        return version

    def current(self) -> str:
        """The folder of the current version."""
        known = self.versions()
        if not known:
            raise ValueError(f"{self.path} holds no version")
        return f"{self.path}/{known[-1]}"

    def replace(self, df: DataFrame) -> str:
        return self.commit(df.write.parquet)

    def restore(self) -> str:
        """Back to the version before the current one."""
        known = self.versions()
        if len(known) < 2:
            raise ValueError("there is no earlier version")
        self._point(known[-2], len(known))
        return known[-2]

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.current())

    def count(self) -> int:
        return self.read().count()


def report(df: DataFrame, path: str, kind: str = "json") -> None:
    """Rows of a report as JSON lines, or as text lines of one string column."""
    df.write.mode("overwrite").format(kind).save(path)


def report_lines(results: DataFrame, line: Column, summary: DataFrame, title: str = "REPORT") -> DataFrame:
    """(value): a text report in order: a title, a line for each result (by ``line``), and the summary's columns as a footer."""
    head = results.sparkSession.createDataFrame([(0, "", title)], "part int, place string, value string")
    body = results.select(F.lit(1).alias("part"), F.format_string("%020d", F.monotonically_increasing_id()).alias("place"), line.alias("value"))
    names = F.array(*(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in summary.columns))
    foot = summary.select(F.lit(2).alias("part"), F.lit("").alias("place"), F.array_join(names, ", ").alias("value"))
    return head.unionByName(body).unionByName(foot).orderBy("part", "place", "value").select("value")


def from_json(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows back from what ``as_json`` made; lines that aren't of the schema give nulls."""
    return lines.select(F.from_json(column, schema).alias("r")).select("r.*")


def enveloped(results: DataFrame, metadata: dict[str, str]) -> DataFrame:
    """(value): each row as JSON in an envelope with what holds for the run: {"metadata": {...}, "result": {...}}."""
    about = F.struct(*(F.lit(v).alias(k) for k, v in metadata.items()))
    return results.select(F.to_json(F.struct(about.alias("metadata"), F.struct("*").alias("result"))).alias("value"))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))
