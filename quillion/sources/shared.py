"""Shared storage for intermediate tables.

Lineage is cut by writing Parquet tables under the folder that the session names in ``spark.checkpoint.dir``. Where that
setting is absent, a session on one machine (tests, notebooks) gets a default; on a cluster it is an error, as executors
and the driver share no local folder. Tables that are made inside ``scratch`` are deleted at its end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session has no ``spark.checkpoint.dir`` and driver and executors are one process.
LOCAL_DIR = "/tmp/checkpoints/quillion"

#: Paths of the tables made in the innermost open scratch.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or LOCAL_DIR).rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other run has used."""
    return f"{shared_dir(spark)}/quillion-{tag}-{uuid.uuid4().hex[:16]}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: lost executors never recompute what lies before it."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator:
    """Deletes the tables that are made inside, but for those whose making went through the function that it gives.

    That function takes what ``materialise`` takes; its tables belong to the scratch around this one, if there is one.
    Nothing that still reads a deleted table may leave.
    """
    outer = _MADE.get()
    own: list[str] = []
    token = _MADE.set(own)

    def kept(df: DataFrame, tag: str) -> DataFrame:
        inner = _MADE.set(outer)
        try:
            return materialise(df, tag)
        finally:
            _MADE.reset(inner)

    try:
        yield kept
    finally:
        _MADE.reset(token)
        for path in own:
            _delete(spark, path)
