"""Spark-native retrieval and answer-verification analytics."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def attach(spark: SparkSession) -> SparkSession:
    """Let the Python workers that start from now on import this package from where the driver has it (for clusters, ship it with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark
