"""Streaming extensions: pages and answer logs as they arrive. Beyond batch semantics, but with the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillion.plans import pipeline


def pages(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Rows (page_id, url, html) of Parquet files as they land in a folder."""
    return spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", files).parquet(folder)


def ingest(stream: DataFrame, out: str, checkpoint: str, as_of: str) -> StreamingQuery:
    """Chunks of arriving pages, each micro-batch in a folder of its own, so that one that is repeated replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        pipeline.ingest(batch, F.lit(as_of).cast("timestamp")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Rows whose key wasn't seen before, within a watermark that bounds the state."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def activity(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of events by kind in tumbling windows; works on streams (with a watermark) and tables alike."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("window_start"), kind, "n", "total")
