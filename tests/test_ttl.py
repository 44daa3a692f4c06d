"""Time to live as state: a stream's evictions equal a sweep, its hits a lookup."""

import pytest
from pyspark.sql import functions as F

from quillion.operators import cache
from quillion.streaming import ttl


@pytest.fixture()
def stores(spark):
    for k, v in ttl.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in ttl.STORE:
        spark.conf.unset(k)


def test_a_stream_equals_sweep_and_lookup(stores, tmp_path):
    spark = stores
    batches = [
        [("answer", "a", 0, 1, "old"), ("answer", "b", 5, 2, "b"), ("ask", "a", 3, 10, None), ("ask", "c", 4, 11, None), ("answer", "d", 1, 3, "d")],
        [("answer", "a", 20, 4, "new"), ("ask", "a", 22, 12, None), ("ask", "b", 36, 13, None), ("answer", "e", 20, 6, "low"), ("answer", "e", 20, 7, "high"), ("other", "e", 21, 8, None)],
        [("ask", "a", 50, 14, None), ("ask", "e", 50, 15, None), ("answer", "f", 51, 9, "f")],
    ]
    made = [spark.createDataFrame([(k, h, t, e, r) for k, h, t, e, r in b], "kind string, query_hash string, t long, entry_id long, response string").withColumn("at", F.timestamp_seconds(F.col("t") + 1000)) for b in batches]
    for i, part in enumerate(made):
        part.drop("t").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(ttl.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = ttl.outcomes(stream, 30).writeStream.format("memory").queryName("outcomes").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(150)
    finally:
        query.stop()
    got = [tuple(r) for r in spark.table("outcomes").select("event", "query_hash", "entry_id", "answer_id", "response").collect()]
    every = made[0].union(made[1]).union(made[2])
    latest = cache.latest(every.where("kind = 'answer'").select("query_hash", F.col("t").cast("double").alias("timestamp"), "entry_id", "response"))
    left = {r[0] for r in cache.swept(latest, F.lit(51.0), 30.0).select("query_hash").collect()}
    assert left == {"f"}
    evicted = [g for g in got if g[0] == "evicted"]
    assert {g[1] for g in evicted} == {r["query_hash"] for r in latest.collect()} - left and len(evicted) == len({g[1] for g in evicted})
    assert sorted(g for g in got if g[0] != "evicted") == sorted(
        [("hit", "a", 10, 1, "old"), ("miss", "c", 11, None, None), ("hit", "a", 12, 4, "new"), ("miss", "b", 13, None, None), ("hit", "a", 14, 4, "new"), ("hit", "e", 15, 7, "high")]
    )


def test_without_an_end_is_an_error(spark):
    with pytest.raises(ValueError, match="ttl_seconds"):
        ttl.outcomes(spark.createDataFrame([], ttl.EVENTS), 0)
