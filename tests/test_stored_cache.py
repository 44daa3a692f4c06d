"""The stored cache: the same entries as the plain one, buckets rewritten one by one, writers that meet."""

import threading

import pytest
from pyspark.sql import functions as F

from quillion.operators import cache
from quillion.operators.stored_cache import StoredCache

SCHEMA = "query_hash string, timestamp double, entry_id long, response string"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def made(spark, *entries):
    return spark.createDataFrame(list(entries), SCHEMA)


@pytest.fixture()
def stored(spark, tmp_path):
    return StoredCache(spark, f"file://{tmp_path}/cache", buckets=8)


def test_equals_the_plain_cache(spark, stored):
    first = spark.createDataFrame([(f"k{i % 40}", float(i), i, f"r{i}") for i in range(100)], SCHEMA)
    second = spark.createDataFrame([(f"k{i}", 90.0, 500 + i, None) for i in range(0, 60, 7)] + [(None, 1.0, 1, "null key")], SCHEMA)
    stored.upsert(first)
    stored.upsert(second)
    plain = cache.upsert(cache.latest(first), second)
    columns = ("query_hash", "timestamp", "entry_id", "response")
    assert rows(stored.read(), *columns) == rows(plain, *columns) and stored.count() == plain.count()
    asked = spark.createDataFrame([("k1",), ("k7",), ("k999",), (None,), ("k1",)], "query_hash string")
    want = cache.lookup(asked, plain, F.lit(100.0), 30.0)
    assert rows(stored.lookup(asked, F.lit(100.0), 30.0), "query_hash", "hit", "entry_id") == rows(want, "query_hash", "hit", "entry_id")
    left = cache.swept(plain, F.lit(100.0), 30.0)
    assert stored.sweep(100.0, 30.0) == plain.count() - left.count() > 0
    assert rows(stored.read(), *columns) == rows(left, *columns)


def test_only_touched_buckets_are_written_and_read(spark, stored):
    stored.upsert(spark.createDataFrame([(f"k{i}", float(i), i, "r") for i in range(200)], SCHEMA))
    before = stored._state()[1]["buckets"]
    stored.upsert(made(spark, ("k3", 1000.0, 1000, "new")))
    after = stored._state()[1]["buckets"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    asked = spark.createDataFrame([("k3",)], "query_hash string")
    assert {f.rsplit("/", 2)[-2] for f in stored.matching(asked).inputFiles()} == {f"bucket={b}" for b in before if before[b] != after[b]}
    version = stored.version()
    assert stored.sweep(1000.0, None) == 0 and stored.sweep(10.0, 5000.0) == 0 and stored.version() == version
    assert stored.sweep(1000.0, 995.5) == 4  # the times 0, 1, 2 and 4, as 3 was replaced


def test_columns_are_added_and_types_stay(spark, stored):
    stored.upsert(made(spark, ("a", 1.0, 1, "old"), ("b", 1.0, 2, "old")))
    stored.upsert(spark.createDataFrame([("b", 2.0, 3, 8)], "query_hash string, timestamp double, entry_id long, top_k int"))
    assert rows(stored.read(), "query_hash", "response", "top_k") == [("a", "old", None), ("b", None, 8)]
    assert "top_k" not in stored.read(1).columns and stored.read(1).count() == 2
    with pytest.raises(ValueError, match="top_k"):
        stored.upsert(spark.createDataFrame([("b", 2.0, 3, "x")], "query_hash string, timestamp double, entry_id long, top_k string"))
    with pytest.raises(ValueError, match="entry_id"):
        stored.upsert(spark.createDataFrame([("b", 2.0)], "query_hash string, timestamp double"))


def test_concurrent_writers_lose_nothing(spark, stored):
    stored.upsert(made(spark, ("shared", 0.0, 0, "first")))
    problems = []

    def write(n):
        try:
            mine = StoredCache(spark, stored.path)
            for i in range(3):
                mine.upsert(made(spark, (f"w{n}-{i}", 1.0, n, "own"), ("shared", float(10 * i + n), n, f"w{n}")))
        except Exception as e:  # noqa: BLE001
            problems.append(e)

    writers = [threading.Thread(target=write, args=(n,)) for n in range(3)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert not problems
    found = {r["query_hash"]: r["timestamp"] for r in stored.read().collect()}
    assert found == {f"w{n}-{i}": 1.0 for n in range(3) for i in range(3)} | {"shared": 22.0}
    assert stored.version() == 10 and stored.count() == 10


def test_a_writer_that_comes_second_rewrites_only_what_changed(spark, stored, monkeypatch):
    stored.upsert(spark.createDataFrame([(f"k{i}", 1.0, i, "r") for i in range(100)], SCHEMA))
    other, take, written = StoredCache(spark, stored.path), stored.log.take, []

    def late(number, entry):
        monkeypatch.setattr(stored.log, "take", take)
        other.upsert(made(spark, ("k5", 5.0, 5, "other")))
        return take(number, entry)

    plain = stored._written
    monkeypatch.setattr(stored, "_written", lambda df, n: written.append(plain(df, n)) or written[-1])
    monkeypatch.setattr(stored.log, "take", late)
    stored.upsert(spark.createDataFrame([(f"k{i}", 3.0, i, "mine") for i in range(0, 100, 5)], SCHEMA))
    assert len(written) == 2 and len(written[0]) > 1 and len(written[1]) == 1
    found = {r["query_hash"]: r["response"] for r in stored.read().collect()}
    assert found == {f"k{i}": "other" if i == 5 else "mine" if i % 5 == 0 else "r" for i in range(100)}


def test_clear_rebucket_vacuum_and_empty(spark, stored):
    asked = spark.createDataFrame([("a",)], "query_hash string")
    assert stored.count() == 0 and stored.clear() == 0 and stored.lookup(asked, F.lit(1.0)).first()["hit"] is False
    stored.upsert(made(spark).limit(0))
    assert stored.count() == 0 and stored.read().columns == SCHEMA.replace(",", "").split()[::2]
    stored.upsert(spark.createDataFrame([(f"k{i}", 1.0, i, "r") for i in range(50)], SCHEMA))
    want = rows(stored.read(), "query_hash", "entry_id")
    stored.rebucket(3)
    assert rows(stored.read(), "query_hash", "entry_id") == want and len(stored._state()[1]["buckets"]) == 3
    stored.upsert(made(spark, ("k1", 9.0, 99, "new")))
    assert stored.vacuum(keep=1) > 0 and stored.count() == stored.read().count() == 50
    assert stored.clear() == 50 and stored.count() == 0 and stored.lookup(asked, F.lit(1.0)).first()["hit"] is False
