"""The answer cache as a stored table: buckets of keys, rewritten one by one, and a log of commits.

A key's hash names its bucket. A bucket is a folder of Parquet files sorted by key; a change writes new folders for the
buckets that it touches and leaves all others where they are. A commit is one small file in the log: for each bucket its
folder, how many rows it has and how old its oldest is, and the table's columns. So a reader reads one log file and
never sees half a change; a count, or a sweep in which nothing is too old, reads no rows.

Writers are optimistic. A commit takes the next number in the log, which only one writer can get. The one that comes
second looks at what happened since: buckets that others left alone keep what was written for them, the others are
written once more on top of the newer ones, and it tries again.

Columns can be added: rows of older files have nulls there. Names are case-sensitive here, types stay as they are.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.operators import cache
from quillion.sources.shared import materialise, scratch

#: Buckets of a new table. A bucket is rewritten whole, so a large cache wants many.
BUCKETS = 64
#: Keys up to which a lookup names them to the Parquet reader, which then skips row groups.
LISTED_KEYS = 200
#: Times that a writer tries again after others came first.
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Others came first each time."""


class _Log:
    """Numbered JSON files of a folder; a number can be taken once."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.folder = self._path(path)
        self.files = self.folder.getFileSystem(self.conf)

    def _path(self, *parts):
        return self.jvm.org.apache.hadoop.fs.Path(*parts)

    def numbers(self) -> list[int]:
        if not self.files.exists(self.folder):
            return []
        names = (s.getPath().getName() for s in self.files.listStatus(self.folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def read(self, number: int) -> dict:
        stream = self.files.open(self._path(self.folder, f"{number:020d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def take(self, number: int, entry: dict) -> bool:
        """Whether the entry got the number: a finished file is renamed to a name that must be free, which stores do atomically."""
        self.files.mkdirs(self.folder)
        own, target = self._path(self.folder, f"_{uuid.uuid4().hex}"), self._path(self.folder, f"{number:020d}.json")
        out = self.files.create(own, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        try:
            if self.files.getUri().getScheme() == "file":  # its rename looks first and moves then
                os.link(own.toUri().getPath(), target.toUri().getPath())
                return True
            return not self.files.exists(target) and self.files.rename(own, target)
        except FileExistsError:
            return False
        finally:
            self.files.delete(own, False)

    def remove(self, number: int) -> None:
        self.files.delete(self._path(self.folder, f"{number:020d}.json"), False)


class StoredCache:
    """Entries by key, the newest of each (as ``cache.latest``), in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str = "query_hash", time: str = "timestamp", tie: str = "entry_id", buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.key, self.time, self.tie, self.new_buckets = key, time, tie, buckets
        self.log = _Log(spark, f"{self.path}/_log")

    # --- what is there ---

    def version(self) -> int:
        """The newest commit's number, 0 if there is none."""
        return max(self.log.numbers(), default=0)

    def _state(self, version: int | None = None) -> tuple[int, dict]:
        number = self.version() if version is None else version
        return number, self.log.read(number) if number else {"n": self.new_buckets, "schema": None, "buckets": {}}

    def _bucket(self, n: int, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(key or self.key), F.lit(n)).cast("int")

    def _rows(self, state: dict, wanted: Iterable[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(state["schema"]) if state["schema"] else T.StructType([])
        held = state["buckets"] if wanted is None else {str(b): state["buckets"][str(b)] for b in wanted if str(b) in state["buckets"]}
        if not held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{b['at']}/bucket={k}" for k, b in held.items()))

    def read(self, version: int | None = None) -> DataFrame:
        """All entries, now or as of an earlier commit that is still kept."""
        return self._rows(self._state(version)[1])

    def count(self) -> int:
        """How many entries there are, from the log alone."""
        return sum(b["rows"] for b in self._state()[1]["buckets"].values())

    def matching(self, questions: DataFrame, key: str | None = None) -> DataFrame:
        """The entries that could be those of questions' keys: of their buckets only, and of their keys only if those are few."""
        key = key or self.key
        state = self._state()[1]
        if state["schema"] is None:
            return self._rows(state)
        asked = questions.select(F.col(key).alias(self.key)).where(F.col(self.key).isNotNull()).distinct()
        wanted = [r[0] for r in asked.select(self._bucket(state["n"])).distinct().collect()]  # at most as many as there are buckets
        rows = self._rows(state, wanted)
        few = asked.limit(LISTED_KEYS + 1).collect()
        return rows.where(F.col(self.key).isin([r[0] for r in few])) if len(few) <= LISTED_KEYS else rows

    def lookup(self, questions: DataFrame, now: Column, ttl_seconds: float | None = None) -> DataFrame:
        """As ``cache.lookup``; reads the buckets of the questions' keys."""
        found = self.matching(questions)
        if self.key not in found.columns:
            return questions.withColumn("hit", F.lit(False))
        return cache.lookup(questions, found, now, ttl_seconds, self.key, self.time)

    # --- changes ---

    def _written(self, rows: DataFrame, n: int) -> dict[str, dict]:
        """rows as new folders: {bucket: its entry in the log}. Buckets that got no row are absent."""
        at = uuid.uuid4().hex
        folder = f"{self.path}/data/{at}"
        dealt = rows.withColumn("bucket", self._bucket(n)).repartition("bucket").sortWithinPartitions("bucket", self.key)
        dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(folder)
        schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField(self.time, rows.schema[self.time].dataType)])
        told = self.spark.read.schema(schema).parquet(folder).groupBy("bucket").agg(F.count("*").alias("rows"), F.min(F.col(self.time).cast("double")).alias("oldest")).collect()
        return {str(r["bucket"]): {"at": at, "rows": r["rows"], "oldest": r["oldest"]} for r in told}

    def _merged_schema(self, state: dict, more: T.StructType | None) -> dict | None:
        old = T.StructType.fromJson(state["schema"]) if state["schema"] else T.StructType([])
        fields = {f.name: f for f in old}
        for f in more or []:
            if f.name in fields and fields[f.name].dataType != f.dataType:
                raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
            fields.setdefault(f.name, T.StructField(f.name, f.dataType, True))
        return T.StructType(list(fields.values())).jsonValue() if fields else None

    def _commit(self, wanted: Callable[[dict], set[str]], change: Callable[[DataFrame], DataFrame], schema: T.StructType | None = None) -> int:
        """Replace the ``wanted`` buckets of the current state by their rows after ``change``; the new commit's number.

        ``change`` gets the current rows of the buckets that have to be written, and is told which by its second
        argument. What was written stays good for each bucket that no other writer has changed meanwhile.
        """
        done: dict[str, tuple[dict | None, dict | None]] = {}
        layout = None
        for _ in range(ATTEMPTS):
            number, state = self._state()
            if layout != state["n"]:
                done, layout = {}, state["n"]
            merged = self._merged_schema(state, schema)
            touched = wanted(state)
            if not touched and merged == state["schema"]:
                return number
            stale = sorted(b for b in touched if b not in done or done[b][0] != state["buckets"].get(b))
            if stale:
                made = self._written(change(self._rows(state | {"schema": merged}, map(int, stale)), stale, state["n"]), state["n"])
                done |= {b: (state["buckets"].get(b), made.get(b)) for b in stale}
            buckets = {b: v for b, v in state["buckets"].items() if b not in touched}
            buckets |= {b: done[b][1] for b in touched if done[b][1]}
            if self.log.take(number + 1, {"n": state["n"], "schema": merged, "buckets": buckets}):
                return number + 1
        raise Conflict(f"{self.path}: others came first {ATTEMPTS} times")

    def upsert(self, new: DataFrame) -> int:
        """Add entries, the newest of each key; columns that the table lacks are added. The commit's number."""
        for c in (self.key, self.time, self.tie):
            if c not in new.columns:
                raise ValueError(f"column {c} is missing")
        with scratch(self.spark):
            rows = materialise(cache.latest(new, self.key, self.time, self.tie), "cache-new")
            found: dict[int, set[str]] = {}

            def touched(state: dict) -> set[str]:
                n = state["n"]
                if n not in found:
                    found[n] = {str(r[0]) for r in rows.select(self._bucket(n)).distinct().collect()}  # at most n
                return found[n]

            def change(old: DataFrame, stale: list[str], n: int) -> DataFrame:
                part = rows.where(self._bucket(n).isin([int(b) for b in stale]))
                return cache.latest(old.unionByName(part, allowMissingColumns=True), self.key, self.time, self.tie)

            return self._commit(touched, change, rows.schema)

    def sweep(self, now: float, ttl_seconds: float | None) -> int:
        """Take out entries past their time; only buckets that hold one are read. How many rows went, as the log tells."""
        before = self.count()
        old = lambda state: {b for b, v in state["buckets"].items() if ttl_seconds and v["oldest"] is not None and now - v["oldest"] > float(ttl_seconds)}
        self._commit(old, lambda rows, *_: rows.where(~F.coalesce(cache.expired(F.col(self.time), F.lit(now), ttl_seconds), F.lit(False))))
        return before - self.count()

    def clear(self) -> int:
        """Take out all entries; how many there were."""
        for _ in range(ATTEMPTS):
            number, state = self._state()
            rows = sum(b["rows"] for b in state["buckets"].values())
            if not rows or self.log.take(number + 1, state | {"buckets": {}}):
                return rows
        raise Conflict(f"{self.path}: others came first {ATTEMPTS} times")

    def rebucket(self, buckets: int) -> int:
        """The same entries in another number of buckets; everything is written once, and again if others came first."""
        for _ in range(ATTEMPTS):
            number, state = self._state()
            made = self._written(self._rows(state), buckets) if state["buckets"] else {}
            if self.log.take(number + 1, state | {"n": buckets, "buckets": made}):
                return number + 1
        raise Conflict(f"{self.path}: others came first {ATTEMPTS} times")

    def vacuum(self, keep: int = 2) -> int:
        """Delete all commits but the last ``keep``, and folders that none of those refers to; how many folders went.

        Only while no one writes: what a writer has not committed yet is referred to by nothing.
        """
        numbers = self.log.numbers()
        kept = numbers[-max(1, keep) :]
        used = {f"{b['at']}/bucket={k}" for n in kept for k, b in self.log.read(n)["buckets"].items()}
        for n in set(numbers) - set(kept):
            self.log.remove(n)
        data, gone = self.log._path(f"{self.path}/data"), 0
        for write in self.log.files.listStatus(data) if self.log.files.exists(data) else []:
            parts = [s.getPath() for s in self.log.files.listStatus(write.getPath()) if s.getPath().getName().startswith("bucket=")]
            idle = [p for p in parts if f"{write.getPath().getName()}/{p.getName()}" not in used]
            for p in idle:
                self.log.files.delete(p, True)
            gone += len(idle)
            if len(idle) == len(parts):
                self.log.files.delete(write.getPath(), True)
        return gone
