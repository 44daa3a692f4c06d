"""Token-ID output: documents as compressed token ids in ascending id order, in blocks that decode independently.

A data set is a folder with three tables. ``table`` holds the shared frequency of every token id, counted over all
documents. ``blocks`` holds one row a block: shard and number, the documents in it (ids and lengths) and the rANS
payload (see ``rans``). ``shards`` holds each shard's place in the whole order. Parquet is only the container, so that
any store that Spark writes to will do and a lost executor's half-written files never show.

A block holds whole documents, at least ``BLOCK_TOKENS`` ids unless it is its shard's last; one very long document makes
one long block, decoded segment by segment. Rows with equal ids keep one order (by a hash of their text); a null id
comes first; null texts are as empty ones; an empty table gives empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.llm import rans, store, tokens
from quillion.llm.words import give_back

BLOCK_TOKENS = 1 << 18

_TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("ids", T.BinaryType())])
_COUNTS = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("n", T.LongType())])
_BLOCKS = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_tokens", T.ArrayType(T.IntegerType())),
        T.StructField("payload", T.BinaryType()),
    ]
)
_READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


def _narrow(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def tokenise(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, ids) of every document, in one pass; ids are 2 bytes each where the vocabulary allows."""

    def run(batches):
        encode = tokens.encoder(tokenizer)
        kind = _narrow(max(encode.vocabulary, (end_id or 0) + 1))
        for batch in batches:
            for a, b, ids, counts in encode.chunks(batch.column(2), end_id):
                ids = ids.astype(kind)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<i4") * ids.itemsize
                column = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], column], names=["doc_id", "tie", "ids"])
        give_back(tokens.STEP)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text")).mapInArrow(run, _TOKENS)


def _joined(column: pa.Array, kind: str, limit: int = 1 << 22):
    """The ids of a column of documents, in arrays of about ``limit`` bytes."""
    held, size = [], 0
    for x in column:
        held.append(x.as_py())
        size += len(held[-1])
        if size >= limit:
            yield np.frombuffer(b"".join(held), kind)
            held, size = [], 0
    yield np.frombuffer(b"".join(held), kind)


def _count(encoded: DataFrame, kind: str, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents; the driver gets a row for each id of the vocabulary at most."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for flat in _joined(batch.column(0), kind):
                total += np.bincount(flat, minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for id_, n in encoded.select("ids").mapInArrow(run, _COUNTS).groupBy("id").agg(F.sum("n")).collect():
        out[id_] = n
    return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs into the data set at path (see the module), which must not exist yet."""
    spark = docs.sparkSession
    vocabulary = max(tokens.encoder(tokenizer).vocabulary, (end_id or 0) + 1)
    kind = _narrow(vocabulary)
    encoded = store.materialise(tokenise(docs, tokenizer, end_id, id_col, text_col), "token-ids")
    freq = rans.quantise(_count(encoded, kind, vocabulary))
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq)], "id int, freq long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)

    def run(batches):
        table, shard = rans.Table.of(shared.value), TaskContext.get().partitionId()
        ids, sizes, held, total, start, number = [], [], [], 0, 0, 0

        def block():
            payload = rans.encode(np.frombuffer(b"".join(held), kind), table)
            row = {"shard": shard, "block": number, "start": start, "n_tokens": total, "doc_ids": ids, "doc_tokens": sizes, "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for id_, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = x.as_py()
                n = len(data) // np.dtype(kind).itemsize
                ids.append(id_)
                sizes.append(n)
                held.append(data)
                total += n
                if total >= BLOCK_TOKENS:
                    yield block()
                    start, number = start + total, number + 1
                    ids, sizes, held, total = [], [], [], 0
        if ids:
            yield block()
        give_back()

    arrow = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("payload", pa.binary())])
    ordered = encoded.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    ordered.mapInArrow(run, _BLOCKS).write.parquet(f"{path}/blocks")
    sums = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # a row a shard
    bases = np.concatenate([[0], np.cumsum([r["n"] for r in sums])]).astype(int).tolist()
    spark.createDataFrame([(r["shard"], base) for r, base in zip(sums, bases, strict=False)], "shard int, base long").coalesce(1).write.parquet(f"{path}/shards")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document; ids are little-endian unsigned 32-bit integers.

    Blocks are decoded where they are read, each by itself; a damaged one raises ValueError.
    """
    freq = np.array([r["freq"] for r in spark.read.parquet(f"{path}/table").orderBy("id").collect()])  # as long as the vocabulary
    shared = spark.sparkContext.broadcast(freq)

    def run(batches):
        table = rans.Table.of(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                flat = rans.Block(row["payload"], table).decode().astype("<u4", copy=False)
                ends = np.cumsum(row["doc_tokens"]).astype(np.int64)
                starts = ends - row["doc_tokens"]
                ids = [flat[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * len(ids), pa.int32()), pa.array(row["start"] + starts, pa.int64()), pa.array(row["doc_tokens"], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "shard", "local_start", "n_tokens", "ids"],
                )
        give_back()

    decoded = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").mapInArrow(run, _READ)
    shards = spark.read.parquet(f"{path}/shards")  # a row for each file of the data set, which the writer's driver has held
    return decoded.join(F.broadcast(shards), "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")
