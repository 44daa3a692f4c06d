"""A bitmap of fixed size that tells which 64-bit keys may be wanted, so that unwanted rows needn't be shuffled.

It never drops a wanted key. With more keys than it has room for, it lets more unwanted ones pass, and the exact join
behind it does the rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.llm.words import mix

#: 2**26 bits are 8 MiB, whatever the data.
BITS = 26
_CHUNK = BITS - 10
_PLACES = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("place", T.IntegerType())])


def _positions(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def of(wanted: DataFrame, key: str) -> np.ndarray:
    """The bitmap of wanted's keys, made in 1024 chunks of at most 2**16 distinct places."""

    def places(batches):
        for batch in batches:
            at = _positions(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array((at >> _CHUNK).astype(np.int32)), pa.array((at & ((1 << _CHUNK) - 1)).astype(np.int32))], names=["chunk", "place"])

    def bits(table: pa.Table) -> pa.Table:
        flags = np.zeros(1 << _CHUNK, np.uint8)
        flags[table["place"].to_numpy()] = 1
        return pa.table({"chunk": table["chunk"][:1], "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    made = wanted.select(key).mapInArrow(places, _PLACES).distinct().groupBy("chunk").applyInArrow(bits, "chunk int, bits binary")
    out = np.zeros((1 << BITS) // 8, np.uint8).reshape(1 << 10, -1)
    for row in made.collect():  # 1024 rows at most, 8 MiB
        out[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def may_hold(flags: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _positions(keys)
    return (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def passes(spark: SparkSession, flags: np.ndarray, key: Column) -> Column:
    """Whether a row's key may be wanted; only the key goes to Python."""
    shared = spark.sparkContext.broadcast(flags)

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(may_hold(shared.value, keys.to_numpy(np.int64)))

    return test(key)
