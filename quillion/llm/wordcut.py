"""Texts cut into words by white space, whole Arrow columns at once, and tables of counts that tasks can look up.

Words of few occurrences fill most of a corpus's vocabulary, so a table of all words is never broadcast. Its head is: the
rows whose count is at least a ``bound``-th of the sum of all counts, of which there can be ``bound`` at most, however
large the corpus is. What a task doesn't find in the head it passes on, to be joined with the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are cut at once; a longer text is cut by itself.
SLICE_BYTES = 8_000_000


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of about ``limit`` bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        start = stop


def plain(column: pa.Array) -> pa.Array:
    """The column as one array of strings with A-Z in lower case; null is as empty."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.ascii_lower(pc.fill_null(whole.cast(pa.string()), ""))


def cut(texts: pa.Array, spaces: bytes, breaks: bytes = b"") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts, the number of each word's text, and the number of its piece (over all texts).

    Words are runs of bytes other than ``spaces`` and ``breaks``; breaks also end a piece, as texts do.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.empty(0, np.uint8)
    starts = offsets - offsets[0]
    kind = np.zeros(256, np.int8)
    kind[list(spaces)], kind[list(breaks)] = 1, 2
    kinds = kind[data]
    inside = kinds == 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    inner = starts[1:-1][starts[1:-1] < len(data)]
    opens[inner] = inside[inner]  # a text's first byte never goes on with the word before it
    first = np.flatnonzero(opens)
    before = np.cumsum(inside, dtype=np.int32)[first] - 1  # bytes of words before each word
    ends = np.append(before, np.count_nonzero(inside)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    text = np.searchsorted(starts[1:], first, "right")
    broken = np.cumsum(kinds == 2, dtype=np.int32)[first] if breaks else 0
    return words, text, broken + text


def numbered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, and the number of each word among them."""
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def head(counts: DataFrame, count: str, bound: int) -> DataFrame:
    """The rows of counts that hold at least a ``bound``-th of the sum of ``count``: ``bound`` rows at most."""
    total = counts.agg(F.coalesce(F.sum(count), F.lit(0)).cast("long")).first()[0]
    return counts.where(F.col(count) >= F.lit(max(1, -(-total // bound))))


def placed(keys: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of each key in ``among``, or -1."""
    return pc.fill_null(pc.index_in(keys, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)
