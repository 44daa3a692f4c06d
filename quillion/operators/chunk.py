"""Recursive splitting of texts at separators, with overlap and start positions.

The pieces depend on one another within a text only, so the splitter is a function of one row, run in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.functions import text as X

#: Fixed value: separators in the order they are tried; there is none for single line breaks or spaces, so chunks may be longer than asked.
SEPARATORS = ("\n\n", "\n+-", "\n- ", "\n* ", "\n# ", "\n## ", "\n### ")
CHUNKS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start_index", T.IntegerType())]))


def _pieces(text: str, separator: str) -> list[str]:
    """Parts of the text, each but the first with the separator before it; empty ones drop out."""
    first, *rest = text.split(separator)
    return [p for p in [first, *(separator + r for r in rest)] if p]


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Runs of pieces of up to ``size`` characters, each starting with up to ``overlap`` of the run before."""
    done: list[str] = []
    run: list[str] = []
    total = 0
    for piece in pieces:
        if run and total + len(piece) > size:
            done.append("".join(run).strip())
            while run and (total > overlap or total + len(piece) > size):
                total -= len(run.pop(0))
        run.append(piece)
        total += len(piece)
    if run:
        done.append("".join(run).strip())
    return [d for d in done if d]


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    rest = separators[at + 1 :]
    out: list[str] = []
    short: list[str] = []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            short.append(piece)
            continue
        out += _merge(short, size, overlap)
        short = []
        out += split_text(piece, size, overlap, rest) if rest else [piece]
    return out + _merge(short, size, overlap)


def chunks(text: str | None, size: int | None, overlap: int | None) -> list[dict]:
    """Chunks with where they start; the whole text where size is 0."""
    if not text:
        return []
    if not size:
        return [{"text": text, "start_index": 0}]
    found, at, last = [], 0, 0
    for part in split_text(text, size, overlap or 0):
        at = text.find(part, max(0, at + last - (overlap or 0)))
        found.append({"text": part, "start_index": at})
        at, last = max(at, 0), len(part)
    return found


@F.pandas_udf(CHUNKS)
def _chunks(text: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([chunks(t, None if pd.isna(s) else int(s), None if pd.isna(o) else int(o)) for t, s, o in zip(text, size, overlap, strict=True)])


def chunked(docs: DataFrame, id_cols: list[str], text_col: str = "content", size: str = "chunk_size", overlap: str = "chunk_overlap", base_id: str | None = None) -> DataFrame:
    """(ids, chunk_index, start_index, chunk, child_id): chunks of every text; sizes are columns, 600/80 where null."""
    s, o = F.coalesce(F.col(size), F.lit(600)), F.coalesce(F.col(overlap), F.lit(80))
    extra = [base_id] if base_id and base_id not in id_cols else []
    each = docs.select(*id_cols, *extra, F.posexplode(_chunks(text_col, s, o)).alias("chunk_index", "c"))
    key = F.col(base_id) if base_id else F.concat_ws("|", *(F.col(c).cast("string") for c in id_cols))
    return each.select(*id_cols, "chunk_index", F.col("c.start_index").alias("start_index"), F.col("c.text").alias("chunk"), X.stable_id(key, F.col("c.start_index"), F.col("chunk_index")).alias("chunk_id"))
