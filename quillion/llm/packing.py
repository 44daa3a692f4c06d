"""Packing: vector bin packing of token pieces into training sequences.

A sequence has three limits at once: tokens, segments (pieces in it) and loss-bearing tokens (the end id bears none).
Pieces as large as a limit
allows make sequences of their own; the rest is packed window by window. A bin is filled by the dot-product heuristic:
of the pieces that fit, the one whose vector of relative demands has the largest dot product with the bin's remaining
capacities goes in, so that a bin short of one resource gets pieces that need the others. Where no piece fits and more
than ``cut_from`` tokens are free, the heuristic's best piece is cut to fill them. The last sequence of a partition is
split at powers of two, which need no padding.

Each partition packs its own rows: no shuffle, and a lost task packs the same rows the same way again. Memory holds one
window of pieces.

Defined results: null and empty texts are examples of the end id alone, or none without an end id; repeated rows are
packed like any others, told apart by ``row``; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.llm import tokens
from quillion.llm.words import give_back


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024
    cut_from: int = 16
    window: int = 2048


#: A piece: row, start within its example, length, whether its tokens bear loss, and how many at its end don't (the end id).
Piece = tuple[int, int, int, bool, int]

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("loss", T.BooleanType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def pack_window(pieces: list[Piece], limits: Limits, last: bool) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences made of the pieces, and the pieces that stay for the next window: those of the bin that ended up open.

    With ``last`` none stay.
    """
    row, start, length, free_end = (np.array([p[i] for p in pieces], np.int64) for i in (0, 1, 2, 4))
    loss = np.array([p[3] for p in pieces], bool)
    free = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    demand = np.stack([length, np.ones(len(pieces)), (length - free_end) * loss], axis=1) / free
    left = np.ones(len(pieces), bool)
    done: list[list[Piece]] = []
    remaining = len(pieces)
    while remaining:
        room, bin_ = np.ones(3), []
        while remaining:
            value = np.where(left & (demand <= room + 1e-9).all(axis=1), demand @ room, -1.0)
            best = int(value.argmax())
            if value[best] >= 0:
                bin_.append((int(row[best]), int(start[best]), int(length[best]), bool(loss[best]), int(free_end[best])))
                room -= demand[best]
                left[best] = False
                remaining -= 1
                continue
            spare = round(room[0] * limits.tokens)
            if spare < limits.cut_from or room[1] * limits.segments < 1 - 1e-9:
                break
            # nothing fits whole: cut the piece that the heuristic likes best
            value = np.where(left, demand @ room, -1.0)
            best = int(value.argmax())
            part = min(spare, round(room[2] * limits.loss_tokens)) if loss[best] else spare
            if part < limits.cut_from:
                break
            bin_.append((int(row[best]), int(start[best]), part, bool(loss[best]), 0))
            start[best] += part
            length[best] -= part
            demand[best] = np.array([length[best], 1, (length[best] - free_end[best]) * loss[best]]) / free
            room -= np.array([part, 1, part * loss[best]]) / free
        if not remaining and not last and room[0] * limits.tokens >= limits.cut_from:
            return done, bin_
        done.append(bin_)
    return done, []


def at_powers(bin_: list[Piece]) -> list[list[Piece]]:
    """The bin split into sequences whose lengths are powers of two, the largest first."""
    out, queue = [], list(reversed(bin_))
    total = sum(p[2] for p in bin_)
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        now: list[Piece] = []
        while size:
            r, s, n, loss, end = queue.pop()
            take = min(n, size)
            now.append((r, s, take, loss, end if take == n else 0))
            if take < n:
                queue.append((r, s + take, n - take, loss, end))
            size -= take
        out.append(now)
    return out


def _whole(n: int, loss: bool, limits: Limits) -> int:
    """Tokens of an example's pieces that fill a sequence alone."""
    return min(limits.tokens, limits.loss_tokens) if loss else limits.tokens


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = None, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", loss: Column | None = None) -> DataFrame:
    """One row a piece: where it comes from, its sequence, its place there, and its ids (little-endian unsigned 32-bit).

    ``loss`` says which rows' tokens bear loss (all, by default): for instruction data, those of the assistant.
    """

    def run(batches):
        encode = tokens.encoder(tokenizer)
        end = 0 if end_id is None else 1
        base = TaskContext.get().partitionId() << 36
        examples: dict[int, tuple] = {}  # row -> doc_id, ids
        waiting: list[Piece] = []
        full_bins: list[list[Piece]] = []
        rows = sequences = 0

        def emit(bins: list[list[Piece]]):
            nonlocal sequences
            out = {name: [] for name in PIECES.names}
            for bin_ in bins:
                offset = 0
                for r, s, n, bears, _ in bin_:
                    doc_id, ids = examples[r]
                    for name, v in zip(PIECES.names, (doc_id, base + r, s, n, len(ids) // 4, bears, base + sequences, offset, ids[4 * s : 4 * (s + n)]), strict=True):
                        out[name].append(v)
                    offset += n
                sequences += 1
            return pa.RecordBatch.from_pydict(out, schema=arrow)

        def flush(last: bool):
            nonlocal waiting, full_bins
            bins, waiting = pack_window(waiting, limits, last) if last or len(waiting) >= limits.window else ([], waiting)
            if last and bins and sum(p[2] for p in bins[-1]) < limits.tokens:
                bins = bins[:-1] + at_powers(bins[-1])
            made, full_bins = emit(full_bins + bins), []
            keep = {p[0] for p in waiting}
            for r in [r for r in examples if r not in keep]:
                del examples[r]
            return made

        for batch in batches:
            for a, b, flat, counts in encode.chunks(batch.column(1), end_id):
                data, stops = flat.astype("<u4", copy=False).tobytes(), np.cumsum(counts).tolist()
                for doc_id, n, stop, bears in zip(batch.column(0)[a:b].to_pylist(), counts.tolist(), stops, batch.column(2)[a:b].to_pylist(), strict=True):
                    r = rows
                    rows += 1
                    if not n:
                        continue
                    examples[r] = (doc_id, data[4 * (stop - n) : 4 * stop])
                    size = _whole(n, bears, limits)
                    full = n // size if size else 0
                    full_bins += [[(r, i * size, size, bears, end if (i + 1) * size == n else 0)] for i in range(full)]
                    if n > full * size:
                        waiting.append((r, full * size, n - full * size, bears, end))
                    if len(waiting) >= limits.window or len(full_bins) >= limits.window:
                        yield flush(False)
        yield flush(True)
        examples.clear()
        give_back(tokens.STEP)

    arrow = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("loss", pa.bool_()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
    bears = F.lit(True) if loss is None else F.coalesce(loss, F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), bears.alias("loss")).mapInArrow(run, PIECES)
