"""Chunks and sections as table functions of SQL.

``register(spark)`` makes known:

- ``text_chunks(content, size, overlap)``, for lateral joins: a row a chunk. Spark takes no Arrow function on the right of
  a lateral join, so this one gets its rows one by one.
- ``chunked_table(TABLE(...))``, the same over a whole table of (id string, content, chunk_size, chunk_overlap) in Arrow
  batches, wherever its partitions lie; nothing is shuffled.
- ``marked_sections(TABLE(...) PARTITION BY id ORDER BY line_no)``, sections of documents whose lines are rows of (id
  string, line_no, line): lines of one document come in order, over as many batches as they need, and are held until its
  end, as titles of neighbours and the number of sections are part of each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillion.operators import chunk

#: Sizes where none is given, as in ``chunk.chunked``.
SIZE, OVERLAP = 600, 80
#: Sections leave a task in batches of this many.
BATCH = 4096


def _cut(content: str | None, size: int | None, overlap: int | None) -> list[dict]:
    return chunk.chunks(content, SIZE if size is None else size, OVERLAP if overlap is None else overlap)


@F.udtf(returnType="chunk_index int, start_index int, chunk string", useArrow=False)
class TextChunks:
    def eval(self, content: str, size: int, overlap: int) -> Iterator[tuple]:
        for i, c in enumerate(_cut(content, size, overlap)):
            yield i, c["start_index"], c["text"]


@F.arrow_udtf(returnType="id string, chunk_index int, start_index int, chunk string")
class ChunkedTable:
    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        made: list[tuple] = []
        columns = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("id", "content", "chunk_size", "chunk_overlap"))
        for key, content, size, overlap in zip(*columns, strict=True):
            made += [(key, i, c["start_index"], c["text"]) for i, c in enumerate(_cut(content, size, overlap))]
        yield _table(made, (("id", pa.string()), ("chunk_index", pa.int32()), ("start_index", pa.int32()), ("chunk", pa.string())))


SECTION = (
    ("id", pa.string()), ("section_num", pa.int32()), ("total_sections", pa.int32()), ("section_title", pa.string()),
    ("prev_section_title", pa.string()), ("next_section_title", pa.string()), ("content", pa.string()),
)


@F.arrow_udtf(returnType="id string, section_num int, total_sections int, section_title string, prev_section_title string, next_section_title string, content string")
class MarkedSections:
    def __init__(self):
        self.key: str | None = None
        self.titles: list[str] = []
        self.bodies: list[list[str]] = []

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        at = rows.schema.get_field_index
        if rows.num_rows:
            self.key = rows.column(at("id"))[0].as_py()
        for line in rows.column(at("line")).to_pylist():
            if line is None:
                continue
            before, mark, title = line.partition("+-")
            if self.bodies:
                self.bodies[-1].append(before if title else line)
            if mark and title:
                self.titles.append(title.strip())
                self.bodies.append([])
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        n = len(self.titles)
        for start in range(0, n, BATCH):
            made = []
            for i in range(start, min(n, start + BATCH)):
                body = "\n".join(self.bodies[i]).strip()
                previous, following = self.titles[i - 1] if i else "", self.titles[i + 1] if i + 1 < n else ""
                made.append((self.key, i + 1, n, self.titles[i], previous, following, f"{self.titles[i]}\n\n{body}"))
            yield _table(made, SECTION)


def _table(rows: list[tuple], fields: tuple) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ([] for _ in fields)
    return pa.table({name: pa.array(column, kind) for (name, kind), column in zip(fields, columns, strict=True)})


def register(spark: SparkSession) -> None:
    for name, function in (("text_chunks", TextChunks), ("chunked_table", ChunkedTable), ("marked_sections", MarkedSections)):
        spark.udtf.register(name, function)
