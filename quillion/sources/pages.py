"""Folders of HTML pages as a data source of Spark's, in batches and as a stream.

``spark.dataSource.register(HtmlFolder)`` makes ``spark.read.format("html_folder").load(folder)`` and ``readStream`` known.
Rows are (path, filename, bytes, modified, html, error): a file that can't be read, or isn't UTF-8, is a row with an error
and no html, so that one bad page ends no job. Files are dealt to partitions by their sizes, a partition holding up to
``partitionBytes``. Folders may lie on any file system that pyarrow knows (``file:``, ``hdfs:``, ``s3:``, ...).

Streams keep a log of the files they have seen in the folder that the option ``log`` names (in shared storage, one for each
query): a small JSON file for each batch, whose number is the offset. A restarted query reads its log and gives the same
batches again, and files that arrive late with an old time are not missed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, filename string, bytes long, modified timestamp, html string, error string"
ARROW = pa.schema([("path", pa.string()), ("filename", pa.string()), ("bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("html", pa.string()), ("error", pa.string())])
ENDINGS = (".html", ".htm")
PARTITION_BYTES = 64 << 20
#: Rows of this many bytes together leave a task as one Arrow batch.
BATCH_BYTES = 8 << 20


@dataclass(frozen=True, order=True)
class Page:
    path: str
    size: int
    modified: int  # microseconds


@dataclass
class Pages(InputPartition):
    files: list[Page]


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def listed(folder: str) -> list[Page]:
    """All pages below a folder, by path; a folder that doesn't exist is an error."""
    store, root = _opened(folder)
    found = store.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted(Page(f.path, f.size, f.mtime_ns // 1000) for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(ENDINGS))


def dealt(files: list[Page], most: int) -> list[Pages]:
    """Files in order in partitions of up to ``most`` bytes; a larger file is a partition of its own."""
    parts: list[Pages] = []
    total = most + 1
    for f in files:
        if total + f.size > most:
            parts.append(Pages([]))
            total = 0
        parts[-1].files.append(f)
        total += f.size
    return parts


def _row(store: pafs.FileSystem, page: Page) -> tuple:
    html = error = None
    try:
        with store.open_input_stream(page.path) as stream:
            html = stream.read().decode("utf-8")
    except (OSError, UnicodeDecodeError) as e:
        error = f"{type(e).__name__}: {e}"
    return page.path, page.path.rsplit("/", 1)[-1], page.size, page.modified, html, error


def _batches(folder: str, part: Pages) -> Iterator[pa.RecordBatch]:
    store, _ = _opened(folder)
    rows: list[tuple] = []
    held = 0
    for page in part.files:
        rows.append(_row(store, page))
        held += page.size
        if held >= BATCH_BYTES:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class _Reader(DataSourceReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def partitions(self) -> list[Pages]:
        return dealt(listed(self.folder), self.most) or [Pages([])]  # Spark wants one at least

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return _batches(self.folder, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, folder: str, most: int, log: str, files: int):
        self.folder, self.most, self.log, self.files = folder, most, log, files
        self.seen: set[Page] = set()
        self.number = 0

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        """The last batch's number, after the files that no batch holds are logged as new ones."""
        while (known := self._logged(self.number + 1)) is not None:
            self.seen.update(known)
            self.number += 1
        fresh = [f for f in listed(self.folder) if f not in self.seen]
        for at in range(0, len(fresh), self.files):
            some = fresh[at : at + self.files]
            self._write(self.number + 1, some)
            self.seen.update(some)
            self.number += 1
        return {"batch": self.number}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        every: list[Page] = []
        for number in range(start["batch"] + 1, end["batch"] + 1):
            known = self._logged(number)
            if known is None:
                raise FileNotFoundError(f"{self.log} lacks batch {number}")
            every += known
        return dealt(every, self.most) or [Pages([])]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        return _batches(self.folder, partition)

    def commit(self, end: dict) -> None:
        """Nothing: the log is what a restart needs."""

    def stop(self) -> None:
        """Nothing is held open."""

    def _logged(self, number: int) -> list[Page] | None:
        store, root = _opened(self.log)
        path = f"{root}/{number:012d}.json"
        if store.get_file_info(path).type != pafs.FileType.File:
            return None
        with store.open_input_stream(path) as stream:
            return [Page(*entry) for entry in json.loads(stream.read())]

    def _write(self, number: int, files: list[Page]) -> None:
        """A batch's list, written beside and moved into its place, so that no reader sees half of one."""
        store, root = _opened(self.log)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{number:012d}.part") as stream:
            stream.write(json.dumps([[f.path, f.size, f.modified] for f in files]).encode())
        store.move(f"{root}/{number:012d}.part", f"{root}/{number:012d}.json")


class HtmlFolder(DataSource):
    """Options: ``path`` (the folder), ``partitionBytes``; for streams ``log`` (needed) and ``filesPerBatch``."""

    @classmethod
    def name(cls) -> str:
        return "html_folder"

    def schema(self) -> str:
        return SCHEMA

    def _most(self) -> int:
        return int(self.options.get("partitionBytes", PARTITION_BYTES))

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self._most())

    def streamReader(self, schema) -> _StreamReader:
        if "log" not in self.options:
            raise ValueError("name a folder in shared storage by the option log")
        return _StreamReader(self.options["path"], self._most(), self.options["log"].rstrip("/"), int(self.options.get("filesPerBatch", 10_000)))
