"""Reports as a data sink of Spark's with a commit: tasks write parts, the commit adds counts and a footer.

``spark.dataSource.register(Report)``, then ``df.write.format("report").mode("append").save(folder)`` with rows of (line
string, success boolean, seconds double). Each task writes its lines to a file of its own under ``_pending-<run>``; its
message tells the file and its counts. The commit moves the files of the tasks that count into place, in the order of
partitions, writes ``progress.json`` (a line a part: parts done, rows, successes so far) and ``footer.json`` (totals), and
removes what is pending; files of tasks that failed or ran twice are never moved. An abort removes everything of the run.
A report is whole if it has its footer. Folders may lie on any file system that pyarrow knows.

Parts are named by the run, so reports that are appended stand beside one another, each with its footer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SCHEMA = "line string, success boolean, seconds double"


@dataclass
class Part(WriterCommitMessage):
    partition: int
    file: str
    rows: int
    success: int
    seconds: float


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, title: str):
        self.folder, self.title, self.run = folder, title, uuid.uuid4().hex[:12]

    def _places(self) -> tuple[pafs.FileSystem, str, str]:
        store, root = _opened(self.folder)
        return store, root, f"{root}/_pending-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        """The lines of one partition, written as batches come."""
        task = TaskContext.get()
        store, _, pending = self._places()
        store.create_dir(pending, recursive=True)
        name = f"{pending}/{task.partitionId():06d}-{task.taskAttemptId()}"
        rows = success = 0
        seconds = 0.0
        with store.open_output_stream(name) as out:
            for batch in iterator:
                lines = pc.replace_substring_regex(pc.fill_null(batch.column("line").cast(pa.string()), ""), r"\r\n|\r|\n", " ")
                out.write("".join(f"{line}\n" for line in lines.to_pylist()).encode())
                rows += batch.num_rows
                success += pc.sum(pc.fill_null(batch.column("success"), False)).as_py() or 0
                seconds += pc.sum(batch.column("seconds")).as_py() or 0.0
        return Part(task.partitionId(), name, rows, int(success), seconds)

    def commit(self, messages: list[Part | None]) -> None:
        store, root, pending = self._places()
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        store.create_dir(root, recursive=True)
        progress, rows, success, seconds = [], 0, 0, 0.0
        for done, part in enumerate(parts, 1):
            store.move(part.file, f"{root}/report-{self.run}-{part.partition:06d}.txt")
            rows, success, seconds = rows + part.rows, success + part.success, seconds + part.seconds
            progress.append({"parts": done, "of": len(parts), "rows": rows, "success": success})
        self._put(store, f"{root}/report-{self.run}.progress.json", progress)
        footer = {"title": self.title, "n_questions": rows, "n_success": success, "n_error": rows - success, "success_pct": round(100 * success / rows, 6) if rows else None, "total_seconds": round(seconds, 6), "mean_seconds": round(seconds / rows, 6) if rows else None}
        self._put(store, f"{root}/report-{self.run}.footer.json", [footer])
        self._drop(store, pending)

    def abort(self, messages: list[Part | None]) -> None:
        store, root, pending = self._places()
        self._drop(store, pending)
        if store.get_file_info(root).type == pafs.FileType.Directory:
            for found in store.get_file_info(pafs.FileSelector(root)):
                if found.base_name.startswith(f"report-{self.run}"):
                    store.delete_file(found.path)

    @staticmethod
    def _put(store: pafs.FileSystem, path: str, rows: list[dict]) -> None:
        with store.open_output_stream(path) as out:
            out.write("".join(json.dumps(r) + "\n" for r in rows).encode())

    @staticmethod
    def _drop(store: pafs.FileSystem, folder: str) -> None:
        if store.get_file_info(folder).type == pafs.FileType.Directory:
            store.delete_dir(folder)


class Report(DataSource):
    """Options: ``path`` (the folder), ``title``. Reports are appended only; an old one is removed by whoever owns the folder."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("reports are appended")
        lacking = {"line", "success", "seconds"} - set(schema.names)
        if lacking:
            raise ValueError(f"rows lack {sorted(lacking)}")
        return _Writer(self.options["path"].rstrip("/"), self.options.get("title", "REPORT"))
