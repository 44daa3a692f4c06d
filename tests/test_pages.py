"""HTML folders as a data source: batches, streams, bad files."""

import os

import pytest

from quillion.sources import files, html
from quillion.sources.pages import HtmlFolder, Page, dealt


@pytest.fixture()
def folder(spark, tmp_path):
    spark.dataSource.register(HtmlFolder)
    root = tmp_path / "pages"
    (root / "below").mkdir(parents=True)
    for i in range(7):
        (root / ("below" if i % 2 else ".") / f"p{i}.html").write_text(f"<title>T{i}</title><p>{'é' * i * 10}</p>")
    (root / "bad.htm").write_bytes(b"\xff\xfe<p>")
    (root / "empty.HTML").write_bytes(b"")
    (root / "note.txt").write_text("no page")
    return root


def _rows(df):
    return sorted((r["filename"], r["bytes"], r["html"], r["error"] is None) for r in df.collect())


def test_batch_gives_files_and_errors_as_rows(spark, folder):
    read = spark.read.format("html_folder").option("partitionBytes", 60).load(str(folder))
    rows = _rows(read)
    assert len(rows) == 9 and [r[0] for r in rows if not r[3]] == ["bad.htm"]
    assert dict((r[0], r[2]) for r in rows)["empty.HTML"] == "" and read.rdd.getNumPartitions() > 3
    plain = {(r["filename"], r["html"]) for r in files.html_files(spark, str(folder)).collect()}
    assert plain <= {(r[0], r[2]) for r in rows}
    assert html.parsed(read.where("error is null")).where("page.title like 'T%'").count() == 7


def test_partitions_by_size():
    pages = [Page(f"p{i}", size, 0) for i, size in enumerate((5, 5, 5, 50, 1, 0))]
    assert [[f.size for f in p.files] for p in dealt(pages, 10)] == [[5, 5], [5], [50], [1, 0]] and dealt([], 10) == []


def test_stream_gives_what_a_batch_gives_over_restarts(spark, folder, tmp_path):
    source = spark.readStream.format("html_folder").option("log", str(tmp_path / "log")).option("filesPerBatch", 4).load(str(folder))

    def run():
        source.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "point")).trigger(availableNow=True).start().awaitTermination(120)
        return _rows(spark.read.parquet(str(tmp_path / "out")))

    def batch():  # anew, as a DataFrame lists its folder once
        return _rows(spark.read.format("html_folder").load(str(folder)))

    assert run() == batch() and len(os.listdir(tmp_path / "log")) == 3
    late = folder / "late.html"
    late.write_text("<p>late</p>")
    os.utime(late, (1, 1))  # older than all others
    assert run() == batch() and run() == batch() and len(batch()) == 10


def test_faults_are_errors(spark, folder, tmp_path):
    with pytest.raises(Exception, match="log"):
        spark.readStream.format("html_folder").load(str(folder)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("html_folder").load(str(tmp_path / "nowhere")).count()
    (tmp_path / "none").mkdir()
    assert spark.read.format("html_folder").load(str(tmp_path / "none")).count() == 0
