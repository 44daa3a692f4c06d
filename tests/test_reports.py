"""Reports: parts, progress and footer; nothing is left of a run that fails."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillion.sources.reports import SCHEMA, Report


def _files(root, ending):
    return sorted(f for f in os.listdir(root) if f.endswith(ending))


def _json(root, name):
    return [json.loads(x) for x in (root / name).read_text().splitlines()]


def _rows(spark, n, parts):
    return spark.range(0, n, 1, parts).select(F.concat(F.lit("question "), F.col("id")).alias("line"), (F.col("id") % 4 != 0).alias("success"), F.lit(0.5).alias("seconds"))


def test_report_has_lines_in_order_progress_and_footer(spark, tmp_path):
    spark.dataSource.register(Report)
    root = tmp_path / "report"
    _rows(spark, 1000, 5).write.format("report").option("title", "Run").mode("append").save(str(root))
    lines = [line for f in _files(root, ".txt") for line in (root / f).read_text().splitlines()]
    assert lines == [f"question {i}" for i in range(1000)]
    (footer,) = _json(root, _files(root, "footer.json")[0])
    assert footer == {"title": "Run", "n_questions": 1000, "n_success": 750, "n_error": 250, "success_pct": 75.0, "total_seconds": 500.0, "mean_seconds": 0.5}
    progress = _json(root, _files(root, "progress.json")[0])
    assert [p["parts"] for p in progress] == [1, 2, 3, 4, 5] and [p["rows"] for p in progress] == [200, 400, 600, 800, 1000] and progress[-1]["success"] == 750
    assert not [f for f in os.listdir(root) if f.startswith("_")]
    _rows(spark, 10, 1).write.format("report").mode("append").save(str(root))
    assert len(_files(root, "footer.json")) == 2 and len(_files(root, ".txt")) == 6


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(Report)
    root = tmp_path / "report"
    _rows(spark, 10, 2).write.format("report").mode("append").save(str(root))
    before = sorted(os.listdir(root))
    bad = _rows(spark, 1000, 4).withColumn("line", F.when(F.col("line") == "question 900", F.raise_error(F.lit("broken"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("report").mode("append").save(str(root))
    assert sorted(os.listdir(root)) == before


def test_nulls_breaks_empty_rows_and_faults(spark, tmp_path):
    spark.dataSource.register(Report)
    odd = spark.createDataFrame([(None, None, None), ("a\nb\r\nc", True, 2.0), ("", False, None)], SCHEMA).coalesce(1)
    odd.write.format("report").mode("append").save(str(tmp_path / "odd"))
    assert (tmp_path / "odd" / _files(tmp_path / "odd", ".txt")[0]).read_text() == "\na b c\n\n"
    assert _json(tmp_path / "odd", _files(tmp_path / "odd", "footer.json")[0])[0]["n_success"] == 1
    odd.where("false").write.format("report").mode("append").save(str(tmp_path / "none"))
    assert _json(tmp_path / "none", _files(tmp_path / "none", "footer.json")[0])[0]["n_questions"] == 0
    with pytest.raises(Exception, match="appended"):
        odd.write.format("report").mode("overwrite").save(str(tmp_path / "odd"))
    with pytest.raises(Exception, match="lack"):
        odd.drop("seconds").write.format("report").mode("append").save(str(tmp_path / "odd"))
