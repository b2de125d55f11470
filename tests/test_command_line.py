"""The command line on small files."""

import json

import pytest

from lakewright.__main__ import main
from lakewright.operators import aggregates


def test_histogram_is_shown(spark, tmp_path, capsys):
    spark.sql("SELECT id AS age FROM range(18, 61)").write.parquet(str(tmp_path / "users"))
    main(["histogram", str(tmp_path / "users"), "age"])
    assert "|10    |2        |" in capsys.readouterr().out
    main(["average", str(tmp_path / "users"), "age", "--over", "50"])
    assert "55.5" in capsys.readouterr().out


def test_timeline_and_skew_from_files(spark, tmp_path, capsys):
    stage = {
        "stageId": 2, "status": "COMPLETE", "numTasks": 2, "submissionTime": 0, "completionTime": 1000,
        "tasks": {str(i): {"taskId": i, "taskMetrics": {"executorRunTime": t}} for i, t in enumerate([1.0, 1.0, 9.0])},
    }
    (tmp_path / "stages.json").write_text(json.dumps([stage]))
    main(["timeline", str(tmp_path / "stages.json"), "--width", "10"])
    assert "██████████" in capsys.readouterr().out
    main(["--out", str(tmp_path / "skew"), "--fmt", "json", "skew", str(tmp_path / "stages.json")])
    assert spark.read.json(str(tmp_path / "skew")).first().skewed is True


def test_query_exports_csv(spark, tmp_path):
    main(["--out", str(tmp_path / "out"), "query", "SELECT 1 AS a, 'x' AS b"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().asDict() == {"a": "1", "b": "x"}


def test_history_shows_the_last_lines_in_file_order(spark, tmp_path, capsys):
    (tmp_path / "lines").write_text("b\na\nc\n")
    main(["history", str(tmp_path / "lines"), "--last", "2"])
    shown = capsys.readouterr().out
    assert "b" not in shown.replace("number", "") or shown.index("|a") < shown.index("|c")


def test_rows_left_out_are_announced(spark, capsys):
    main(["--limit", "3", "query", "SELECT id FROM range(5)"])
    assert "more than 3 rows" in capsys.readouterr().out
    main(["query", "SELECT id FROM range(5)"])
    assert "more than" not in capsys.readouterr().out


def test_compaction_keeps_the_layout(spark, tmp_path):
    spark.range(40).selectExpr("id", "id % 4 AS p").write.partitionBy("p").parquet(str(tmp_path / "t"))
    main(["compact", str(tmp_path / "t"), str(tmp_path / "packed")])
    assert sorted(d.name for d in (tmp_path / "packed").iterdir() if d.is_dir()) == [f"p={i}" for i in range(4)]


def test_histogram_of_large_whole_numbers(spark):
    df = spark.sql("SELECT explode(array(9007199254740993L, 9223372036854775799L, -1L)) AS v")
    got = {r.bucket for r in aggregates.bucket_histogram(df, "v", 10).collect()}
    assert got == {9007199254740990, 9223372036854775790, -10}


def test_unknown_command_is_refused():
    with pytest.raises(SystemExit):
        main(["fly"])
