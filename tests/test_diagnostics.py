"""Skew reports, timelines, metric sources and log parsing."""

import json
import os
import random
import subprocess
import sys
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakewright.operators.skew import key_skew, skew_report
from lakewright.operators.timeline import stage_times, timeline
from lakewright.sources.logs import parse_driver_log
from lakewright.sources.metrics import (
    parse_stages,
    read_event_log,
    read_stages,
    stages_from_event_log,
    task_metrics,
    task_metrics_from_event_log,
)

DAY = "2025-06-30T08:"
#: Name, status, begin and end of stages in ms after eight o'clock.
PLAN = [
    ("read accounts", "COMPLETE", 0, 2500),
    ("join with a much longer stage name", "FAILED", 2400, 61_000),
    ("count", "COMPLETE", 3000, 3040),
    ("write", "ACTIVE", 60_000, 90_500),
    ("publish", "PENDING", 90_000, 120_000),
]
WIDTH = 55
GLYPHS = {"COMPLETE": "█", "ACTIVE": "▓", "PENDING": "░", "FAILED": "█"}


def clock(ms):
    return f"{DAY}{ms // 60000:02}:{ms % 60000 // 1000:02}.{ms % 1000:03}Z"


STAGES = [
    {"stageId": i, "status": status, "numTasks": 3 * i + 1, "name": name, "submissionTime": clock(a), "completionTime": clock(b)}
    for i, (name, status, a, b) in enumerate(PLAN)
]


def brute_force(values, threshold):
    values = sorted(values)
    n = len(values)
    median = values[n // 2]
    ratio = values[-1] / median if median > 0 else 0.0
    return (n, values[0], values[n // 4], median, sum(values) / n, values[3 * n // 4], values[-1], ratio,
            ratio >= threshold)


def check_report(report, groups, threshold):
    got = {r[0]: tuple(r[1:]) for r in report.collect()}
    assert set(got) == set(groups)
    for group, values in groups.items():
        want = brute_force(values, threshold)
        assert got[group] == pytest.approx(want), group


@pytest.mark.parametrize("limit", [5, 300, 10_000_000])
def test_skew_report_matches_brute_force(spark, limit):
    """One group has a third of the rows, and in it one value a third of those; one group is null."""
    rng = random.Random(3)
    groups = {"hot": [], None: [], "zero": [0.0] * 7, "one": [4.0], "below": [-3.0, -2.0, -1.0]}
    for i in range(3000):
        groups["hot"].append(5.0 if i % 3 == 0 else rng.uniform(0, 1000))
        groups.setdefault(f"g{i % 37}", []).append(float(rng.randrange(50)))
    groups[None] = [rng.gauss(100, 30) for _ in range(400)]
    rows = [(g, v) for g, values in groups.items() for v in values] + [("hot", None), ("empty", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    check_report(skew_report(df, "g", "v", 3.0, max_group_rows=limit), groups, 3.0)


@pytest.mark.parametrize("kind", ["bigint", "decimal(12,2)", "float"])
@pytest.mark.parametrize("limit", [100, 10_000_000])
def test_skew_report_of_other_number_types(spark, kind, limit):
    df = spark.range(0, 1000, 1, 8).selectExpr("id % 2 AS g", f"CAST(id * 7 % 101 AS {kind}) AS v")
    groups = {g: [float(i * 7 % 101) for i in range(1000) if i % 2 == g] for g in (0, 1)}
    report = skew_report(df, "g", "v", 1.5, max_group_rows=limit)
    assert {f.dataType.simpleString() for f in report.schema.fields[2:-1]} == {"double"}
    check_report(report, groups, 1.5)


def test_skew_report_of_two_tasks_takes_the_larger_as_median(spark):
    df = spark.createDataFrame([(6, 30.0), (6, 90.0)], "stage bigint, run_time double")
    row = skew_report(df, "stage", "run_time").first()
    assert tuple(row) == (6, 2, 30.0, 30.0, 90.0, 60.0, 90.0, 90.0, 1.0, False)


@pytest.mark.parametrize("limit", [2, 10_000_000])
def test_skew_report_of_wide_decimals_is_exact(spark, limit):
    values = ["0.123456789012345678", "0.123456789012345679", "0.000000000000000001", "0.000000000000000002"]
    df = spark.createDataFrame([(1, v) for v in values], "g int, t string").selectExpr("g", "CAST(t AS DECIMAL(38,18)) AS v")
    row = skew_report(df, "g", "v", max_group_rows=limit).first()
    assert row.mean == float(sum(map(Decimal, values))) / 4


def test_skew_report_refuses_groups_named_like_a_statistic(spark):
    with pytest.raises(ValueError, match="statistic"):
        skew_report(spark.range(3).withColumnRenamed("id", "n").withColumn("v", F.lit(1.0)), "n", "v")


def test_event_lines_are_chosen_by_the_parsed_kind(spark):
    task = '"Stage ID":1,"Task Info":{"Task ID":7},"Task Metrics":{"Executor Run Time":5}'
    lines = [
        f'{{"Event":"SparkListenerTaskEnd",{task}}}',
        f'{{"Event": "SparkListenerTaskEnd",{task}}}',
        f'{{{task},"Event":"SparkListenerTaskEnd"}}',
        f'{{"Event":"Other","note":"SparkListenerTaskEnd",{task}}}',
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [tuple(r) for r in task_metrics_from_event_log(df).collect()] == [(1, 7, 5.0)] * 3


def test_key_skew_matches_brute_force(spark):
    rng = random.Random(5)
    keys = [rng.randrange(60) for _ in range(2000)] + [99] * 1000 + [None] * 3
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(8)
    counts = [keys.count(k) for k in set(keys)]
    row = key_skew(df, "k").first()
    assert tuple(row) == pytest.approx(brute_force([float(c) for c in counts], 3.0))
    assert row.skewed


def test_key_skew_of_an_empty_table(spark):
    assert key_skew(spark.createDataFrame([], "k bigint"), "k").count() == 0


def test_timeline_of_some_stages(spark, tmp_path):
    (tmp_path / "stages.json").write_text(json.dumps(STAGES))
    rows = timeline(stage_times(read_stages(spark, str(tmp_path)))).collect()
    span = max(b for _, _, _, b in PLAN)
    assert [r.stage_id for r in rows] == list(range(len(PLAN)))
    assert {r.span_ms for r in rows} == {span}
    for row, (name, status, a, b) in zip(rows, PLAN):
        assert row.duration_ms == b - a
        assert abs(row.offset_cols - a * WIDTH / span) <= 1 and row.bar_cols >= 1
        assert abs(row.bar_cols - max(1, (b - a) * WIDTH / span)) <= 1
        assert row.bar == " " * row.offset_cols + GLYPHS[status] * row.bar_cols
        assert row.label == (name if len(name) <= 22 else name[:21] + "…")


def test_timeline_defaults(spark):
    lines = [{"stageId": 5}, {"name": "no id"}, {"stageId": 6, "submissionTime": 2000, "completionTime": 1000},
             {"stageId": 7, "submissionTime": "junk", "firstTaskLaunchedTime": "1000", "completionTime": None}]
    df = parse_stages(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string"))
    got = {r.stage_id: (r.name, r.status, r.num_tasks, r.start_ms, r.duration_ms) for r in stage_times(df).collect()}
    assert got == {
        5: ("stage", "UNKNOWN", 0, 0, 1),
        6: ("stage", "UNKNOWN", 0, 2000, 1),
        7: ("stage", "UNKNOWN", 0, 1000, 1),
    }


def test_timeline_of_nothing_is_empty(spark):
    empty = parse_stages(spark.createDataFrame([], "value string"))
    assert timeline(stage_times(empty)).count() == 0


def test_timeline_reads_no_rows_on_the_driver(spark, capsys):
    timeline(stage_times(parse_stages(spark.createDataFrame([("{}",)], "value string")))).explain()
    plan = capsys.readouterr().out
    assert "Subquery" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_task_metrics_from_stage_detail(spark):
    detail = {
        "stageId": 17,
        "tasks": {
            "40": {"taskId": 40, "taskMetrics": {"executorRunTime": 12.5}},
            "41": {"taskMetrics": {"executorRunTime": 50.0}},
            "42": {"taskId": 43},
            "44": {"taskMetrics": {"executorRunTime": 12.5}},
        },
    }
    df = spark.createDataFrame([(json.dumps(detail),), ('{"stageId": 18}',)], "value string")
    got = sorted(map(tuple, task_metrics(parse_stages(df)).collect()))
    assert got == [(17, 40, 12.5), (17, 41, 50.0), (17, 43, None), (17, 44, 12.5)]
    report = skew_report(task_metrics(parse_stages(df)), "stage_id", "run_time_ms").collect()
    assert [(r.stage_id, r.n, r.ratio) for r in report] == [(17, 3, 4.0)]


def test_event_log_lines(spark):
    lines = [
        '{"Event":"SparkListenerTaskEnd","Stage ID":4,"Task Info":{"Task ID":9,"Index":1},'
        '"Task Metrics":{"Executor Run Time":250}}',
        '{"Event":"SparkListenerTaskStart","Stage ID":4}',
        '{"Event":"SparkListenerStageCompleted","Stage Info":{"Stage ID":4,"Stage Name":"count","Number of Tasks":2,'
        '"Submission Time":1000,"Completion Time":4000}}',
        '{"Event":"SparkListenerStageCompleted","Stage Info":{"Stage ID":5,"Stage Name":"save","Number of Tasks":1,'
        '"Submission Time":4000,"Completion Time":4500,"Failure Reason":"lost"}}',
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [tuple(r) for r in task_metrics_from_event_log(df).collect()] == [(4, 9, 250.0)]
    rows = timeline(stage_times(stages_from_event_log(df))).collect()
    assert [(r.stage_id, r.status, r.num_tasks, r.start_ms, r.duration_ms) for r in rows] == [
        (4, "COMPLETE", 2, 1000, 3000),
        (5, "FAILED", 1, 4000, 500),
    ]


def test_the_event_log_of_a_finished_job(spark, tmp_path):
    """Another session runs 5 + 2 tasks with its event log on; the log is read here."""
    job = f"""
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "{tmp_path}").getOrCreate())
spark.range(0, 1000, 1, 5).rdd.map(lambda r: (r.id % 3, 1)).reduceByKey(lambda a, b: a + b, 2).collect()
spark.stop()
"""
    environment = {k: v for k, v in os.environ.items() if k != "PYSPARK_GATEWAY_PORT"}
    subprocess.run([sys.executable, "-c", job], check=True, timeout=120, env=environment, capture_output=True)
    lines = read_event_log(spark, str(tmp_path))
    tasks = task_metrics_from_event_log(lines)
    per_stage = {r.stage_id: r["count"] for r in tasks.groupBy("stage_id").count().collect()}
    assert sorted(per_stage.values()) == [2, 5]
    assert tasks.filter("run_time_ms IS NULL OR run_time_ms < 0 OR task_id IS NULL").count() == 0
    report = skew_report(tasks, "stage_id", "run_time_ms").collect()
    assert {r.stage_id: r.n for r in report} == per_stage
    bars = timeline(stage_times(stages_from_event_log(lines))).collect()
    assert [(r.status, r.num_tasks) for r in bars] == [("COMPLETE", 5), ("COMPLETE", 2)]
    assert bars[0].offset_cols == 0 and all(1 <= r.bar_cols <= 55 for r in bars)


def test_driver_log(spark):
    lines = [
        "26/01/01 12:00:00 INFO SparkContext: Running Spark version 4.1",
        "26/01/01 12:00:01 WARN DAGScheduler: lost: task 3: retry",
        "\tat org.example.Main(Main.java:5)",
        "26/13/45 99:00:00 INFO A: bad clock",
        "",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = [tuple(r) for r in parse_driver_log(df).select(F.col("ts").cast("string"), "level", "component", "message").collect()]
    assert got == [
        ("2026-01-01 12:00:00", "INFO", "SparkContext", "Running Spark version 4.1"),
        ("2026-01-01 12:00:01", "WARN", "DAGScheduler", "lost: task 3: retry"),
        (None, None, None, "\tat org.example.Main(Main.java:5)"),
        (None, "INFO", "A", "bad clock"),
        (None, None, None, ""),
    ]
