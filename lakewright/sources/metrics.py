"""Stage and task metrics from REST payloads and Spark event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGE_SCHEMA = """
    stageId bigint, name string, status string, numTasks int,
    submissionTime string, firstTaskLaunchedTime string, completionTime string,
    tasks map<string, struct<
        taskId: bigint, index: bigint, status: string,
        taskMetrics: struct<executorRunTime: double>>>
"""

TASK_END_SCHEMA = """
    `Event` string,
    `Stage ID` bigint,
    `Task Info` struct<`Task ID`: bigint, `Index`: bigint, `Executor ID`: string>,
    `Task Metrics` struct<`Executor Run Time`: double>
"""

STAGE_END_SCHEMA = """
    `Event` string,
    `Stage Info` struct<
        `Stage ID`: bigint, `Stage Name`: string, `Number of Tasks`: int,
        `Submission Time`: string, `Completion Time`: string, `Failure Reason`: string>
"""


def read_stages(spark: SparkSession, path: str) -> DataFrame:
    """Stage rows from REST JSON files holding one stage or a list of stages."""
    return spark.read.schema(STAGE_SCHEMA).option("multiLine", True).json(path)


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the event logs below `path`, compressed or not, in a text column `value`."""
    return spark.read.option("recursiveFileLookup", True).text(path)


def parse_stages(lines: DataFrame, column: str = "value") -> DataFrame:
    """Stage rows from a text column with one JSON stage per row."""
    return lines.select(F.from_json(column, STAGE_SCHEMA).alias("_s")).select("_s.*")


def task_metrics(stages: DataFrame) -> DataFrame:
    """(stage_id, task_id, run_time_ms), one row per task; stages without tasks give none."""
    return stages.select(F.col("stageId").alias("stage_id"), F.explode("tasks").alias("_key", "_task")).select(
        "stage_id",
        F.coalesce("_task.taskId", F.col("_key").try_cast("bigint")).alias("task_id"),
        F.col("_task.taskMetrics.executorRunTime").alias("run_time_ms"),
    )


def _events(lines: DataFrame, column: str, event: str, schema: str) -> DataFrame:
    """Parsed events of one kind. Lines without its name are dropped before JSON parsing;
    of the others the parsed `Event` decides, whatever the spacing and order of fields."""
    named = lines.filter(F.contains(F.col(column), F.lit(event)))
    return named.select(F.from_json(column, schema).alias("_e")).filter(F.col("_e.Event") == event)


def task_metrics_from_event_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(stage_id, task_id, run_time_ms) from the task-end lines of an event log."""
    return _events(lines, column, "SparkListenerTaskEnd", TASK_END_SCHEMA).select(
        F.col("_e.`Stage ID`").alias("stage_id"),
        F.col("_e.`Task Info`.`Task ID`").alias("task_id"),
        F.col("_e.`Task Metrics`.`Executor Run Time`").alias("run_time_ms"),
    )


def stages_from_event_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Stage rows, in the columns stage_times expects, from the stage-end lines of an event log."""
    info = F.col("_e.`Stage Info`")
    return _events(lines, column, "SparkListenerStageCompleted", STAGE_END_SCHEMA).select(
        info["Stage ID"].alias("stageId"),
        info["Stage Name"].alias("name"),
        F.when(info["Failure Reason"].isNull(), "COMPLETE").otherwise("FAILED").alias("status"),
        info["Number of Tasks"].alias("numTasks"),
        info["Submission Time"].alias("submissionTime"),
        F.lit(None).cast("string").alias("firstTaskLaunchedTime"),
        info["Completion Time"].alias("completionTime"),
    )
