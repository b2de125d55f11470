"""Stage timelines scaled to a fixed number of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.functions.formats import parse_spark_time, short_name, status_glyph

DEFAULT_WIDTH = 55


def stage_times(stages: DataFrame) -> DataFrame:
    """Start and duration per stage from REST stage rows.

    Expects stageId, name, status, numTasks, submissionTime, firstTaskLaunchedTime
    and completionTime, times as strings or numbers. A missing start is 0, a
    missing end is one millisecond after the start; rows without id are dropped.
    """
    start = F.coalesce(
        parse_spark_time(F.col("submissionTime")),
        parse_spark_time(F.col("firstTaskLaunchedTime")),
        F.lit(0).cast("long"),
    )
    timed = stages.filter(F.col("stageId").isNotNull()).select(
        F.col("stageId").cast("long").alias("stage_id"),
        F.coalesce("name", F.lit("stage")).alias("name"),
        F.coalesce("status", F.lit("UNKNOWN")).alias("status"),
        F.coalesce("numTasks", F.lit(0)).cast("int").alias("num_tasks"),
        start.alias("start_ms"),
        parse_spark_time(F.col("completionTime")).alias("_end_ms"),
    )
    end = F.coalesce("_end_ms", F.col("start_ms") + 1)
    return timed.withColumn("duration_ms", F.greatest(end - F.col("start_ms"), F.lit(1))).drop("_end_ms")


def timeline(stages: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """`stages` (as from stage_times) with bar position and length, sorted by start.

    The overall first start and last end come from one aggregate used as a scalar
    subquery, so rows are neither joined nor collected.
    """
    duration = F.greatest(F.col("duration_ms"), F.lit(1))
    ends = stages.agg(
        F.struct(
            F.min("start_ms").alias("first"),
            F.max(F.col("start_ms") + duration).alias("last"),
        )
    ).scalar()
    span = F.greatest(ends["last"] - ends["first"], F.lit(1))
    bars = F.lit(width)
    offset = F.round((F.col("start_ms") - ends["first"]).cast("double") / F.col("span_ms").cast("double") * bars)
    length = F.round(F.col("duration_ms").cast("double") / F.col("span_ms").cast("double") * bars)
    room = F.greatest(bars - F.col("offset_cols"), F.lit(0))
    return (
        stages.withColumn("span_ms", span)
        .withColumn("offset_cols", offset.cast("int"))
        .withColumn("bar_cols", F.least(F.greatest(length.cast("int"), F.lit(1)), room))
        .withColumn("label", short_name(F.col("name")))
        .withColumn(
            "bar",
            F.concat(
                F.repeat(F.lit(" "), F.col("offset_cols")),
                F.repeat(status_glyph(F.col("status")), F.col("bar_cols")),
            ),
        )
        .orderBy("start_ms", "stage_id")
    )
