"""Silver and gold curation jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.operators.checks import increase_check, not_empty_check, row_count_check
from lakewright.operators.files import compact_files
from lakewright.operators.merge import merge_upsert
from lakewright.sinks.tables import OPERATIONS, read_log, read_or_empty, record_commit, replace_table

GOLD_SCHEMA = "order_date date, order_count bigint, revenue double"


def silver_orders(orders: DataFrame) -> DataFrame:
    """Orders with a status, narrowed to the columns used downstream, with their date."""
    return orders.filter(F.col("status").isNotNull()).select(
        "id", "user_id", "status", "total_amount", F.to_date("created_at").alias("order_date")
    )


def daily_revenue(orders: DataFrame, status: str = "shipped") -> DataFrame:
    """Order count and revenue per day for one status; partial sums come before the shuffle."""
    return (
        orders.filter(F.col("status") == status)
        .groupBy(F.to_date("created_at").alias("order_date"))
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.coalesce(F.sum("total_amount").cast("double"), F.lit(0.0)).alias("revenue"),
        )
    )


def merge_daily_revenue(gold: DataFrame, new_daily: DataFrame) -> DataFrame:
    """Gold table after upserting `new_daily`, which has one row per day."""
    return merge_upsert(gold, new_daily, ["order_date"], ["order_count", "revenue"], unique_source=True)


def run_silver(spark: SparkSession, orders_path: str, silver_path: str, log_path: str, as_of: dt.datetime) -> DataFrame:
    """Write the silver table to a new path and return its checks."""
    raw = spark.read.parquet(orders_path)
    operation = replace_table(silver_orders(raw), silver_path, ["order_date"])
    record_commit(spark, log_path, "orders_silver", operation, as_of)
    return row_count_check(raw, spark.read.parquet(silver_path))


def run_gold(
    spark: SparkSession,
    orders_path: str,
    gold_path: str,
    new_gold_path: str,
    log_path: str,
    as_of: dt.datetime,
    compact_to: str | None = None,
) -> DataFrame:
    """Merge daily revenue into the gold table, write it to a new path, return the checks.

    A `gold_path` without a table counts as an empty table.
    """
    gold = read_or_empty(spark, gold_path, GOLD_SCHEMA)
    merged = merge_daily_revenue(gold, daily_revenue(spark.read.parquet(orders_path)))
    replace_table(merged, new_gold_path, ["order_date"])
    commit = record_commit(spark, log_path, "daily_revenue", OPERATIONS["merge"], as_of)
    if compact_to:
        compact_files(spark, new_gold_path, compact_to, partition_by=["order_date"])
    written = spark.read.parquet(compact_to or new_gold_path)
    commits = read_log(spark, log_path).filter(F.col("table_name") == "daily_revenue")
    earlier = commits.join(commit, "snapshot_id", "left_anti")
    more = increase_check(earlier, commits, "snapshots_increased")
    return not_empty_check(written).unionByName(more)
