"""Questions to a commit log (table_name, snapshot_id, committed_at, operation)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how many snapshots a listing shows.
RECENT = 20


def recent_snapshots(log: DataFrame, n: int = RECENT) -> DataFrame:
    """The newest `n` commits, newest first."""
    newest = log.orderBy(F.col("committed_at").desc(), F.col("snapshot_id").desc())
    return newest.limit(n).select("snapshot_id", "committed_at", "operation")


def latest_operation(log: DataFrame, table: Sequence[str] = ("table_name",)) -> DataFrame:
    """Operation of the newest commit per table."""
    newest = F.max_by("operation", F.struct("committed_at", "snapshot_id"))
    return log.groupBy(*table).agg(newest.alias("operation"))


def snapshot_counts(log: DataFrame, table: Sequence[str] = ("table_name",)) -> DataFrame:
    """Number of commits per table."""
    return log.groupBy(*table).agg(F.count(F.lit(1)).alias("snapshots"))


def operation_history(log: DataFrame, table: Sequence[str] = ("table_name",)) -> DataFrame:
    """All commits per table, oldest first; rows rather than one list per table."""
    return log.select(*table, "committed_at", "snapshot_id", "operation").orderBy(
        *table, "committed_at", "snapshot_id"
    )
