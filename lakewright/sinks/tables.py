"""Write modes for Parquet tables, each recorded in a commit log.

A write never goes to a path its own plan reads, except `merge_partitions`,
whose partition overwrite is staged by Spark and published when all tasks are done.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakewright.functions.literals import typed_literal
from lakewright.operators.files import compact_files
from lakewright.operators.merge import delete_where, merge_upsert
from lakewright.operators.ordering import join_null_safe

LOG_SCHEMA = "table_name string, snapshot_id bigint, committed_at timestamp, operation string"

# The operation a commit log shows for each way of writing.
OPERATIONS = {
    "append": "append",
    "insert_overwrite": "overwrite",
    "merge": "overwrite",
    "delete": "delete",
    "compaction": "replace",
}


def record_commit(
    spark: SparkSession, log_path: str, table: str, operation: str, as_of: dt.datetime
) -> DataFrame:
    """Append one commit to the log and return it as a one-row DataFrame."""
    snapshot_id = uuid.uuid4().int >> 65
    row = spark.createDataFrame([(table, snapshot_id, as_of, operation)], LOG_SCHEMA)
    row.coalesce(1).write.mode("append").parquet(log_path)
    return row


def read_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table at `path`, or an empty one of that schema if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    return read_or_empty(spark, log_path, LOG_SCHEMA)


def evenly(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of one partition value brought together, large values split by AQE.

    Without this every task would write a file into every partition directory.
    """
    return df.hint("rebalance", *partition_by) if partition_by else df


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Add rows to the table; returns the operation label."""
    evenly(df, partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)
    return OPERATIONS["append"]


def overwrite(df: DataFrame, path: str, partition_by: Sequence[str] = (), dynamic: bool = False) -> str:
    """Replace the table, or with `dynamic` only the partitions `df` has rows for."""
    if dynamic and not partition_by:
        raise ValueError("dynamic overwrite needs partition columns")
    writer = evenly(df, partition_by).write.mode("overwrite").partitionBy(*partition_by)
    writer.option("partitionOverwriteMode", "dynamic" if dynamic else "static").parquet(path)
    return OPERATIONS["insert_overwrite"]


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Create the table at `path`, which must be new; the old version stays readable."""
    evenly(df, partition_by).write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return OPERATIONS["insert_overwrite"]


def create_if_absent(spark: SparkSession, name: str, schema: str, path: str, partition_by: Sequence[str] = ()) -> None:
    """Declare an external Parquet table unless it exists."""
    parts = f"PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet {parts} LOCATION '{path}'")


def merge_partitions(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    keys: Sequence[str],
    partition_by: Sequence[str],
    set_cols: Sequence[str] | None = None,
) -> str:
    """Upsert into a partitioned table, reading and rewriting only partitions the source touches.

    Possible when the partition columns are part of the key: a row can then only
    match inside its own partition, and all other partitions stay as they are. The
    range of the touched values prunes directories when planning, and a semi-join on the
    values themselves, which Spark turns into pruning at run time, leaves those between.
    Only the ends of the ranges come to the driver, for any number of values.
    """
    if not set(partition_by) <= set(keys):
        raise ValueError("partition columns must be part of the key")
    target = spark.read.parquet(path)
    touched = source.select(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in partition_by])
    ends = touched.agg(*[f(c).alias(f"{name}_{c}") for c in partition_by for name, f in (("low", F.min), ("high", F.max))]).first()
    whole, missing = F.lit(True), F.lit(False)
    for c in partition_by:
        low, high = (typed_literal(ends[f"{name}_{c}"], target.schema[c].dataType) for name in ("low", "high"))
        whole = whole & F.col(c).between(low, high)
        missing = missing | F.col(c).isNull()
    values = touched.distinct()
    # Null partition values are pruned by their own test; they meet only nulls.
    inside = target.filter(whole).join(values.filter(whole), list(partition_by), "left_semi").select(*target.columns)
    nulls = join_null_safe(target.filter(missing), values.filter(missing), list(partition_by), "left_semi")
    merged = merge_upsert(inside.unionByName(nulls.select(*target.columns)), source, keys, set_cols)
    overwrite(merged, path, partition_by, dynamic=True)
    return OPERATIONS["merge"]


def merge_table(
    spark: SparkSession, path: str, new_path: str, source: DataFrame, keys: Sequence[str], partition_by: Sequence[str],
    log_path: str, table: str, as_of: dt.datetime,
) -> None:
    """Upsert `source` into the table at `path`, write the new version and record the commit."""
    replace_table(merge_upsert(spark.read.parquet(path), source, keys), new_path, partition_by)
    record_commit(spark, log_path, table, OPERATIONS["merge"], as_of)


def delete_from(
    spark: SparkSession, path: str, new_path: str, predicate: Column, partition_by: Sequence[str],
    log_path: str, table: str, as_of: dt.datetime,
) -> None:
    """Write the table at `path` without the rows for which `predicate` is true to
    `new_path` and record the commit; the old version stays readable."""
    replace_table(delete_where(spark.read.parquet(path), predicate), new_path, partition_by)
    record_commit(spark, log_path, table, OPERATIONS["delete"], as_of)


def compact_table(
    spark: SparkSession, path: str, new_path: str, target_bytes: int, partition_by: Sequence[str],
    log_path: str, table: str, as_of: dt.datetime,
) -> DataFrame:
    """Compact the table at `path` into `new_path`, record the commit and return the table."""
    compacted = compact_files(spark, path, new_path, target_bytes, partition_by)
    record_commit(spark, log_path, table, OPERATIONS["compaction"], as_of)
    return compacted


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Put the finished table at `staged` in the place of the one at `path` by renaming.

    Until the new table is complete nothing happens to the old one, so a write that
    fails half-way leaves it as it was.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    new, place, old = (hadoop.Path(p) for p in (staged, path, f"{path}.old-{uuid.uuid4().hex}"))
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = files.exists(place)
    if there and not files.rename(place, old):
        raise OSError(f"cannot move {path} aside")
    if not files.rename(new, place):
        if there:
            files.rename(old, place)
        raise OSError(f"cannot move {staged} to {path}")
    if there:
        files.delete(old, True)
