"""Copying source tables into the lakehouse, in full or from a high-water mark on."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions.literals import typed_literal
from lakewright.operators.merge import merge_upsert
from lakewright.sinks.tables import OPERATIONS, append, merge_partitions, publish, read_or_empty, record_commit, replace_table
from lakewright.sources.relational import jdbc_from_dsn, read_source


@dataclass(frozen=True)
class SyncJob:
    """One table to copy: where from, which query, where to, and how."""

    name: str
    fmt: str
    options: Mapping[str, str]
    target: str
    query: str | None = None
    mode: str = "full"
    partition_by: Sequence[str] = field(default_factory=tuple)
    watermark_column: str | None = None
    batch_size: int | None = None
    partition_column: str | None = None
    num_partitions: int | None = None
    predicates: Sequence[str] = field(default_factory=tuple)
    keys: Sequence[str] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if self.mode not in ("full", "incremental"):
            raise ValueError(f"unknown sync mode {self.mode!r}")
        if self.mode == "incremental" and not self.watermark_column:
            raise ValueError("an incremental sync needs a watermark column")


def incremental_extract(source: DataFrame, target: DataFrame, watermark_col: str, inclusive: bool = False) -> DataFrame:
    """Source rows above the target's highest `watermark_col`, with `inclusive` also those at it.

    A target without any mark takes every row, null marks too. The mark becomes a
    literal, so the comparison reaches the source, be it a Parquet scan or a database.
    Later, rows with a null mark are not taken.
    """
    mark = high_water_mark(target, watermark_col)
    if mark is None:
        return source
    bound = typed_literal(mark, source.schema[watermark_col].dataType)
    column = F.col(watermark_col)
    return source.filter(column >= bound if inclusive else column > bound)


def high_water_mark(target: DataFrame, watermark_col: str) -> object:
    """The target's highest mark as a value, for sources that filter on literals only (JDBC)."""
    return target.agg(F.max(watermark_col)).first()[0]


def jobs_from_spec(spec: Mapping, warehouse: str) -> list[SyncJob]:
    """Jobs from a spec with `sources` (type, dsn) and `sync_jobs`, targets below `warehouse`.

    A job names its source, namespace, table, sql, mode, and optionally
    watermark_column, batch_size, partition_column, num_partitions, predicates (one read
    each) and keys. A job with neither partition_column nor predicates reads its whole
    query over one connection in one task.
    """
    sources = {name: jdbc_from_dsn(s["type"], s["dsn"]) for name, s in spec["sources"].items()}
    return [
        SyncJob(
            name=job["name"],
            fmt="jdbc",
            options=sources[job["source"]],
            target=f"{warehouse.rstrip('/')}/{job['namespace']}/{job['table']}",
            query=job["sql"].strip(),
            mode=job.get("mode") or "full",
            watermark_column=job.get("watermark_column"),
            batch_size=job.get("batch_size"),
            partition_column=job.get("partition_column"),
            num_partitions=job.get("num_partitions"),
            predicates=tuple(job.get("predicates") or ()),
            keys=tuple(job.get("keys") or ()),
        )
        for job in spec["sync_jobs"]
    ]


def read_job(spark: SparkSession, job: SyncJob) -> DataFrame:
    return read_source(
        spark, job.fmt, job.options, job.query, job.batch_size, job.partition_column, job.num_partitions, job.predicates
    )


def sync_one(spark: SparkSession, job: SyncJob, log_path: str, as_of: dt.datetime) -> None:
    """Run one job and record its commit.

    A full copy is written beside the target and takes its place when it is complete. An
    incremental one with keys upserts: rows at the highest mark are read again, so late
    rows with an equal mark are not lost, and updated rows replace their old version. Without keys
    it appends, for sources that never change a row and whose marks only grow.
    """
    rows = read_job(spark, job)
    staged = f"{job.target}.new-{uuid.uuid4().hex}"
    if job.mode == "full":
        replace_table(rows, staged, job.partition_by)
        publish(spark, staged, job.target)
        operation = OPERATIONS["insert_overwrite"]
    elif job.keys:
        existing = read_or_empty(spark, job.target, rows.schema)
        fresh = incremental_extract(rows, existing, job.watermark_column, inclusive=True)
        if job.partition_by and set(job.partition_by) <= set(job.keys) and not existing.isEmpty():
            merge_partitions(spark, job.target, fresh, job.keys, job.partition_by)
            record_commit(spark, log_path, job.name, OPERATIONS["merge"], as_of)
            return
        replace_table(merge_upsert(existing, fresh, job.keys), staged, job.partition_by)
        publish(spark, staged, job.target)
        operation = OPERATIONS["merge"]
    else:
        existing = read_or_empty(spark, job.target, rows.schema)
        operation = append(incremental_extract(rows, existing, job.watermark_column), job.target, job.partition_by)
    record_commit(spark, log_path, job.name, operation, as_of)


def sync_full(spark: SparkSession, jobs: Iterable[SyncJob], log_path: str, as_of: dt.datetime) -> None:
    """Run the configured jobs one after the other; each is one distributed copy."""
    for job in jobs:
        sync_one(spark, job, log_path, as_of)


def incremental_upsert(
    source: DataFrame, target: DataFrame, keys: Sequence[str], watermark_col: str, new_path: str
) -> str:
    """Upsert the rows from the high-water mark on and write the new state to `new_path`."""
    fresh = incremental_extract(source, target, watermark_col, inclusive=True)
    merged = merge_upsert(target, fresh, keys)
    replace_table(merged, new_path)
    return OPERATIONS["merge"]
