"""Tables whose live files a change log names, so that a write costs what it changes.

A write puts its files into a folder of its own and then logs which files were added and which
no longer count; the log row is what makes them visible. Nothing is changed in place, so
readers keep their version, a failed write leaves only files that a vacuum will find, and
any earlier version can be read until then. One writer at a time.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakewright.functions.literals import typed_literal
from lakewright.operators.files import RETAIN_HOURS, TARGET_BYTES, file_inventory, file_rows, hidden_files, pack_files
from lakewright.operators.merge import delete_where, merge_upsert
from lakewright.session import scratch_path
from lakewright.sinks.tables import OPERATIONS, evenly, read_or_empty

CHANGES_SCHEMA = (
    "commit_no bigint, committed_at timestamp, operation string, change string, "
    "path string, bytes bigint, row_count bigint"
)
COMMIT = "_commit"


@dataclass(frozen=True)
class FileTable:
    """A table at `path`: files below data/, the change log below changes/."""

    path: str
    schema: StructType
    partition_by: Sequence[str] = ()

    @property
    def data(self) -> str:
        return f"{self.path}/data"


@dataclass(frozen=True)
class Written:
    """What a write did: files that count no longer, files that it added, live files before it."""

    commit_no: int
    removed: int
    added: int
    before: int


def read_changes(spark: SparkSession, table: FileTable) -> DataFrame:
    return read_or_empty(spark, f"{table.path}/changes", CHANGES_SCHEMA)


def live_files(changes: DataFrame, commit_no: int | None = None) -> DataFrame:
    """path, bytes, row_count of the files that count after a commit, by default the last:
    those whose last change up to there was to be added."""
    if commit_no is not None:
        changes = changes.filter(F.col("commit_no") <= commit_no)
    state = F.max_by(F.struct("change", "bytes", "row_count"), "commit_no").alias("last")
    return changes.groupBy("path").agg(state).filter("last.change = 'added'").select("path", "last.bytes", "last.row_count")


def versions(changes: DataFrame) -> DataFrame:
    """commit_no, committed_at, operation, live_files, live_rows, live_bytes after each commit, as
    running sums of what the commits added and removed."""
    sign = F.when(F.col("change") == "added", 1).when(F.col("change") == "removed", -1).otherwise(0)
    totals = {"live_files": sign, "live_rows": sign * F.col("row_count"), "live_bytes": sign * F.col("bytes")}
    commits = changes.groupBy("commit_no", "committed_at", "operation").agg(
        *[F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(name) for name, value in totals.items()]
    )
    held = commits.select("commit_no", *totals)
    earlier = held.select(F.col("commit_no").alias("_at"), *[F.col(c).alias(f"_{c}") for c in totals])
    # One row for each commit: few beside the files.
    joined = commits.drop(*totals).join(earlier, F.col("_at") <= F.col("commit_no"))
    return joined.groupBy("commit_no", "committed_at", "operation").agg(*[F.sum(f"_{c}").alias(c) for c in totals])


def _paths(files: DataFrame) -> list[str]:
    """Names of files on the driver, where Spark's file index holds those of every table it reads."""
    return [unquote(r.path) for r in files.select("path").collect()]


def read_files(spark: SparkSession, table: FileTable, files: DataFrame) -> DataFrame:
    """The rows of some of a table's files."""
    paths = _paths(files)
    if not paths:
        return spark.createDataFrame([], table.schema)
    rows = spark.read.schema(table.schema).option("basePath", table.data).parquet(*paths)
    return rows.select(*table.schema.names)


def read_table(spark: SparkSession, table: FileTable, commit_no: int | None = None) -> DataFrame:
    """The table after its last commit, or as it was after an earlier one."""
    return read_files(spark, table, live_files(read_changes(spark, table), commit_no))


def _record(
    spark: SparkSession, table: FileTable, operation: str, as_of: dt.datetime, live: DataFrame,
    added: DataFrame | None, removed: DataFrame | None,
) -> Written:
    """Add a commit to the log. The files it adds are there already; this makes them count.

    A commit that changes no file still has its row in the log.
    """
    commit_no = (read_changes(spark, table).agg(F.max("commit_no")).first()[0] or 0) + 1
    sides = [(added, "added"), (removed, "removed")]
    rows = [side.select(F.lit(label).alias("change"), "path", "bytes", "row_count") for side, label in sides if side is not None]
    rows.append(spark.createDataFrame([(None,) * 4], "change string, path string, bytes bigint, row_count bigint"))
    change = rows[0]
    for more in rows[1:]:
        change = change.unionByName(more)
    stamped = change.select(
        F.lit(commit_no).cast("long").alias("commit_no"), F.lit(as_of).cast("timestamp").alias("committed_at"),
        F.lit(operation).alias("operation"), "*",
    )
    before = live.count()
    stamped.coalesce(1).write.mode("append").parquet(f"{table.path}/changes")
    done = read_changes(spark, table).filter(F.col("commit_no") == commit_no)
    counts = done.agg(F.count_if(F.col("change") == "removed"), F.count_if(F.col("change") == "added")).first()
    return Written(commit_no, *counts, before)


def _write(rows: DataFrame, table: FileTable, commit: str) -> None:
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields]
    evenly(rows.select(*cols), table.partition_by).write.partitionBy(*table.partition_by).parquet(f"{table.data}/{commit}")


def _new_commit() -> str:
    return f"{COMMIT}={uuid.uuid4().hex}"


def _added(spark: SparkSession, table: FileTable, commit: str) -> DataFrame:
    """Files of a commit that hold rows."""
    return file_rows(spark, f"{table.data}/{commit}", base=table.data, schema=table.schema)


def append_files(spark: SparkSession, table: FileTable, rows: DataFrame, as_of: dt.datetime) -> Written:
    """Add rows; no file is read."""
    commit = _new_commit()
    _write(rows, table, commit)
    live = live_files(read_changes(spark, table))
    return _record(spark, table, OPERATIONS["append"], as_of, live, _added(spark, table, commit), None)


def overwrite_files(spark: SparkSession, table: FileTable, rows: DataFrame, as_of: dt.datetime) -> Written:
    """Replace all rows; there is no moment without a table."""
    commit = _new_commit()
    _write(rows, table, commit)
    live = live_files(read_changes(spark, table))
    return _record(spark, table, OPERATIONS["insert_overwrite"], as_of, live, _added(spark, table, commit), live)


def _own_name(schema: StructType, name: str) -> str:
    while name.lower() in {c.lower() for c in schema.names}:
        name += "_"
    return name


def upsert_files(
    spark: SparkSession, table: FileTable, source: DataFrame, keys: Sequence[str], as_of: dt.datetime,
    set_cols: Sequence[str] | None = None,
) -> Written:
    """Upsert `source` and rewrite only the files that hold one of its keys.

    The files are found by a semi-join of the key columns; the range of the source's keys
    goes to the scan as literals, so files and row groups beyond it are skipped unread. All
    other files keep counting as they are, whatever their number. Rules are those of `merge_upsert`.
    """
    keys = list(keys)
    fixed = {f.name: f.dataType for f in table.schema.fields}
    source = source.select(*[F.col(c).cast(fixed[c]).alias(c) for c in table.schema.names])
    kept = scratch_path(spark, "upsert")
    source.write.parquet(kept)
    source = spark.read.schema(table.schema).parquet(kept)
    wanted = source.select(*keys).dropna()
    ends = wanted.agg(*[f(c).alias(f"{name}_{c}") for c in keys for name, f in (("low", F.min), ("high", F.max))]).first()
    live = live_files(read_changes(spark, table))
    name = _own_name(table.schema, "_file")
    held = read_with_file(spark, table, live, name)
    for c in keys:
        if ends[f"low_{c}"] is not None:
            held = held.filter(F.col(c).between(typed_literal(ends[f"low_{c}"], fixed[c]), typed_literal(ends[f"high_{c}"], fixed[c])))
    touched = held.select(*keys, name).join(wanted, keys, "left_semi").select(F.col(name).alias("path")).distinct()
    touched = _pinned(live.join(touched, "path", "left_semi"))
    commit = _new_commit()
    _write(merge_upsert(read_files(spark, table, touched), source, keys, set_cols), table, commit)
    return _record(spark, table, OPERATIONS["merge"], as_of, live, _added(spark, table, commit), touched)


def read_with_file(spark: SparkSession, table: FileTable, files: DataFrame, name: str) -> DataFrame:
    """The rows of some files with the file each lies in."""
    paths = _paths(files)
    if not paths:
        return spark.createDataFrame([], table.schema).withColumn(name, F.lit(None).cast("string"))
    rows = spark.read.schema(table.schema).option("basePath", table.data).parquet(*paths)
    return rows.select(*table.schema.names, F.col("_metadata.file_path").alias(name))


def _pinned(files: DataFrame) -> DataFrame:
    """A list of files written once, since the log that it comes from is about to grow."""
    kept = scratch_path(files.sparkSession, "files")
    files.write.parquet(kept)
    return files.sparkSession.read.schema(files.schema).parquet(kept)


def delete_files(spark: SparkSession, table: FileTable, predicate: Column, as_of: dt.datetime) -> Written:
    """Delete the rows for which `predicate` is true; only files with such rows are rewritten,
    and those with no other rows just stop counting."""
    live = live_files(read_changes(spark, table))
    name = _own_name(table.schema, "_file")
    hit = read_with_file(spark, table, live, name).filter(F.coalesce(predicate, F.lit(False)))
    hit = hit.groupBy(F.col(name).alias("path")).agg(F.count(F.lit(1)).alias("_hit"))
    touched = _pinned(live.join(hit, "path"))
    partly = touched.filter("_hit < row_count")
    added = None
    if not partly.isEmpty():
        commit = _new_commit()
        _write(delete_where(read_files(spark, table, partly), predicate), table, commit)
        added = _added(spark, table, commit)
    return _record(spark, table, OPERATIONS["delete"], as_of, live, added, touched)


def _partition_of(path: Column, partition_by: Sequence[str]) -> Column:
    """The part of a file's path that names its partition."""
    pattern = "".join(f"/({c}=[^/]*)" for c in partition_by)
    return F.concat_ws("/", *[F.regexp_extract(path, pattern, i + 1) for i in range(len(partition_by))]) if partition_by else F.lit("")


def compact_small(
    spark: SparkSession, table: FileTable, as_of: dt.datetime, target_bytes: int = TARGET_BYTES, small_share: float = 0.75
) -> Written:
    """Put small files of one partition together into files of about `target_bytes`.

    Which files go together comes from the log alone: the files below `small_share` of the target are
    packed, largest first, each into the first bin of its partition with room. A bin of one file
    gains nothing and stays, as do the files that are large enough: neither is read. Each bin is written
    by one task as one file.
    """
    live = live_files(read_changes(spark, table))
    small = live.filter(F.col("bytes") < small_share * target_bytes)
    bins = pack_files(small.withColumn("partition", _partition_of(F.col("path"), table.partition_by)), target_bytes)
    bins = _pinned(bins.filter("files > 1"))
    chosen = live.join(bins.select("path"), "path", "left_semi")
    count = bins.select("partition", "bin").distinct().count()
    if count == 0:
        return _record(spark, table, OPERATIONS["compaction"], as_of, live, None, None)
    name = _own_name(table.schema, "_file")
    group = f"{uuid.uuid4().hex}-"
    place = F.concat(F.lit(group), F.xxhash64("partition", "bin").cast("string"))
    rows = read_with_file(spark, table, chosen, name).join(bins.select(F.col("path").alias(name), place.alias(COMMIT)), name)
    rows = rows.drop(name).repartition(count, COMMIT)
    rows.write.mode("append").partitionBy(COMMIT, *table.partition_by).parquet(table.data)
    added = file_rows(spark, f"{table.data}/{COMMIT}={group}*", base=table.data, schema=table.schema)
    return _record(spark, table, OPERATIONS["compaction"], as_of, live, added, chosen)


def vacuum_files(
    spark: SparkSession, table: FileTable, as_of: dt.datetime, retain_hours: int = RETAIN_HOURS
) -> DataFrame:
    """path, bytes, modified, reason of the files below the table that nothing needs any more.

    The log itself tells what is needed: files that count now, and files that stopped counting less than
    `retain_hours` ago, which versions of that time still read. Of the others those unchanged for as long
    are listed: `removed` ones, `unknown` ones that no commit names, and `temporary` ones under hidden
    names, which failed writes leave. Deletes nothing.
    """
    changes = read_changes(spark, table)
    limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(retain_hours))
    last = changes.filter("path IS NOT NULL").groupBy("path").agg(F.max_by(F.struct("change", "committed_at"), "commit_no").alias("last"))
    named = last.select(
        F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("_path"),
        ((F.col("last.change") == "added") | (F.col("last.committed_at") > limit)).alias("_needed"),
    )
    found = file_inventory(spark, table.data).select("path", "bytes", "modified", F.lit(False).alias("_hidden"))
    found = found.unionByName(hidden_files(spark, table.data).select("path", "bytes", "modified", F.lit(True).alias("_hidden")))
    plain = F.regexp_replace(F.col("path"), "^file:/+", "file:/")
    named = named.withColumn("_path", F.regexp_replace("_path", "^file:/+", "file:/"))
    known = found.filter(F.col("modified") < limit).join(named, plain == F.col("_path"), "left")
    reason = F.when(F.col("_hidden"), "temporary").when(F.col("_needed").isNull(), "unknown").otherwise("removed")
    return known.filter(~F.coalesce("_needed", F.lit(False))).select("path", "bytes", "modified", reason.alias("reason"))
