"""File inventory, compaction, vacuum candidates and partition inventory."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakewright.functions.formats import format_mtime, human_size, type_symbol

# Target file size of a compaction and default retention of a vacuum.
TARGET_BYTES = 134217728
RETAIN_HOURS = 168

# Partition values a task writes side by side before it sorts what is left by them.
OPEN_WRITERS = 4
WRITERS_SETTING = "spark.sql.maxConcurrentOutputFileWriters"

# Files of one partition that one task packs.
PACK_FILES = 5_000

# Fixed names: where a write keeps its files until they are complete, at a table's top and in folders of it.
HIDDEN = (
    "_temporary/*/_temporary/*", "_temporary/*/task*", ".spark-staging-*",
    "*/_temporary/*/_temporary/*", "*/_temporary/*/task*", "*/.spark-staging-*",
)

# How many times larger rows are in a shuffle than in a Parquet file, for tables of numbers and short texts.
SHUFFLE_PER_FILE = 4.0


def list_status(status: DataFrame, include_hidden: bool = False, long: bool = False) -> DataFrame:
    """Listing rows from file-status rows (pathSuffix, type, length, owner, ...).

    Names starting with a dot are left out unless `include_hidden`.
    """
    if not include_hidden:
        status = status.filter(~F.startswith(F.col("pathSuffix"), F.lit(".")))
    perms = F.col("permission")
    if long:
        perms = F.concat(perms, F.lit(" r="), F.col("replication").cast("string"))
    return status.select(
        type_symbol(F.col("type")).alias("type"),
        F.col("pathSuffix").alias("name"),
        F.when(F.col("type") == "DIRECTORY", "-").otherwise(human_size(F.col("length"))).alias("size"),
        format_mtime(F.col("modificationTime")).alias("modified"),
        "owner",
        perms.alias("perms"),
    )


def inventory_of(status: DataFrame) -> DataFrame:
    """The same columns as `file_inventory` from rows of a file-status table (path, type,
    length, modificationTime in ms), such as a storage system's own inventory.

    It holds every name, hidden ones too, and is read like any table, however long.
    """
    files = status.filter(F.col("type") != "DIRECTORY")
    return files.select(
        "path",
        F.col("length").alias("bytes"),
        human_size(F.col("length")).alias("size"),
        F.timestamp_millis("modificationTime").alias("modified"),
    )


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files below `path`: path, size, human size and modification time.

    Only metadata columns are selected, so no file content is read. Spark's file index
    leaves out names that begin with `.` or `_`; `inventory_of` has them.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(
        "path",
        F.col("length").alias("bytes"),
        human_size(F.col("length")).alias("size"),
        F.col("modificationTime").alias("modified"),
    )


def hidden_files(spark: SparkSession, path: str, patterns: Sequence[str] = HIDDEN) -> DataFrame:
    """path, bytes, modified of files below `path` under names that a scan leaves out.

    Spark lists what a pattern names itself, so the folders that writers use for files in the
    making are named by patterns; each is listed like any folder, on the executors when large.
    """
    found = None
    for pattern in patterns:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        try:
            files = files.load(f"{path}/{pattern}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        files = files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
        found = files if found is None else found.unionByName(files)
    if found is None:
        return spark.createDataFrame([], "path string, bytes bigint, modified timestamp")
    return found.distinct()


def pack_files(files: DataFrame, target_bytes: int = TARGET_BYTES, chunk: int = PACK_FILES) -> DataFrame:
    """`files` (partition, path, bytes) with `bin` and `files`, the number of files in that bin.

    First-fit decreasing within a partition: files go by falling size, each into the first bin
    with room for it. Equal sizes go by path. A partition with many files is dealt to
    lots of about `chunk` files by hash, packed apart, so no partition is left to one task; at
    most one bin a lot stays half empty for it. Null sizes count as 0, a null partition is one of its own.
    """
    rows = files.select(F.coalesce("partition", F.lit("")).alias("partition"), "path", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    counts = rows.groupBy("partition").agg(F.count(F.lit(1)).alias("_files"))
    lots = F.greatest(F.lit(1), F.ceil(F.col("_files") / F.lit(chunk)))
    dealt = rows.join(counts, "partition").withColumn("_lot", F.pmod(F.xxhash64("path"), lots).cast("long"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bytes", "path"], ascending=[False, True])
        room: list[int] = []
        bins = []
        for size in group["bytes"].tolist():
            place = next((n for n, left in enumerate(room) if left >= size), len(room))
            if place == len(room):
                room.append(target_bytes)
            room[place] -= size
            bins.append(place)
        lot = int(group["_lot"].iloc[0])
        return pd.DataFrame({"partition": group["partition"], "path": group["path"], "bytes": group["bytes"], "bin": [f"{lot}-{b}" for b in bins]})

    packed = dealt.select("partition", "_lot", "path", "bytes").groupBy("partition", "_lot")
    packed = packed.applyInPandas(pack, "partition string, path string, bytes long, bin string")
    return packed.withColumn("files", F.count(F.lit(1)).over(Window.partitionBy("partition", "bin")))


def file_rows(spark: SparkSession, *paths: str, base: str | None = None, schema: StructType | None = None) -> DataFrame:
    """Rows and bytes per Parquet file, from footers and file metadata only.

    `base` is the folder of a table of which `paths` are some folders; with a `schema` they may be empty.
    """
    reader = spark.read if base is None else spark.read.option("basePath", base)
    reader = reader if schema is None else reader.schema(schema)
    return (
        reader.parquet(*paths)
        .groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def partition_inventory(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Row count per partition value."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("row_count"))


def partition_files(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """Files, rows and bytes per partition of the Parquet table at `path`."""
    files = (
        spark.read.parquet(path)
        .groupBy(*cols, "_metadata.file_path", "_metadata.file_size")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    return files.groupBy(*cols).agg(
        F.count(F.lit(1)).alias("files"), F.sum("_rows").alias("row_count"), F.sum("file_size").alias("bytes")
    )


def vacuum_candidates(
    files: DataFrame, live: DataFrame, as_of: Column, retain_hours: int = RETAIN_HOURS
) -> DataFrame:
    """Files (path, modified, ...) no live path refers to, unchanged for `retain_hours`. Deletes nothing."""
    old = files.filter(F.col("modified") < as_of - F.make_dt_interval(F.lit(0), F.lit(retain_hours)))
    return old.join(live.select("path").distinct(), "path", "left_anti")


def private_session(spark: SparkSession, settings: dict[str, object]) -> SparkSession:
    """A session with the caller's SQL settings and some of its own, which stay out of the caller's."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in settings.items():
        own.conf.set(key, str(value))
    return own


@contextmanager
def open_writers(spark: SparkSession) -> Iterator[None]:
    """Partitioned writes inside keep a file open for each of OPEN_WRITERS values, unless the session
    allows another number, and so do not sort a task's rows in memory."""
    if spark.conf.get(WRITERS_SETTING, "0") != "0":
        yield
        return
    spark.conf.set(WRITERS_SETTING, str(OPEN_WRITERS))
    try:
        yield
    finally:
        spark.conf.unset(WRITERS_SETTING)


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """The partition columns that the directory layout of the table at `path` shows."""
    columns = spark.read.parquet(path).columns
    inside = spark.read.option("recursiveFileLookup", "true").parquet(path).columns
    return [c for c in columns if c not in inside]


def compact_files(
    spark: SparkSession,
    src: str,
    dst: str,
    target_bytes: int = TARGET_BYTES,
    partition_by: Sequence[str] | None = None,
    shuffle_per_file: float = SHUFFLE_PER_FILE,
) -> DataFrame:
    """Rewrite the Parquet table at `src` into files of about `target_bytes` at the new path `dst`.

    The layout is kept: `partition_by` defaults to the partition columns of `src`. Without
    any the scan itself packs small files into splits of the target size and each split is
    written as it is: no shuffle. With partitions rows are rebalanced by them: adaptive
    execution brings small ones together and splits large ones, so no partition is left to
    one task and the number of tasks follows the bytes; `shuffle_per_file` sets their size.
    A file ends at the number of rows that fill the target, as footers and sizes of the
    old files tell. Rows are written as they come, with a file open for each of some values, so a
    task does not hold them sorted. Returns the rewritten table.
    """
    cols = partition_columns(spark, src) if partition_by is None else list(partition_by)
    if not cols:
        packing = private_session(
            spark,
            {
                "spark.sql.files.maxPartitionBytes": target_bytes,
                "spark.sql.files.openCostInBytes": 0,
                "spark.sql.files.minPartitionNum": 1,
            },
        )
        packing.read.parquet(src).write.mode("errorifexists").parquet(dst)
        return spark.read.parquet(dst)
    size = max(1, int(target_bytes * shuffle_per_file))
    balancing = private_session(
        spark,
        {
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
            "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
            "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        },
    )
    held = file_rows(spark, src).agg(F.sum("bytes").alias("bytes"), F.sum("row_count").alias("row_count")).first()
    per_file = max(1, round((held.row_count or 0) * target_bytes / (held.bytes or 1)))
    rows = balancing.read.parquet(src).hint("rebalance", *cols)
    with open_writers(balancing):
        rows.write.mode("errorifexists").option("maxRecordsPerFile", per_file).partitionBy(*cols).parquet(dst)
    return spark.read.parquet(dst)
