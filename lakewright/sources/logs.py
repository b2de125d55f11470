"""Driver log lines."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewright.session import ensure_checkpoint_dir

# Fixed format: yy/MM/dd HH:mm:ss LEVEL Component: message
LINE = r"^\d\d/\d\d/\d\d \d\d:\d\d:\d\d [A-Z]+ [^:]+: "


def parse_driver_log(lines: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """(ts, level, component, message) per line, behind the columns to `keep`.

    A line in another form, such as part of a stack trace, keeps its text as the
    message and has null elsewhere. One pattern test per line; the parts are cut
    out by position.
    """
    line = F.col(column)
    rest = F.substring(line, F.lit(19), F.length(line))
    level = F.substring_index(rest, " ", 1)
    tail = F.substring(rest, F.length(level) + 2, F.length(rest))
    component = F.substring_index(tail, ": ", 1)
    message = F.substring(tail, F.length(component) + 3, F.length(tail))
    fits = line.rlike(LINE)
    moment = F.concat(F.lit("20"), F.replace(F.substring(line, 1, 17), F.lit("/"), F.lit("-")))
    return lines.select(
        *keep,
        F.when(fits, moment).try_cast("timestamp_ntz").alias("ts"),
        F.when(fits, level).alias("level"),
        F.when(fits, component).alias("component"),
        F.when(fits, message).otherwise(line).alias("message"),
    )


def log_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, ts, level, component, message, line_count) per record of driver logs.

    A record is a line in the fixed form and the lines behind it that are not, such as a stack
    trace, joined to its message by line feeds. Files are read in blocks by many tasks: within a
    block each line takes the last header before it, and lines in front of a block's first header take the
    last header of the blocks before, one row for each block. Lines in front of a file's first header
    are records of their own with null parts. Names of a file's records do not reach beyond it.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    ensure_checkpoint_dir(spark)
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("value").rlike(LINE), F.struct("block", "at"))
    owned = lines.withColumn("own", F.max(head).over(inside))
    # Lines of one block are together already, so their records need no second shuffle.
    texts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    pieces = owned.groupBy("file", "block", "own").agg(texts.alias("lines")).checkpoint()
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pieces.groupBy("file", "block").agg(F.max("own").alias("last"))
    carried = blocks.select("file", "block", F.max("last").over(before).alias("carried"))
    fronts = pieces.filter("own IS NULL").join(F.broadcast(carried), ["file", "block"])
    alone = fronts.filter("carried IS NULL").select("file", F.explode("lines").alias("line")).select("file", F.array("line").alias("lines"))
    more = fronts.filter("carried IS NOT NULL").select("file", F.col("carried").alias("record"), "lines")
    heads = pieces.filter("own IS NOT NULL").select("file", F.col("own").alias("record"), "lines")
    # One row a block at most: the records that run into it from a block before.
    split = F.broadcast(more.select("file", "record").distinct())
    parts = heads.join(split, ["file", "record"], "left_semi").unionByName(more)
    joined = parts.groupBy("file", "record").agg(F.array_sort(F.flatten(F.collect_list("lines"))).alias("lines"))
    whole = heads.join(split, ["file", "record"], "left_anti")
    records = whole.select("file", "lines").unionByName(joined.select("file", "lines")).unionByName(alone)
    values = F.transform("lines", lambda line: line["value"])
    parsed = parse_driver_log(records.select("file", "lines", values.alias("values"), F.col("lines")[0]["value"].alias("value")), keep=["file", "values"])
    rest = F.slice("values", 2, F.size("values"))
    return parsed.select(
        "file", "ts", "level", "component",
        F.array_join(F.concat(F.array("message"), rest), "\n").alias("message"),
        F.size("values").cast("long").alias("line_count"),
    )


def line_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, first_line, lines) per text file with lines, numbered through all files by their names.

    One pass over the files; keep the result and add to it when a log rolls. Lines are counted
    where they are read, so a file of any size is many tasks' work.
    """
    counts = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("lines"))
    # One row for each file: the log's own size is never sorted.
    before = F.sum("lines").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("file", F.coalesce(before, F.lit(0)).alias("first_line"), "lines")


def line_page(spark: SparkSession, index: DataFrame, start: int, size: int) -> DataFrame:
    """(line_no, value) of `size` lines from line `start` on, counted from zero.

    Only the files that the page overlaps are read. Rolled logs have files of bounded size, so a page
    costs the same wherever it lies.
    """
    parts = index.filter((F.col("first_line") < start + size) & (F.col("first_line") + F.col("lines") > start))
    files = parts.orderBy("first_line").collect()
    if not files or size <= 0:
        return spark.createDataFrame([], "line_no bigint, value string")
    lines = spark.read.text([unquote(f.file) for f in files]).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    ensure_checkpoint_dir(spark)
    lines = lines.checkpoint()
    inside = Window.partitionBy("file", "block").orderBy("at")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    offsets = blocks.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    first = spark.createDataFrame([(f.file, f.first_line) for f in files], "file string, first_line bigint")
    numbered = lines.withColumn("row", F.row_number().over(inside) - 1).join(offsets, ["file", "block"]).join(F.broadcast(first), "file")
    line_no = F.col("first_line") + F.col("offset") + F.col("row")
    page = numbered.select(line_no.alias("line_no"), "value")
    return page.filter((F.col("line_no") >= start) & (F.col("line_no") < start + size))
