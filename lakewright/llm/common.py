"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.session import scratch_path

#: A word: a longest run of characters other than blank, tab, line feed, vertical
#: tab, form feed and carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


#: What empties the caches that operators keep in a Python worker, and the last operator there.
CACHES: list[Callable[[], object]] = []
_LAST: list[str] = []


def entering(operator: str) -> None:
    """Called by a task in its worker: gives back what another operator has cached there."""
    if _LAST != [operator]:
        for empty in CACHES:
            empty()
        _LAST[:] = [operator]
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


#: Bytes of an Arrow batch between Spark and Python; Spark's own limit is 64 MiB, which a task
#: holds several times over on both sides.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Sends this package's code to the Python workers of a running application, once, as
    `spark-submit --py-files` would, and bounds its Arrow batches unless the application does."""
    context = spark.sparkContext
    if BATCH_SETTING not in dict(context.getConf().getAll()):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    if getattr(context, "_lakewright_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="lakewright-")) / "lakewright.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._lakewright_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder; the code that works on it goes to the workers first."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pin(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written once to the shared folder and read from there.

    It cuts lineage: later plans read the table, and a lost executor costs only a
    read of it again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the values of a string or binary column stay near `limit` bytes.

    A single longer value makes a batch of its own, so no value is cut.
    """
    for batch in batches:
        lengths = batch.column(column)
        lengths = pa.compute.fill_null(pa.compute.binary_length(lengths), 0).to_pylist()
        begin = held = 0
        for row, length in enumerate(lengths):
            if held and held + length > limit:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += length
        if begin < batch.num_rows:
            yield batch.slice(begin)


def bytes_of(df: DataFrame, column: str = "text") -> int:
    """All UTF-8 bytes of a string column, by one scan of it."""
    row = df.agg(F.sum(F.octet_length(F.col(column).cast("string"))).alias("n")).first()
    return int(row.n or 0)
