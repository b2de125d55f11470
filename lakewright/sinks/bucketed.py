"""Tables cut into buckets by key, which later merges on that key read without a shuffle.

A table lies in files of one bucket each: a row's bucket follows from a hash of its keys, the
one that Spark's own shuffle takes. A merge deals the source alone to the same number of
partitions and joins it to the files of each bucket, so the target crosses the network
when it is written for the first time and never again; a merge writes buckets once more.

The layout (keys, number of buckets, columns) is written beside the table. A later session
opens the table by it, as a wrong number of buckets would lose matches without an error.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, DoubleType, FloatType, StructType

from lakewright.operators.merge import MANY_MATCHES, _own

LAYOUT_SCHEMA = "keys array<string>, buckets int, columns string"


@dataclass(frozen=True)
class BucketedTable:
    """A table of the session's catalog and where its files are."""

    name: str
    path: str
    keys: tuple[str, ...]
    buckets: int


def _layout_path(path: str) -> str:
    return f"{path.rstrip('/')}.layout"


def _check_keys(schema: StructType, keys: Sequence[str]) -> None:
    """Keys must be plain values; 0.0 and -0.0 are equal but have different hashes."""
    if not keys:
        raise ValueError("a bucketed table needs keys")
    for key in keys:
        kind = schema[key].dataType
        if not isinstance(kind, AtomicType) or isinstance(kind, (FloatType, DoubleType)):
            raise ValueError(f"{key} of type {kind.simpleString()} cannot be a bucket key")


def _write(df: DataFrame, table: BucketedTable) -> BucketedTable:
    writer = df.write.format("parquet").bucketBy(table.buckets, *table.keys).sortBy(*table.keys)
    writer.option("path", table.path).saveAsTable(table.name)
    spark = df.sparkSession
    layout = spark.createDataFrame([(list(table.keys), table.buckets, df.schema.json())], LAYOUT_SCHEMA)
    layout.coalesce(1).write.parquet(_layout_path(table.path))
    return table


def write_bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> BucketedTable:
    """Writes `df` to the new table `name` at `path`, one file a bucket, sorted by the keys.

    Rows with null keys are kept, in one bucket. Choose `buckets` so that a bucket is a few
    hundred megabytes: it is one task of every merge. An empty table has no files.
    """
    _check_keys(df.schema, keys)
    return _write(df.repartition(buckets, *keys), BucketedTable(name, path, tuple(keys), buckets))


def open_bucketed(spark: SparkSession, name: str, path: str) -> BucketedTable:
    """Declares the table at `path`, written by another session, under `name`."""
    layout = spark.read.schema(LAYOUT_SCHEMA).parquet(_layout_path(path)).first()
    schema = StructType.fromJson(json.loads(layout.columns))
    quoted = ["`" + key.replace("`", "``") + "`" for key in layout["keys"]]
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    by = ", ".join(quoted)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
        f"INTO {layout.buckets} BUCKETS LOCATION '{path}'"
    )
    return BucketedTable(name, path, tuple(layout["keys"]), layout.buckets)


def merged_rows(
    spark: SparkSession, table: BucketedTable, source: DataFrame, set_cols: Sequence[str] | None = None
) -> DataFrame:
    """The table after `WHEN MATCHED UPDATE SET set_cols / WHEN NOT MATCHED INSERT *`, with
    only the source shuffled.

    Source columns are taken by name and cast to the table's types; others are ignored. Null
    keys never match, so source rows with one are inserted, apart from the join, where they
    would all be one task. Several source rows for one row of the table raise an error.
    """
    target, keys = spark.table(table.name), list(table.keys)
    set_cols = [c for c in target.columns if c not in keys] if set_cols is None else list(set_cols)
    rows = source.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.schema.fields])
    keyed = F.lit(True)
    for key in keys:
        keyed = keyed & F.col(key).isNotNull()

    here, new, count = (_own(n, target) for n in ("_held", "_new", "_rows"))
    dealt = rows.filter(keyed).repartition(table.buckets, *keys)
    counted = dealt.withColumn(count, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    payload = F.struct(count, *[c for c in rows.columns if c not in keys]).alias(new)
    pairs = target.withColumn(here, F.lit(True)).join(counted.select(*keys, payload), keys, "full")
    held, fresh = F.col(here).isNotNull(), F.col(new).isNotNull()
    single = F.when(held & (F.col(new)[count] > 1), F.raise_error(F.lit(MANY_MATCHES)).cast("boolean")).otherwise(F.lit(True))

    def value(name: str) -> Column:
        if name in keys:
            return F.col(name)
        taken = fresh if name in set_cols else ~held
        return F.when(taken, F.col(new)[name]).otherwise(F.col(name)).alias(name)

    merged = pairs.filter(single).select(*[value(c) for c in target.columns])
    return merged.unionByName(rows.filter(~keyed))


def merge_bucketed(
    spark: SparkSession, table: BucketedTable, source: DataFrame, name: str, path: str, set_cols: Sequence[str] | None = None
) -> BucketedTable:
    """Upserts `source` and writes the result as the new table `name` at `path` in the same
    buckets; the old version stays readable.

    Each task of the join holds one bucket and writes it. Files of inserted rows without a
    key are apart, so the bucket of null keys can have several.
    """
    merged = merged_rows(spark, table, source, set_cols)
    return _write(merged, BucketedTable(name, path, table.keys, table.buckets))
