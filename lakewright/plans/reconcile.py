"""Keys that are gone at the source: found by bucket fingerprints, marked by tombstones.

A high-water mark sees new and changed rows, never deleted ones. Comparing all keys finds
them, but most keys are where they were: both sides add up fingerprints of their keys by
bucket, and only the keys of buckets that disagree are joined.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.operators.fingerprint import BUCKETS, SEEDS, bucket_prints, row_hash
from lakewright.operators.merge import delete_where
from lakewright.plans.sync import incremental_extract
from lakewright.sinks import versions
from lakewright.sinks.versions import FileTable, Written


def _keys(df: DataFrame, keys: Sequence[str], like: DataFrame) -> DataFrame:
    cast = [F.col(k).cast(like.schema[k].dataType).alias(k) for k in keys]
    return df.select(*cast).dropna()


def differing_keys(source: DataFrame, target: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(keys, change) of keys that only one side has: `gone` at the source, or `new` there.

    Keys are compared in the target's types; null keys and repeated keys do not count. The
    buckets that disagree, at most `buckets` numbers, come to the driver.
    """
    keys = list(keys)
    sides = [_keys(source, keys, target), _keys(target, keys, target)]
    prints = [bucket_prints(side.distinct(), keys, buckets) for side in sides]
    both = prints[0].withColumn("_side", F.lit(0)).unionByName(prints[1].withColumn("_side", F.lit(1)))
    same = both.groupBy("bucket", "row_count", "print_a", "print_b").agg(F.count_distinct("_side").alias("_sides"))
    wanted = [r.bucket for r in same.filter("_sides < 2").select("bucket").distinct().collect()]
    if not wanted:
        return target.select(*keys, F.lit("gone").alias("change")).limit(0)
    bucket = F.pmod(row_hash(sides[1], keys, SEEDS[0]), F.lit(buckets))
    here, there = (side if len(wanted) == buckets else side.filter(bucket.isin(*wanted)) for side in sides)
    # Repeated keys count once, as only their sides matter; one pass adds these up, on either side of the shuffle.
    held = here.withColumn("_new", F.lit(True)).unionByName(there.withColumn("_new", F.lit(False)))
    held = held.groupBy(*keys).agg(F.bool_and("_new").alias("_all"), F.bool_or("_new").alias("_any"))
    change = F.when(F.col("_all"), "new").otherwise("gone")
    return held.filter(F.col("_all") == F.col("_any")).select(*keys, change.alias("change"))


def mark_deletions(
    spark: SparkSession, table: FileTable, source: DataFrame, keys: Sequence[str], flag: str, as_of: dt.datetime
) -> Written:
    """Set `flag` on the live rows whose keys the source no longer has, in the files of those rows only.

    `source` needs the key columns alone. A key that is there again loses its flag when a sync upserts it.
    """
    live = delete_where(versions.read_table(spark, table), F.col(flag))
    gone = differing_keys(source, live, keys).filter("change = 'gone'").drop("change")
    marks = gone.select(
        *[
            F.lit(True).alias(f.name) if f.name == flag else F.col(f.name) if f.name in keys else F.lit(None).cast(f.dataType).alias(f.name)
            for f in table.schema.fields
        ]
    )
    return versions.upsert_files(spark, table, marks, keys, as_of, set_cols=[flag])


def sync_files(
    spark: SparkSession, table: FileTable, source: DataFrame, keys: Sequence[str], watermark_col: str, flag: str | None,
    as_of: dt.datetime,
) -> list[Written]:
    """One run of a keyed sync into a table with a file log: rows from the high-water mark on are
    upserted, and with a `flag` column keys gone at the source are marked.

    Both rewrite only the files that hold a key concerned.
    """
    held = versions.read_table(spark, table)
    fresh = incremental_extract(source, held, watermark_col, inclusive=True)
    rows = fresh if flag is None else fresh.withColumn(flag, F.lit(False))
    done = [versions.upsert_files(spark, table, rows, keys, as_of)]
    if flag is not None:
        done.append(mark_deletions(spark, table, source.select(*keys), keys, flag, as_of))
    return done
