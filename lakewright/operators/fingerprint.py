"""Fingerprints of tables as multisets of rows, and what differs between two of them.

A fingerprint is a row count and two sums of row hashes with different seeds, each modulo
2**64. It does not depend on order or layout, tells repeated rows apart from single ones, and
is added up before the shuffle, so comparing two tables moves a few numbers a bucket and no rows.
Tables that differ are read once more, and only rows of unequal buckets are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, DataType, DoubleType, FloatType, MapType, VariantType

BUCKETS = 4096
SEEDS = (11, 7_919)
WORD = 2**32


def _modulus() -> Column:
    return F.lit(str(2**64)).cast("decimal(38,0)")


def _hashable(name: str, kind: DataType) -> Column:
    """A column as it goes into a row's hash: -0.0 as 0.0, nested values as text with their nulls."""
    if isinstance(kind, (MapType, VariantType)):
        raise ValueError(f"rows with maps or variants cannot be compared: {name}")
    if isinstance(kind, (DoubleType, FloatType)):
        return F.col(name) + F.lit(0.0).cast(kind)
    if isinstance(kind, AtomicType):
        return F.col(name)
    return F.to_json(F.struct(name), {"ignoreNullFields": "false"})


def row_hash(df: DataFrame, cols: Sequence[str], seed: int) -> Column:
    """A 64-bit hash of some columns; which of them are null counts too."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    return F.xxhash64(F.lit(seed), nulls, *[_hashable(c, df.schema[c].dataType) for c in cols])


def bucket_prints(df: DataFrame, cols: Sequence[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """bucket, row_count, print_a, print_b for every bucket of rows that has any.

    Halves of the hashes are summed apart, as whole numbers, so no sum overflows below
    2**31 rows a bucket; take more buckets for tables beyond.
    """
    cols = list(df.columns) if cols is None else list(cols)
    hashes = df.select(*[row_hash(df, cols, seed).alias(name) for name, seed in zip("ab", SEEDS)])
    halves = [
        F.sum(half).alias(f"{name}_{part}")
        for name in "ab"
        for part, half in (("low", F.col(name).bitwiseAND(F.lit(WORD - 1))), ("high", F.shiftrightunsigned(name, 32)))
    ]
    sums = hashes.groupBy(F.pmod("a", F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("row_count"), *halves)

    def whole(name: str) -> Column:
        high, low = (F.col(f"{name}_{part}").cast("decimal(20,0)") for part in ("high", "low"))
        return ((high * WORD + low) % _modulus()).cast("decimal(20,0)").alias(f"print_{name}")

    return sums.select("bucket", "row_count", whole("a"), whole("b"))


def table_print(df: DataFrame, cols: Sequence[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """One row (row_count, print_a, print_b) for the whole table; zeros for an empty one."""
    parts = bucket_prints(df, cols, buckets)
    sums = [
        F.coalesce((F.sum(f"print_{name}") % _modulus()).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")).alias(f"print_{name}")
        for name in "ab"
    ]
    return parts.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"), *sums)


def unequal_buckets(
    before: DataFrame, after: DataFrame, cols: Sequence[str], buckets: int = BUCKETS
) -> DataFrame:
    """bucket, rows_before, rows_after of the buckets whose fingerprints differ."""
    sides = bucket_prints(before, cols, buckets).withColumn("_old", F.lit(1)).unionByName(
        bucket_prints(after, cols, buckets).withColumn("_old", F.lit(-1))
    )
    sums = sides.groupBy("bucket").agg(
        F.sum(F.when(F.col("_old") == 1, F.col("row_count")).otherwise(0)).alias("rows_before"),
        F.sum(F.when(F.col("_old") == -1, F.col("row_count")).otherwise(0)).alias("rows_after"),
        *[F.sum(F.col(f"print_{name}") * F.col("_old")).alias(name) for name in "ab"],
    )
    differs = (F.col("rows_before") != F.col("rows_after")) | (F.col("a") != 0) | (F.col("b") != 0)
    return sums.filter(differs).select("bucket", "rows_before", "rows_after")


def _in_buckets(df: DataFrame, cols: Sequence[str], buckets: int, wanted: Sequence[int]) -> DataFrame:
    if not wanted:
        return df.limit(0)
    bucket = F.pmod(row_hash(df, cols, SEEDS[0]), F.lit(buckets))
    return df if len(wanted) == buckets else df.filter(bucket.isin(*wanted))


def changed_rows(
    before: DataFrame, after: DataFrame, cols: Sequence[str] | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Rows that the two tables do not hold equally often, as (columns, rows_before, rows_after).

    Both tables have the columns `cols`, by default those of `before`, with equal types.
    Nulls equal nulls. Buckets that agree are left unread by the second pass's shuffle; at most
    `buckets` numbers come to the driver.
    """
    cols = list(before.columns) if cols is None else list(cols)
    wrong = [c for c in cols if before.schema[c].dataType != after.schema[c].dataType]
    if wrong:
        raise ValueError(f"types differ: {', '.join(wrong)}")
    wanted = [r.bucket for r in unequal_buckets(before, after, cols, buckets).collect()]
    left, right = "_before", "_after"
    sides = [
        _in_buckets(side, cols, buckets, wanted).select(*cols, F.lit(old).alias(left), F.lit(1 - old).alias(right))
        for side, old in ((before, 1), (after, 0))
    ]
    counts = sides[0].unionByName(sides[1]).groupBy(*cols)
    counts = counts.agg(F.sum(F.col(left).cast("long")).alias("rows_before"), F.sum(F.col(right).cast("long")).alias("rows_after"))
    return counts.filter(F.col("rows_before") != F.col("rows_after"))


def rows_unchanged(before: DataFrame, after: DataFrame, check: str = "rows_unchanged", buckets: int = BUCKETS) -> DataFrame:
    """One check row (check, observed, expected, passed): `after` holds the same rows as `before`.

    `observed` and `expected` are row counts; equal ones do not suffice, the fingerprints must agree.
    """
    cols = before.columns
    old = table_print(before, cols, buckets).select(F.struct("*").alias("old"))
    new = table_print(after, cols, buckets).select(F.struct("*").alias("new"))
    # One row on either side.
    both = old.join(new, F.col("old.row_count").isNotNull())
    return both.select(
        F.lit(check).alias("check"), F.col("new.row_count").alias("observed"), F.col("old.row_count").alias("expected"),
        (F.col("old") == F.col("new")).alias("passed"),
    )
