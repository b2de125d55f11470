"""Order statistics per group and key-skew reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegralType

from lakewright.operators.ordering import (
    DEFAULT_GROUP_ROWS,
    join_null_safe,
    sorted_chunks,
    sized,
    split_by_group_size,
)

DEFAULT_THRESHOLD = 3.0

# The zero-based position read for each statistic is n * numerator div 4.
QUARTERS = {"p25": 1, "median": 2, "p75": 3}

STATISTICS = {"n", "min", "p25", "median", "mean", "p75", "max", "ratio", "skewed"}


def _position(n: Column, numerator: int) -> Column:
    """n * numerator div 4 in whole numbers."""
    product = n * F.lit(numerator)
    return F.shiftright(product, 2)


def _small_groups(values: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sort each group in a window; sort, positions and picks share one shuffle."""
    whole = Window.partitionBy(*group)
    rows = values.select(
        *group,
        "_value",
        (F.row_number().over(whole.orderBy("_value")) - 1).alias("_at"),
        F.count(F.lit(1)).over(whole).alias("_n"),
    )
    picks = [
        F.max(F.when(F.col("_at") == _position(F.col("_n"), q), F.col("_value"))).alias(name)
        for name, q in QUARTERS.items()
    ]
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_value").alias("min"),
        F.sum("_value").cast("double").alias("_sum"),
        F.max("_value").alias("max"),
        *picks,
    )


def _large_groups(counts: DataFrame, group: Sequence[str], groups: int) -> DataFrame:
    """Same statistics from (group, _value, _count, _total) rows of `groups` groups, each of any size.

    The distinct values are sorted over the whole cluster. Counts per chunk say
    which chunk holds each position, and only those chunks are looked at again.
    """
    rows = sorted_chunks(counts, [*group, "_value"])
    chunk_keys = [*group, "_chunk"]
    in_order = Window.partitionBy(*group).orderBy("_chunk")
    before = F.sum("_rows").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    chunks = (
        rows.groupBy(*chunk_keys)
        .agg(
            F.sum("_count").alias("_rows"),
            F.sum("_total").alias("_sum"),
            F.min("_value").alias("_min"),
            F.max("_value").alias("_max"),
        )
        .withColumn("_before", F.coalesce(before, F.lit(0)))
        .withColumn("_n", F.sum("_rows").over(Window.partitionBy(*group)))
    )
    summary = chunks.groupBy(*group).agg(
        F.sum("_rows").alias("n"),
        F.min("_min").alias("min"),
        F.sum("_sum").cast("double").alias("_sum"),
        F.max("_max").alias("max"),
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), _position(F.col("_n"), q).alias("at"))
            for name, q in QUARTERS.items()
        ]
    )
    picks = (
        chunks.select(*chunk_keys, "_before", "_rows", F.explode(wanted).alias("_pick"))
        .filter((F.col("_pick.at") >= F.col("_before")) & (F.col("_pick.at") < F.col("_before") + F.col("_rows")))
        .select(*chunk_keys, "_before", F.col("_pick.name").alias("_name"), F.col("_pick.at").alias("_at"))
    )
    running = Window.partitionBy(*chunk_keys, "_name").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        join_null_safe(rows, sized(picks, len(QUARTERS) * groups), chunk_keys, "inner")
        .withColumn("_upto", F.col("_before") + F.sum("_count").over(running))
        .filter((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_count")))
        .groupBy(*group)
        .agg(*[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in QUARTERS])
    )
    return join_null_safe(summary, found, group, "inner")


def _report(stats: DataFrame, group: Sequence[str], threshold: float) -> DataFrame:
    names = ["min", "p25", "median", "p75", "max"]
    stats = stats.withColumns({name: F.col(name).cast("double") for name in names})
    ratio = F.when(F.col("median") > 0, F.col("max") / F.col("median")).otherwise(F.lit(0.0))
    return stats.select(
        *group, "n", "min", "p25", "median",
        (F.col("_sum") / F.col("n")).alias("mean"),
        "p75", "max",
        ratio.alias("ratio"),
        (ratio >= F.lit(threshold)).alias("skewed"),
    )


def skew_report(
    df: DataFrame,
    group: str | Sequence[str],
    value: str,
    threshold: float = DEFAULT_THRESHOLD,
    max_group_rows: int = DEFAULT_GROUP_ROWS,
) -> DataFrame:
    """Spread of `value` per group: n, min, p25, median, mean, p75, max, ratio, skewed.

    Quantiles are picked by position (n/4, n/2, 3n/4 of the sorted values,
    counted from zero), so the median of two values is the larger one. The ratio
    is max / median, 0 when the median is not positive, and a group is skewed
    from `threshold` on. Null values are left out; a group without values gives no row.
    Whole and decimal numbers are summed exactly. The input is read twice, so
    checkpoint one that is costly to compute. A group column may not be named like
    one of these statistics.
    """
    group = [group] if isinstance(group, str) else list(group)
    clash = sorted(set(group) & STATISTICS)
    if clash:
        raise ValueError(f"group columns named like a statistic: {', '.join(clash)}")
    own = {name: f"_group_{i}" for i, name in enumerate(group)}
    kind = df.schema[value].dataType
    if isinstance(kind, IntegralType):
        kind = DecimalType(20, 0)
    elif not isinstance(kind, DecimalType):
        kind = DoubleType()
    values = df.filter(F.col(value).isNotNull()).select(
        *[F.col(name).alias(inner) for name, inner in own.items()], F.col(value).cast(kind).alias("_value")
    )
    names, group = group, list(own.values())
    small, large, groups = split_by_group_size(values, group, max_group_rows)
    stats = _small_groups(small, group)
    if large is not None:
        counts = large.groupBy(*group, "_value").agg(F.count(F.lit(1)).alias("_count"), F.sum("_value").alias("_total"))
        stats = stats.unionByName(_large_groups(counts, group, groups))
    return _report(stats, group, threshold).withColumnsRenamed(dict(zip(group, names)))


def key_skew(df: DataFrame, key: str | Sequence[str], threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One row telling how unevenly rows spread over the values of `key`.

    Row counts per key are themselves counted, which leaves few distinct values
    (k of them need k * (k + 1) / 2 rows), whatever the number of keys.
    """
    key = [key] if isinstance(key, str) else list(key)
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    counts = per_key.groupBy(F.col("_rows").cast("double").alias("_value")).agg(
        F.count(F.lit(1)).alias("_count")
    )
    running = Window.partitionBy(F.lit(0)).orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.sum("_count").over(running)).withColumn(
        "_n", F.sum("_count").over(Window.partitionBy(F.lit(0)))
    )
    picks = [
        F.max(
            F.when(
                (_position(F.col("_n"), q) < F.col("_upto"))
                & (_position(F.col("_n"), q) >= F.col("_upto") - F.col("_count")),
                F.col("_value"),
            )
        ).alias(name)
        for name, q in QUARTERS.items()
    ]
    stats = ranked.agg(
        F.sum("_count").alias("n"),
        F.min("_value").alias("min"),
        F.sum(F.col("_value") * F.col("_count")).alias("_sum"),
        F.max("_value").alias("max"),
        *picks,
    ).filter(F.col("n").isNotNull())
    return _report(stats, [], threshold)
