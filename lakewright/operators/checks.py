"""Data-quality checks; each returns a DataFrame and runs nothing by itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _count(df: DataFrame):
    return df.agg(F.count(F.lit(1))).scalar()


def not_empty_check(df: DataFrame) -> DataFrame:
    """One check row: `df` must have rows."""
    counts = df.sparkSession.range(1).select(_count(df).alias("observed"))
    return counts.select(
        F.lit("not_empty").alias("check"), "observed", F.lit(1).cast("long").alias("expected"),
        (F.col("observed") > 0).alias("passed"),
    )


def row_count_check(raw: DataFrame, silver: DataFrame) -> DataFrame:
    """Checks (check, observed, expected, passed): silver not empty, and as long as raw."""
    counts = raw.sparkSession.range(1).select(_count(silver).alias("observed"), _count(raw).alias("expected"))
    same_rows = counts.select(
        F.lit("same_row_count").alias("check"), "observed", "expected",
        (F.col("observed") == F.col("expected")).alias("passed"),
    )
    return not_empty_check(silver).unionByName(same_rows)


def increase_check(before: DataFrame, after: DataFrame, check: str = "row_count_increased") -> DataFrame:
    """One check row: `after` must have more rows than `before`."""
    counts = before.sparkSession.range(1).select(_count(after).alias("observed"), _count(before).alias("expected"))
    return counts.select(
        F.lit(check).alias("check"), "observed", "expected",
        (F.col("observed") > F.col("expected")).alias("passed"),
    )


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, null_count) for every listed column, from one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot([], list(cols), "column_name", "null_count")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)


def orphan_rows(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Child rows whose reference (child column -> parent column) has no parent; null references pass.

    The parent's columns are its primary key, so they are joined as they are;
    AQE can then split a parent that very many children refer to.
    """
    parents = parent.select(*[F.col(p).alias(c) for c, p in on.items()])
    return child.dropna(subset=list(on)).join(parents, list(on), "left_anti").select(*child.columns)


def invalid_values(df: DataFrame, column: str, allowed: Sequence[object]) -> DataFrame:
    """Rows whose value is set but not one of `allowed`."""
    return df.filter(~F.col(column).isin(*allowed))
