"""The plain aggregates and computed columns of the curation jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def average_over(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Average of `column` over rows where it exceeds `threshold`."""
    return df.filter(F.col(column) > threshold).agg(F.avg(column).alias(f"avg_{column}"))


def bucket_histogram(df: DataFrame, column: str, width: int) -> DataFrame:
    """Row count per bucket of `width`, labelled by the lower bound, in order.

    Whole numbers never become floating-point on the way, so large ones keep all digits.
    """
    value = F.col(column)
    if isinstance(df.schema[column].dataType, IntegralType) and float(width).is_integer():
        value = value.cast("long")
        bucket = value - F.pmod(value, F.lit(int(width)).cast("long"))
    else:
        bucket = (F.floor(value / width) * width).cast("long")
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("row_count")).orderBy("bucket")


def line_total(items: DataFrame, quantity: str = "quantity", unit_price: str = "unit_price") -> DataFrame:
    """`items` with line_total = quantity * unit_price as decimal(12,2)."""
    return items.withColumn("line_total", (F.col(quantity) * F.col(unit_price)).cast("decimal(12,2)"))
