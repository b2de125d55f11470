"""Literals of Python values read back from Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType


def typed_literal(value: object, data_type: DataType) -> Column:
    """`value` as a literal of `data_type`; times without zone are not moved by the session zone."""
    if isinstance(data_type, TimestampNTZType) and value is not None:
        return F.lit(str(value)).cast(data_type)
    return F.lit(value).cast(data_type)
