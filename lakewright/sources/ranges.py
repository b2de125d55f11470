"""Reads cut into parts of about equal size, for sources that name no column to cut by."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DateType,
    NumericType,
    TimestampNTZType,
    TimestampType,
)

KINDS = (NumericType, DateType, TimestampType, TimestampNTZType)
#: Error of the quantiles: 1 / ACCURACY of all rows.
ACCURACY = 10_000


def split_column(df: DataFrame) -> str | None:
    """The column to cut a read by: a number, date or time with the most different values; few nulls
    and the earlier place decide between equals. None if there is no such column."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, KINDS)]
    if not names:
        return None
    counts = df.agg(
        *[F.approx_count_distinct(c).alias(f"d{n}") for n, c in enumerate(names)],
        *[F.count(c).alias(f"n{n}") for n, c in enumerate(names)],
    ).first()
    return names[max(range(len(names)), key=lambda n: (counts[f"d{n}"], counts[f"n{n}"], -n))]


def literal(value: object, kind: DataType) -> str:
    """A value as SQL text that Spark and relational databases read alike."""
    if isinstance(kind, DateType):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE PRECISION)" if not math.isfinite(value) else f"{value!r}" if "e" in repr(value) else f"{value!r}e0"
    return str(value)


def cuts(df: DataFrame, column: str, parts: int) -> list[tuple[object, bool]]:
    """(value, frequent) in ascending order: the quantiles that cut the column into `parts` ranges of
    about as many rows. A value that several quantiles fall on is frequent."""
    shares = [n / parts for n in range(1, parts)]
    kind = df.schema[column].dataType
    if not isinstance(kind, KINDS):
        raise ValueError(f"{column} is neither a number nor a date nor a time")
    if not shares:
        return []
    found = df.agg(F.percentile_approx(column, F.lit(shares), F.lit(ACCURACY)).alias("q")).first().q or []
    found = [v for v in found if not (isinstance(v, float) and math.isnan(v))]
    values = sorted(set(found))
    return [(v, found.count(v) > 1) for v in values]


def predicates(column: str, kind: DataType, found: Sequence[tuple[object, bool]]) -> list[str]:
    """SQL conditions of which every row meets exactly one, rows with a null in the column too.

    Ranges are closed below and open above, both ends are without bound, and a frequent value is a range of its
    own. The first condition takes the nulls.
    """
    edges: list[tuple[str, str]] = []
    for value, frequent in found:
        text = literal(value, kind)
        edges.append((text, ">="))
        if frequent:
            edges.append((text, ">"))
    if not edges:
        return [f"{column} IS NULL OR {column} IS NOT NULL"]
    beyond = {">=": "<", ">": "<="}
    out = [f"{column} {beyond[edges[0][1]]} {edges[0][0]} OR {column} IS NULL"]
    for (low, above), (high, below) in zip(edges, edges[1:]):
        out.append(f"{column} {above} {low} AND {column} {beyond[below]} {high}")
    return [*out, f"{column} {edges[-1][1]} {edges[-1][0]}"]


def plan_ranges(df: DataFrame, column: str | None = None, parts: int = 8) -> list[str]:
    """Conditions that read `df` in about `parts` parts of even size, by `column` or the one that
    `split_column` picks; one condition for everything if there is none.

    Costs one pass over that column, combined before anything is shuffled. The conditions
    suit `read_jdbc` as well as filters on files.
    """
    column = split_column(df) if column is None else column
    if column is None:
        return ["1 = 1"]
    return predicates(column, df.schema[column].dataType, cuts(df, column, parts))


def read_ranges(df: DataFrame, conditions: Sequence[str], name: str | None = None) -> DataFrame:
    """The parts put together again, one read for each condition; `name` numbers the parts."""
    whole = None
    for n, condition in enumerate(conditions):
        part = df.filter(condition)
        part = part if name is None else part.withColumn(name, F.lit(n))
        whole = part if whole is None else whole.unionByName(part)
    return df if whole is None else whole
