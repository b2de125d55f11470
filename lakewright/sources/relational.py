"""Relational query sources."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession


def read_source(
    spark: SparkSession,
    fmt: str,
    options: Mapping[str, str],
    query: str | None = None,
    batch_size: int | None = None,
    partition_column: str | None = None,
    num_partitions: int | None = None,
    predicates: Sequence[str] = (),
) -> DataFrame:
    """Rows of a source: `jdbc` with a query, or any file format with a `path`.

    For file formats `query` is a Spark SQL text over the view `{source}`.
    """
    if fmt == "jdbc":
        text = query or f"SELECT * FROM {options['dbtable']}"
        return read_jdbc(spark, options["url"], text, options, batch_size, partition_column, num_partitions, predicates)
    rows = spark.read.format(fmt).options(**{k: v for k, v in options.items() if k != "path"}).load(options["path"])
    return spark.sql(query, source=rows) if query else rows


def jdbc_from_dsn(kind: str, dsn: str) -> dict[str, str]:
    """Reader options from a `host=... port=... dbname=... user=... password=...` text."""
    if kind != "postgres":
        raise ValueError(f"unknown source type {kind!r}")
    parts = dict(item.split("=", 1) for item in dsn.split())
    url = f"jdbc:postgresql://{parts['host']}:{parts.get('port', '5432')}/{parts['dbname']}"
    if "sslmode" in parts:
        url += f"?sslmode={parts['sslmode']}"
    login = {name: parts[name] for name in ("user", "password") if name in parts}
    return {"url": url, "driver": "org.postgresql.Driver", **login}


def whole_bound(value: object, rounded: Callable[[object], int]) -> str:
    """A bound as the range reader takes it: numbers as whole ones, dates and times as they are."""
    return str(rounded(value)) if isinstance(value, (int, float, Decimal)) else str(value)


def jdbc_options(
    url: str,
    query: str,
    fetch_size: int | None = None,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    num_partitions: int | None = None,
) -> dict[str, str]:
    """Reader options for one query; with a partition column the read is split into ranges."""
    options = {"url": url}
    if fetch_size:
        options["fetchsize"] = str(fetch_size)
    if partition_column is None:
        return {**options, "query": query}
    if bounds is None or num_partitions is None:
        raise ValueError("a partitioned read needs bounds and num_partitions")
    return {
        **options,
        "dbtable": f"({query}) q",
        "partitionColumn": partition_column,
        "lowerBound": whole_bound(bounds[0], math.floor),
        "upperBound": whole_bound(bounds[1], math.ceil),
        "numPartitions": str(num_partitions),
    }


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    options: Mapping[str, str] | None = None,
    batch_size: int | None = None,
    partition_column: str | None = None,
    num_partitions: int | None = None,
    predicates: Sequence[str] | None = None,
) -> DataFrame:
    """Read a query over JDBC, in parallel when told how to cut it.

    With `partition_column` the ends of its range are asked of the database (one
    row) and the range is cut into `num_partitions` reads; rows outside cannot be
    lost because the outer ranges are open. For a column with hot ranges give
    `predicates` instead: one read per condition, which must cover every row once.
    With neither, one connection reads everything in one task.
    """
    extra = {k: v for k, v in (options or {}).items() if k not in ("url", "dbtable", "query")}
    if predicates:
        properties = {**extra, **({"fetchsize": str(batch_size)} if batch_size else {})}
        return spark.read.jdbc(url, f"({query}) q", predicates=list(predicates), properties=properties)
    bounds = None
    if partition_column:
        ends = f"SELECT MIN({partition_column}), MAX({partition_column}) FROM ({query}) q"
        low, high = spark.read.format("jdbc").options(**extra, **jdbc_options(url, ends)).load().first()
        bounds = (low, high)
        if low is None:
            partition_column = None
    made = jdbc_options(url, query, batch_size, partition_column, bounds, num_partitions or 8)
    return spark.read.format("jdbc").options(**extra, **made).load()
