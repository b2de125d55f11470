"""Order-dependent operators that never put one large group into one task.

Small groups use an ordinary window. A group above `max_group_rows` goes
through `sorted_chunks`: Spark's range-partitioned sort spreads it over many
tasks, and only one summary row per chunk crosses chunk borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DateType,
    MapType,
    NumericType,
    StructType,
    TimestampNTZType,
    TimestampType,
    VariantType,
)

from lakewright.functions.literals import typed_literal
from lakewright.session import ensure_checkpoint_dir

DEFAULT_GROUP_ROWS = 5_000_000
DEFAULT_HEAP_ROWS = 10_000
BROADCAST_ROWS = 500_000
RANGES = 64


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, (MapType, VariantType)):
        return False
    if isinstance(kind, ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_orderable(field.dataType) for field in kind.fields)
    return True


def total_order(df: DataFrame, order: Sequence[str]) -> list[str]:
    """`order`, then every other sortable column, so that only equal rows tie."""
    rest = [f.name for f in df.schema.fields if f.name not in order and _orderable(f.dataType)]
    return [*order, *rest]


def sorted_chunks(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """`df` sorted over the whole cluster, with `_chunk` and `_row` fixed by a checkpoint.

    `_chunk` numbers the sorted partitions in order and `_row` increases within
    each. Range partitioning works on all sort columns together, so a frequent
    leading value is still split as long as the later columns differ. The
    checkpoint keeps both numbers stable when tasks are run again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (
        df.orderBy(*order)
        .withColumn("_chunk", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
        .checkpoint()
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on `keys` where null matches null; key columns come from `left`."""
    names = {key: f"_right_{key}" for key in keys}
    on = [F.col(key).eqNullSafe(F.col(name)) for key, name in names.items()]
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def sized(df: DataFrame, rows: int) -> DataFrame:
    """`df` marked for broadcast if its known bound of `rows` allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def split_by_group_size(
    df: DataFrame, group: Sequence[str], max_group_rows: int
) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of groups up to `max_group_rows`, rows of larger groups (or None), number of larger groups.

    One job counts rows per group with map-side partial sums, a second one keeps the
    list of large groups if there are any. They are at most rows / max_group_rows.
    """
    if not group:
        large = df.count() > max_group_rows
        return (df.limit(0), df, 1) if large else (df, None, 0)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    large = sizes.filter(F.col("_size") > max_group_rows).select(*group)
    groups = large.count()
    if groups == 0:
        return df, None, 0
    ensure_checkpoint_dir(df.sparkSession)
    large = large.checkpoint()
    large = sized(large, groups)
    return (
        join_null_safe(df, large, group, "left_anti"),
        join_null_safe(df, large, group, "left_semi"),
        groups,
    )


def drop_consecutive_duplicates(
    df: DataFrame,
    cols: Sequence[str],
    partition: Sequence[str],
    order: Sequence[str],
    max_group_rows: int = DEFAULT_GROUP_ROWS,
    unique_order: bool = False,
) -> DataFrame:
    """Keep a row only if `cols` differ from the row before it in its partition.

    Nulls equal nulls, and the first row of a partition is kept. Ties in `order`
    are broken by the remaining columns, so the result does not depend on layout.
    `unique_order` promises that there are none and saves a shuffle of large groups.
    """
    order = list(order) if unique_order else total_order(df, order)
    order = [c for c in order if c not in partition]
    current = F.struct(*cols)
    small, large, groups = split_by_group_size(df, partition, max_group_rows)

    # With no partition column this window is one task, of at most max_group_rows rows.
    window = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(*order)
    kept = (
        small.withColumn("_previous", F.lag(current).over(window))
        .filter(F.col("_previous").isNull() | ~current.eqNullSafe(F.col("_previous")))
        .select(*df.columns)
    )
    if large is None:
        return kept

    # Equal rows stand next to each other, so one of each is enough.
    if not unique_order and all(_orderable(f.dataType) for f in df.schema.fields):
        large = large.distinct()
    rows = sorted_chunks(large, [*partition, *order])
    chunk_keys = [*partition, "_chunk"]
    inside = Window.partitionBy(*chunk_keys).orderBy("_row")
    across = Window.partitionBy(*(partition or [F.lit(0)])).orderBy("_chunk")
    borders = (
        rows.groupBy(*chunk_keys)
        .agg(F.max_by(current, "_row").alias("_last"))
        .withColumn("_carried", F.lag("_last").over(across))
        .drop("_last")
    )
    # A chunk border or a group border starts a row of `borders`.
    borders = sized(borders, groups + rows.rdd.getNumPartitions())
    heads = rows.withColumn("_previous", F.lag(current).over(inside))
    previous = F.coalesce(F.col("_previous"), F.col("_carried"))
    spread = join_null_safe(heads, borders, chunk_keys, "left").filter(
        previous.isNull() | ~current.eqNullSafe(previous)
    )
    return kept.unionByName(spread.select(*df.columns))


def last_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The last `n` rows by `order`, returned in ascending order (a bounded top-k)."""
    order = total_order(df, order)
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n).orderBy(*order)


def last_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last `n` lines of the text file at `path`, in file order (a bounded top-k).

    Of several files those with the last names count. A line's place is its file, the
    start of its block there and its number within the task that reads the block.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    lines = spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("_line"))
    order = ["_file", "_block", "_line"]
    return lines.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order).select("value")


def page(
    df: DataFrame,
    order: Sequence[str],
    start: int,
    size: int = 100,
    max_heap_rows: int = DEFAULT_HEAP_ROWS,
) -> DataFrame:
    """Rows `start` up to `start + size` of `df` in `order`; ties go by the other columns.

    Near the front this is Spark's top-k with an offset. Further in, a top-k would
    keep `start` rows per task. There rows are counted per range of the first column,
    the keys of the ranges that the page overlaps are sorted over the cluster to find those
    on the page, and only rows between its first and last key are read.
    """
    if start + size <= max_heap_rows:
        return df.orderBy(*total_order(df, order)).offset(start).limit(size)
    order = list(order)
    df, passed = _around(df, order[0], start, size)
    start -= passed
    keys = _page_keys(df.groupBy(*order).agg(F.count(F.lit(1)).alias("_count")), order, start, size)
    if set(order) == set(df.columns):
        copies = F.explode(F.sequence(F.lit(1), F.col("_copies")))
        return keys.withColumn("_copy", copies).orderBy(*order).select(*df.columns)
    first = F.col(order[0])
    before, nulls, lowest, highest = keys.agg(
        F.min("_position"), F.count_if(first.isNull()), F.min(first), F.max(first)
    ).first()
    if before is None:
        return df.limit(0)
    key = F.struct(*order)
    low, high = keys.agg(F.min(key)).scalar(), keys.agg(F.max(key)).scalar()
    rows = df.filter((key >= low) & (key <= high))
    if not nulls:
        # The bounds of the first column once more as literals, which the scan can use.
        kind = df.schema[order[0]].dataType
        rows = rows.filter(first.between(typed_literal(lowest, kind), typed_literal(highest, kind)))
    everything = total_order(df, order)
    if start - before + size <= max_heap_rows or order == everything:
        return rows.orderBy(*everything).offset(start - before).limit(size)
    # Very many rows share the first key of the page: page among them by all columns.
    return page(rows, everything, start - before, size, max_heap_rows)


def _around(df: DataFrame, first: str, start: int, size: int) -> tuple[DataFrame, int]:
    """Rows in the ranges of column `first` that the page overlaps, and how many come before.

    The ends of the ranges are approximate quantiles, so only types that have them are cut;
    the counts are exact, and rows are never lost whatever the ends.
    """
    if not isinstance(df.schema[first].dataType, (NumericType, DateType, TimestampType, TimestampNTZType)):
        return df, 0
    quantiles = [i / RANGES for i in range(1, RANGES)]
    found = df.agg(F.percentile_approx(first, quantiles, 10 * RANGES)).first()[0]
    kind, column = df.schema[first].dataType, F.col(first)
    ends = [typed_literal(v, kind) for v in sorted(set(found or []))]
    if not ends:
        return df, 0
    nulls, *below = df.agg(F.count_if(column.isNull()), *[F.count_if(column < end) for end in ends]).first()
    before = [nulls + n for n in below]
    low = max((i for i, n in enumerate(before) if n <= start), default=None)
    high = min((i for i, n in enumerate(before) if n >= start + size), default=None)
    rows = df
    if low is not None:
        rows = rows.filter(column >= ends[low])
    if high is not None:
        rows = rows.filter(column < ends[high] if low is not None else column.isNull() | (column < ends[high]))
    return rows, 0 if low is None else before[low]


def _page_keys(counts: DataFrame, order: Sequence[str], start: int, size: int) -> DataFrame:
    """Keys with rows on the page, `_copies` of them there, and `_position`, the rows before each key."""
    rows = sorted_chunks(counts, order)
    # One row per chunk: the running count needs no partition column.
    running = Window.partitionBy(F.lit(0)).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        rows.groupBy("_chunk")
        .agg(F.sum("_count").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(running), F.lit(0)))
        .filter((F.col("_before") < start + size) & (F.col("_before") + F.col("_rows") > start))
        .select("_chunk", "_before")
    )
    inside = Window.partitionBy("_chunk").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(F.broadcast(chunks), "_chunk")
        .withColumn("_position", F.col("_before") + F.sum("_count").over(inside) - F.col("_count"))
        .filter((F.col("_position") < start + size) & (F.col("_position") + F.col("_count") > start))
        .withColumn(
            "_copies",
            F.least(F.col("_position") + F.col("_count"), F.lit(start + size)) - F.greatest("_position", F.lit(start)),
        )
        .select(*order, "_position", "_copies")
        .checkpoint()
    )


def page_after(df: DataFrame, order: Sequence[str], last_key: Sequence[object], size: int = 100) -> DataFrame:
    """The next `size` rows after `last_key`, for walking pages without offsets.

    The bound on the first column reaches the scan; `order` must be unique and
    free of nulls.
    """
    values = [typed_literal(v, df.schema[c].dataType) for c, v in zip(order, last_key)]
    bound = F.struct(*[v.alias(c) for c, v in zip(order, values)])
    return df.filter((F.col(order[0]) >= values[0]) & (F.struct(*order) > bound)).orderBy(*order).limit(size)


def page_state(df: DataFrame, start: int, size: int = 100) -> DataFrame:
    """One row (start, returned, total, next_from, done) that drives a paging loop."""
    total = F.col("total")
    returned = F.greatest(F.least(total - start, F.lit(size)), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(start).cast("long").alias("start"),
        returned.cast("long").alias("returned"),
        total,
        (F.lit(start) + returned).cast("long").alias("next_from"),
        (F.lit(start) + returned >= total).alias("done"),
    )
