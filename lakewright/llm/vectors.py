"""What the two vector searches share: clean rows, blocks of queries against blocks of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: Column, zero: bool) -> Column:
    """True for vectors with components, all of them there and finite; with `zero` false
    also one that differs from 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vector.isNotNull() & (F.size(vector) > 0) & finite
    return F.coalesce(good if zero else good & F.exists(vector, lambda x: x != 0), F.lit(False))


def blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def search(
    queries: DataFrame,
    rows: DataFrame,
    columns: list[str],
    find: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    k: int,
    score: str,
    query_block: int,
    row_block: int,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each query.

    `queries` and `rows` have vec_id, dim and `columns`. Queries and rows are dealt to
    blocks by hash; every pair of blocks is one task's work, and `find` gives the k best in
    it as query_id, query_key, vec_id, score. Vectors meet only those of as many components.
    """
    n_rows, n_queries = rows.count(), queries.count()
    row_blocks, query_blocks = blocks(n_rows, row_block), blocks(n_queries, query_block)
    names = ["dim", "row_block", "query_block"]

    def dealt(df: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        place = F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(count)).alias(own)
        return df.select("vec_id", "dim", *columns, place, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    asked = dealt(queries, "query_block", query_blocks, "row_block", row_blocks)
    held = dealt(rows, "row_block", row_blocks, "query_block", query_blocks)
    schema = f"query_id long, query_key long, vec_id long, score {score}"

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            kind = "float64" if score == "double" else "int64"
            return pd.DataFrame({c: pd.Series(dtype=kind if c == "score" else "int64") for c in ("query_id", "query_key", "vec_id", "score")})
        return find(q, r)

    def cast(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).cast("long") if c in names else F.col(c) for c in df.columns])

    best = cast(asked).groupBy(*names).cogroup(cast(held).groupBy(*names)).applyInPandas(run, schema)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def matrix(column: pd.Series, dtype=np.float64) -> np.ndarray:
    return np.stack([np.asarray(v, dtype) for v in column])


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= limit)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def result(query_id, query_key, ids: list[np.ndarray], scores: list[np.ndarray]) -> pd.DataFrame:
    counts = [len(x) for x in ids]
    return pd.DataFrame(
        {
            "query_id": np.repeat(np.asarray(query_id), counts),
            "query_key": np.repeat(np.asarray(query_key), counts),
            "vec_id": np.concatenate(ids),
            "score": np.concatenate(scores),
        }
    )
