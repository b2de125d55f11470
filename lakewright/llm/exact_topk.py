"""Exact top-k inner products with a pivot table.

Rows get one more component that gives all rows of a dimension the same length, and a query is
scaled to that length; then all lie on one sphere, and the distance along it falls as the inner
product grows. The pivot table holds each row's distances to many pivots of its dimension.
By the triangle inequality the largest difference between a query's and a row's
distances to a pivot bounds their distance from below, hence the inner product from above.
Candidates are evaluated in the order of the bounds until none that is left can reach
the k-th best found.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.llm.common import pin
from lakewright.llm.vectors import best_of, matrix, result, search, usable

#: Pivots of a dimension, and the dimensions that have some: those with the most rows.
#: Both bound what the driver gathers; rows of other dimensions are all evaluated.
PIVOTS = 256
PIVOT_DIMS = 4
STEP = 512
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


class Pivots:
    """Pivots of one dimension on the sphere of the longest row's length."""

    def __init__(self, marks: np.ndarray, norm2: float):
        self.marks, self.norm2 = np.unique(marks, axis=0), norm2
        self.heights = self._heights(self.marks)

    def _heights(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.norm2 - (vectors**2).sum(axis=1)))

    def _angles(self, products: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.arccos(np.clip(np.nan_to_num(products / self.norm2), -1.0, 1.0)).astype(np.float32)

    def of_rows(self, vectors: np.ndarray) -> np.ndarray:
        """Distances of rows to the pivots, as angles."""
        return self._angles(vectors @ self.marks.T + np.outer(self._heights(vectors), self.heights))

    def reach(self, query: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Upper bounds of a query's inner products with rows; `table` has a line per pivot."""
        length = float(query @ query) ** 0.5
        if not length or not np.isfinite(self.norm2):
            return np.full(table.shape[1], np.inf)
        ahead = self._angles((self.marks @ query) * (self.norm2**0.5 / length))
        bound, gap = np.zeros(table.shape[1], np.float32), np.empty(table.shape[1], np.float32)
        for line, own in zip(table, ahead):
            np.subtract(line, own, out=gap)
            np.abs(gap, out=gap)
            np.maximum(bound, gap, out=bound)
        # The slack is far above the rounding of angles kept in 32 bits.
        return length * self.norm2**0.5 * np.cos(bound.astype(float)) + 2e-6 * self.norm2


def choose_pivots(clean: DataFrame, scale: int, pivots: int, dims: int = PIVOT_DIMS) -> dict[int, Pivots]:
    """`pivots` rows of each of the `dims` most frequent dimensions, those with the smallest hashes.

    `clean` has vec_id, dim and v. The number gathered does not follow the table.
    """

    def lengths(batches):
        for pdf in batches:
            whole = [np.floor(np.asarray(v, float) * scale) for v in pdf["v"]]
            pdf = pd.DataFrame({"dim": pdf["dim"], "longest": [float(v @ v) for v in whole], "n": 1})
            yield pdf.groupby("dim", as_index=False).agg({"longest": "max", "n": "sum"})

    found = clean.select("dim", "v").mapInPandas(lengths, "dim int, longest double, n long")
    found = found.groupBy("dim").agg(F.max("longest").alias("longest"), F.sum("n").alias("n"))
    longest = {r.dim: r.longest for r in found.orderBy(F.desc("n"), "dim").limit(dims).collect()}
    order = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id", "v")
    chosen = clean.where(F.col("dim").isin(list(longest))).withColumn("_place", F.row_number().over(order))
    marks: dict[int, list] = {}
    for row in chosen.where(F.col("_place") <= pivots).select("dim", "v").collect():
        marks.setdefault(row.dim, []).append(np.floor(np.array(row.v) * scale))
    return {dim: Pivots(np.stack(held), longest[dim] * (1 + 1e-9)) for dim, held in marks.items()}


def top_k(rows: DataFrame, is_query: Column, k: int = 20, scale: int = 64, pivots: int = PIVOTS, query_block: int = 4096, row_block: int = 8192) -> DataFrame:
    """query_id, rank from 1, vec_id, score (long): the k highest inner products of the
    vectors floor(scale * x), exact, ties to the smaller vec_id.

    `rows` has vec_id and embedding; queries are the rows for which `is_query` holds. A
    query's candidates are all rows with another vec_id and as many components; with k or
    fewer all are returned. Vectors that are null, empty or hold null or non-finite
    components take no part, nor do rows without vec_id; zero vectors do. Scores beyond a
    long become the largest or smallest long. A repeated row is a candidate each time; a repeated
    query is answered once. Other columns are not read. An empty table gives no rows.
    """
    vector = F.col("embedding").cast("array<double>")
    clean = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v"), is_query.alias("asked"))
    clean = clean.where(usable(F.col("v"), zero=True) & F.col("vec_id").isNotNull())
    clean = clean.withColumn("dim", F.size("v"))
    by_dim = choose_pivots(clean, scale, pivots)

    def distances(batches):
        for pdf in batches:
            table = [np.empty(0, np.float32)] * len(pdf)
            for dim in set(pdf["dim"]) & by_dim.keys():
                at = np.flatnonzero(pdf["dim"] == dim)
                whole = np.floor(matrix(pdf["v"].iloc[at]) * scale)
                for place, angles in zip(at, by_dim[dim].of_rows(whole)):
                    table[place] = angles
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "dim": pdf["dim"], "v": pdf["v"], "asked": pdf["asked"], "to_pivots": table})

    indexed = pin(clean.mapInPandas(distances, "vec_id long, dim int, v array<double>, asked boolean, to_pivots array<float>"), "pivot-table")
    queries = indexed.where(F.coalesce("asked", F.lit(False))).select("vec_id", "dim", "v", "to_pivots").distinct()

    def find(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        own, ids = np.floor(matrix(held["v"]) * scale), held["vec_id"].to_numpy()
        near = by_dim.get(own.shape[1])
        table = np.ascontiguousarray(matrix(held["to_pivots"], np.float32).T)
        wanted = np.floor(matrix(asked["v"]) * scale)
        exact = np.abs(own).max() * np.abs(wanted).max() * own.shape[1] < EXACT
        all_ids, all_scores = [], []
        for query_id, q in zip(asked["vec_id"].to_numpy(), wanted):
            others = np.flatnonzero(ids != query_id)
            reach = near.reach(q, table)[others] if near else np.full(len(others), np.inf)
            by_reach = np.argsort(-reach, kind="stable")
            order, reach = others[by_reach], reach[by_reach]
            seen, step, scores, kth = 0, STEP, np.empty(0, np.float64 if exact else object), -np.inf
            while seen < len(order) and (seen < k or reach[seen] >= kth):
                # Not beyond the candidates that can still reach the k-th best.
                able = int(np.searchsorted(-reach, -kth, side="right"))
                part = own[order[seen : min(seen + step, max(able, seen + 1))]]
                step *= 2
                got = part @ q if exact else np.array([sum(int(a) * int(b) for a, b in zip(v, q)) for v in part], object)
                scores = np.concatenate([scores, got])
                seen += len(part)
                if seen >= k:
                    kth = float(np.partition(scores, seen - k)[seen - k] if exact else np.sort(scores)[-k])
            ranked = order[:seen]
            top = best_of(scores, ids[ranked], k) if exact else np.array(sorted(range(seen), key=lambda i: (-scores[i], ids[ranked[i]]))[:k], int)
            all_ids.append(ids[ranked[top]])
            all_scores.append(np.array([max(-LONG - 1, min(LONG, int(s))) for s in scores[top]], np.int64))
        return result(asked["vec_id"], [zlib.crc32(q.tobytes()) for q in wanted], all_ids, all_scores)

    return search(queries, indexed.select("vec_id", "dim", "v", "to_pivots"), ["v", "to_pivots"], find, k, "long", query_block, row_block)
