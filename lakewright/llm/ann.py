"""Approximate nearest neighbours by collision counting over query-centred windows.

Largest inner product is made nearest distance: rows are scaled by the longest row and
get one more component that makes all of them unit vectors; queries are scaled to one
and get 0 there. Each of `projections` random directions keeps the rows of a block as one
sorted array. A query opens a window around its own place in each array; a row inside
collides. Virtual rehashing widens the windows step by step, and only what a step adds
is counted. Rows with enough collisions are verified by their exact inner product, until
k verified rows lie within the radius that the windows stand for, or all rows are verified.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.llm.vectors import best_of, matrix, result, search, usable


@dataclass(frozen=True)
class Hashing:
    """Directions, the share of them that must collide, first radius and its growth."""

    projections: int = 64
    share: float = 0.55
    radius: float = 0.9
    growth: float = 1.12
    seed: int = 7
    query_block: int = 512
    row_block: int = 16_384


class SortedArrays:
    """The sorted arrays of one block."""

    def __init__(self, places: np.ndarray):
        self.order = np.ascontiguousarray(np.argsort(places, axis=0, kind="stable").T)
        self.values = np.ascontiguousarray(np.sort(places, axis=0).T)
        self.rows = len(places)

    def windows(self, queries: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the windows of all queries, by query, radius and array."""
        low = np.empty((len(queries), len(radii), len(self.values)), np.int64)
        high = np.empty_like(low)
        for j, values in enumerate(self.values):
            low[:, :, j] = np.searchsorted(values, queries[:, j, None] - radii, "left")
            high[:, :, j] = np.searchsorted(values, queries[:, j, None] + radii, "right")
        return low, high

    def rings(self, low: np.ndarray, high: np.ndarray):
        """For one query, at each radius how often each row newly collides."""
        inner_low, inner_high = low[0], low[0]
        for a, b in zip(low, high):
            parts = [o[x:y] for o, x, y in zip(self.order, a, inner_low)]
            parts += [o[x:y] for o, x, y in zip(self.order, inner_high, b)]
            yield np.bincount(np.concatenate(parts), minlength=self.rows)
            inner_low, inner_high = a, b


def radii_of(hashing: Hashing) -> np.ndarray:
    """The radii of the windows; unit vectors are at most 2 apart, so the last, without
    end, is rarely reached."""
    steps = int(np.ceil(np.log(2.5 / hashing.radius) / np.log(hashing.growth)))
    return np.append(hashing.radius * hashing.growth ** np.arange(steps), np.inf)


def nearest(rows: DataFrame, is_query: Column, k: int = 20, hashing: Hashing = Hashing()) -> DataFrame:
    """query_id, rank from 1, vec_id, score: about the k largest inner products.

    `rows` has vec_id and embedding (array of numbers); queries are the rows for which
    `is_query` holds. A query's candidates are all rows with another vec_id and as many
    components; with k or fewer of them all are returned. Ties go to the smaller vec_id.
    Vectors that are null, zero, empty or hold null or non-finite components take no part,
    nor do rows without vec_id. A repeated row is a candidate each time; a repeated
    query is answered once. Other columns are not read. An empty table gives no rows.
    """
    vector = F.col("embedding").cast("array<double>")
    clean = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v"), is_query.alias("asked"))
    clean = clean.where(usable(F.col("v"), zero=False) & F.col("vec_id").isNotNull())
    clean = clean.withColumn("dim", F.size("v"))
    longest = clean.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("n")).first().n
    if longest is None:
        longest = 1.0
    queries = clean.where(F.coalesce("asked", F.lit(False))).select("vec_id", "dim", "v").distinct()

    def find(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        own, ids = matrix(held["v"]), held["vec_id"].to_numpy()
        wanted = matrix(asked["v"])
        scaled = own / np.sqrt(longest)
        extra = np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1)))
        lengths = np.sqrt((wanted**2).sum(axis=1))
        directions = np.random.default_rng(hashing.seed).standard_normal((own.shape[1] + 1, hashing.projections))
        arrays = SortedArrays(np.column_stack([scaled, extra]) @ directions)
        places = (wanted / lengths[:, None]) @ directions[:-1]
        need = int(np.ceil(hashing.share * hashing.projections))
        radii = radii_of(hashing)
        low, high = arrays.windows(places, radii)
        # Products of whole batches are exact up to rounding; the best are worked out once more.
        slack = 1e-9 * longest
        all_ids, all_scores = [], []
        for number, (query_id, q, length) in enumerate(zip(asked["vec_id"].to_numpy(), wanted, lengths)):
            count = np.zeros(len(ids), np.int64)
            open_rows = ids != query_id
            score = np.full(len(ids), -np.inf)
            left = int(open_rows.sum())
            for radius, more in zip(radii, arrays.rings(low[number], high[number])):
                count += more
                new = np.flatnonzero((count >= need) & open_rows)
                if len(new):
                    score[new] = own[new] @ q
                    open_rows[new] = False
                    left -= len(new)
                if left == 0:
                    break
                if len(ids) - left > k:
                    kth = np.partition(score, len(score) - k)[len(score) - k]
                    if 2.0 - 2.0 * kth / (length * np.sqrt(longest)) <= radius**2:
                        break
            seen = np.flatnonzero(np.isfinite(score))
            if len(seen) > k:
                kth = np.partition(score[seen], len(seen) - k)[len(seen) - k]
                seen = seen[score[seen] >= kth - slack]
            exact = (own[seen] * q).sum(axis=1)
            top = best_of(exact, ids[seen], k)
            all_ids.append(ids[seen[top]])
            all_scores.append(exact[top])
        keys = [zlib.crc32(q.tobytes()) for q in wanted]
        return result(asked["vec_id"], keys, all_ids, all_scores)

    return search(queries, clean.select("vec_id", "dim", "v"), ["v"], find, k, "double", hashing.query_block, hashing.row_block)
