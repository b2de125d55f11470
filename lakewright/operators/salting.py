"""Remedies for skewed keys: frequent keys by a sketch, salted joins, two-phase aggregates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 0.005
TASK_ROWS = 1_000_000
MOST_SALTS = 256
#: Room of the sketch for each key that it should tell.
TRACKED = 16


@dataclass(frozen=True)
class Frequent:
    """Hashes of frequent keys, at most 1 / share of them, and about the most rows that one has."""

    hashes: tuple[int, ...]
    most: int

    def holds(self, keys: Sequence[str]) -> Column:
        return F.xxhash64(*keys).isin(*self.hashes) if self.hashes else F.lit(False)

    def salts(self, task_rows: int) -> int:
        return max(1, min(MOST_SALTS, math.ceil(self.most / task_rows)))


def frequent_keys(df: DataFrame, keys: Sequence[str], share: float = SHARE) -> Frequent:
    """Keys with more than about `share` of all rows, by one pass that merges sketches of bounded size.

    Nulls are a key like any other. A key that the sketch misses, or one that shares its hash
    with a frequent one, costs time in what follows, never rows.
    """
    k = math.ceil(1 / share)
    hashes = df.select(F.xxhash64(*keys).alias("h"))
    row = hashes.agg(F.expr(f"approx_top_k(h, {k}, {k * TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    found = [(item["count"], item["item"]) for item in row.top or [] if item["count"] > share * row.n]
    return Frequent(tuple(h for _, h in found), max((c for c, _ in found), default=0))


def _free(name: str, *sides: DataFrame) -> str:
    taken = {c.lower() for side in sides for c in side.columns}
    while name.lower() in taken:
        name += "_"
    return name


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", share: float = SHARE, task_rows: int = TASK_ROWS
) -> DataFrame:
    """`left.join(right, keys, how)` with the rows of the left's frequent keys dealt to several tasks.

    A left row of a frequent key gets one of the salts by a hash of all its columns, so a task run
    again gives it the same one; the right rows of such keys are there once for each salt. All others have salt
    0. Exact for inner, left, left_semi and left_anti joins. Left rows that are equal in all columns
    stay together. The number of salts follows the most frequent key's rows, `task_rows` to a task.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how!r}")
    frequent = frequent_keys(left, keys, share)
    salts = frequent.salts(task_rows)
    if salts == 1:
        return left.join(right, list(keys), how)
    salt = _free("_salt", left, right)
    own = F.when(frequent.holds(keys), F.pmod(F.xxhash64(F.lit(5), *left.columns), F.lit(salts))).otherwise(F.lit(0).cast("long"))
    each = F.when(frequent.holds(keys), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    each = each.otherwise(F.array(F.lit(0).cast("long")))
    dealt = right.withColumn(salt, F.explode(each))
    return left.withColumn(salt, own).join(dealt, [*keys, salt], how).drop(salt)


PHASES = {
    "count": (F.count, F.sum),
    "sum": (F.sum, F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
}


def salted_aggregate(
    df: DataFrame, keys: Sequence[str], totals: Mapping[str, tuple[str, Column]], distinct: tuple[str, str] | None = None,
    salts: int = 32,
) -> DataFrame:
    """`groupBy(keys)` in two phases: by key and salt, then by key.

    `totals` gives a name to (`count`, `sum`, `min` or `max`, column). `distinct` is (name, column):
    the number of different values of a column, whose hash is the salt then, so a value
    lies under one salt and the second phase adds up counts. Sums keep the type of a plain sum of the column.
    """
    wrong = [kind for kind, _ in totals.values() if kind not in PHASES]
    if wrong:
        raise ValueError(f"unknown totals: {', '.join(wrong)}")
    salted = F.xxhash64(distinct[1]) if distinct else F.xxhash64(*df.columns)
    salt = _free("_salt", df)
    parts = {f"_t{n}": PHASES[kind][0](column) for n, (kind, column) in enumerate(totals.values())}
    first = df.withColumn(salt, F.pmod(salted, F.lit(salts))).groupBy(*keys, salt)
    counts = {"_distinct": F.count_distinct(distinct[1])} if distinct else {}
    partial = first.agg(*[c.alias(n) for n, c in (parts | counts).items()])
    ends = [PHASES[kind][1](F.col(f"_t{n}")).alias(name) for n, (name, (kind, _)) in enumerate(totals.items())]
    if distinct:
        ends.append(F.sum("_distinct").alias(distinct[0]))
    return partial.groupBy(*keys).agg(*ends)
