"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source has the same expected number of copies, target / size of
the source. Its whole part is taken outright; the fraction is an inclusion
probability. The flight phase moves these probabilities along the null space of two
constraints, the number of documents and their tokens, until each is 0 or 1 or too
few are left to move. Documents are dealt to blocks of one source, so a source of any
size is spread; a block leaves a few undecided documents, large ones and some of all
sizes, which meet in the next level. The last level lands: every choice for the few
largest documents is tried, the probabilities of the others make up for what is
missing, and the last of these land likewise.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.llm.common import WORD, free_name, pin, text_or_empty

BLOCK_ROWS = 4096
LANDING = 16
#: Equal rows numbered by one task; a number of that many is one element of a second series.
LOT = 1 << 16
NEAR = 1e-9


def count_words(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), repeat: float = 3.0) -> DataFrame:
    """Adds `target` to one row per source with `source` and `source_size`.

    Sources in code-point order, null last, take the weights in turn. They share the sum
    of all sizes by weight; none gets more than `repeat` times its size, and what is
    over goes to the others by weight. That is target = min(repeat * size, level *
    weight), with the level at which the targets add up to the sum. No source: no row.

    The windows run in one task over one row per source, not over documents.
    """
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", "_place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(repeat))
    return (
        sizes.select("source", "source_size")
        .withColumn("_place", F.row_number().over(order))
        .withColumn("_weight", weight)
        .withColumn("_ratio", cap / F.col("_weight"))
        .withColumn("_rest", F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_rest") / F.sum("_weight").over(after))
        .withColumn("_level", F.max("_level").over(everything))
        .withColumn("target", F.least(cap, F.coalesce("_level", F.lit(0.0)) * F.col("_weight")))
        .select("source", "source_size", "target")
    )


def _step(p: list[float], s: list[float], pick: random.Random) -> None:
    """Moves the probabilities of three units (or two) until one of them is 0 or 1."""
    if len(p) == 3:
        u = [s[2] - s[1], s[0] - s[2], s[1] - s[0]]
        if not any(u):
            u = [1.0, -1.0, 0.0]
    else:
        u = [1.0, -1.0]
    up = min((1 - a) / b if b > 0 else a / -b for a, b in zip(p, u) if b)
    down = min(a / b if b > 0 else (1 - a) / -b for a, b in zip(p, u) if b)
    move = up if pick.random() * (up + down) < down else -down
    for i, b in enumerate(u):
        p[i] += move * b
        if p[i] < NEAR or p[i] > 1 - NEAR:
            p[i] = float(p[i] > 0.5)


def _spared(units: list[int], size: np.ndarray, count: int) -> set[int]:
    """`count` of the units: half of them the largest, the others evenly spread below."""
    by_size = sorted(units, key=lambda i: -size[i])
    large, spread = by_size[: count - count // 2], count // 2
    rest = by_size[len(large) :]
    return {*large, *(rest[j * len(rest) // spread] for j in range(spread))}


def flight(prob: np.ndarray, size: np.ndarray, seed: int, left: int = LANDING) -> np.ndarray:
    """Probabilities after the flight phase: all 0 or 1 but for `left` units at most.

    Both the sum of the probabilities and the expected tokens stay as they were, up to
    rounding. Units of the largest sizes, and as many of all sizes below, take no part and
    stay open: a landing with small units alone could not make up for one large unit.
    Empty input gives empty output.
    """
    prob = prob.astype(float).copy()
    prob[prob < NEAR] = 0.0
    prob[prob > 1 - NEAR] = 1.0
    pick = random.Random(seed)
    open_units = [int(i) for i in np.flatnonzero((prob > 0) & (prob < 1))]
    if len(open_units) <= left:
        return prob
    spared = _spared(open_units, size, max(0, left - 2))
    held: list[int] = []
    waiting = iter(i for i in open_units if i not in spared)
    remaining = len(open_units) - len(spared)
    while remaining > 2:
        while len(held) < 3:
            held.append(next(waiting))
        p = [prob[i] for i in held]
        _step(p, [float(size[i]) for i in held], pick)
        for i, value in zip(held, p):
            prob[i] = value
        kept = [i for i in held if 0.0 < prob[i] < 1.0]
        remaining -= len(held) - len(kept)
        held = kept
    return prob


def land(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rounds the few open units: of all choices the one nearest to the expected tokens,
    then to the expected number of documents, then the first in binary order."""
    prob = prob.copy()
    rest = np.flatnonzero((prob > 0) & (prob < 1))
    if len(rest) == 0:
        return prob
    choice = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest))) & 1
    tokens = np.abs(choice @ size[rest] - prob[rest] @ size[rest])
    count = np.abs(choice.sum(axis=1) - prob[rest].sum())
    prob[rest] = choice[np.lexsort((count, tokens))[0]]
    return prob


def _shifted(prob: np.ndarray, size: np.ndarray, gap: float) -> np.ndarray:
    """Probabilities moved together until the expected tokens have grown by `gap`, or as far
    as they can within 0 and 1. Unchanged without a gap."""
    if not len(prob) or abs(gap) < NEAR:
        return prob
    want, low, high = prob @ size + gap, -1.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if np.clip(prob + middle, 0, 1) @ size < want else (low, middle)
    return np.clip(prob + high, 0.0, 1.0)


def settle(prob: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """The flight and landing that decide all units of a source.

    The largest land first, and the probabilities of the others make up for the tokens that
    this adds or takes; then the others fly and land. Empty input gives empty output.
    """
    prob = flight(prob, size, seed, len(prob))
    rest = np.flatnonzero((prob > 0) & (prob < 1))
    by_size = rest[np.argsort(-size[rest], kind="stable")]
    large, others = by_size[: LANDING - 2], by_size[LANDING - 2 :]
    expected = prob[large] @ size[large]
    prob[large] = land(prob[large], size[large])
    moved = _shifted(prob[others], size[others], expected - prob[large] @ size[large])
    prob[others] = land(flight(moved, size[others], seed), size[others])
    return prob


def _fly(pdf: pd.DataFrame, final: bool) -> pd.DataFrame:
    """One block; that of a source without others waits for the final level."""
    if not final and pdf["_blocks"].iloc[0] == 1:
        return pdf
    pdf = pdf.sort_values(["_key", "size"], kind="stable").reset_index(drop=True)
    seed = int(pdf["_key"].iloc[0]) & 0xFFFFFFFF
    order = np.random.default_rng(seed).permutation(len(pdf))
    prob, size = pdf["_p"].to_numpy()[order], pdf["size"].to_numpy()[order]
    back = np.empty(len(pdf))
    back[order] = settle(prob, size, seed) if final else flight(prob, size, seed)
    pdf["_p"] = back
    return pdf


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    repeat: float = 3.0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """How often each document is taken: doc_id, source, text_key, size, source_size,
    target, copies, taken, one row per input row.

    `docs` needs doc_id, text and source; other columns are not read. A null text has
    size 0, a null source is a source of its own, a null doc_id is a document like any
    other. Repeated rows are separate documents. A document of a source without words
    gets target 0 and no copies. The result depends on the rows alone, not on
    their layout: blocks and seeds come from hashes of doc_id and text.
    An empty table gives an empty result.
    """
    sized = docs.select(
        F.col("doc_id"),
        F.col("source"),
        F.xxhash64("text").alias("text_key"),
        count_words(text_or_empty()).alias("size"),
    )
    # Equal rows are counted before the shuffle and then numbered, so that each is a unit with a
    # key of its own and copies of one row are spread over the blocks.
    equal = sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("_equal"))
    lots = equal.select("*", F.explode(F.expr(f"sequence(0L, (_equal - 1) div {LOT})")).alias("_lot"))
    numbers = F.explode(F.expr(f"sequence(_lot * {LOT}, least(_equal, (_lot + 1) * {LOT}) - 1)")).alias("_number")
    rows = lots.select(*sized.columns, numbers)
    rows = pin(rows.select(*sized.columns, F.xxhash64("doc_id", "text_key", "_number").alias("_key")), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sources = pin(sources, "mix-sources")
    targets = source_targets(sources, weights, repeat).withColumnRenamed("source", "_source")
    counts = sources.select(F.col("source").alias("_counted"), "_rows")
    plan = pin(
        targets.join(counts, F.col("_source").eqNullSafe(F.col("_counted"))).drop("_counted"), "mix-targets"
    )
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    units = (
        rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_ratio", ratio)
        .withColumn("_whole", F.floor(F.col("_ratio") + NEAR))
        .withColumn("_p", F.greatest(F.col("_ratio") - F.col("_whole"), F.lit(0.0)))
        .withColumn("_blocks", F.ceil(F.col("_rows") / F.lit(block_rows)))
        .drop("_ratio", "_rows", "_source")
    )
    level, done = 0, []
    while True:
        block = F.pmod(F.xxhash64("_key", F.lit(level)), F.col("_blocks"))
        units = units.withColumn("_block", block)
        flown = pin(
            units.groupBy("source", "_block").applyInPandas(lambda pdf: _fly(pdf, False), units.schema),
            f"mix-flight-{level}",
        )
        decided = F.col("_p").isin(0.0, 1.0)
        done.append(flown.where(decided))
        rest = flown.where(~decided)
        counts = rest.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
        most = counts.agg(F.max("_n").alias("n")).first().n or 0
        if most <= block_rows:
            break
        counts = counts.select(F.col("source").alias("_counted"), F.ceil(F.col("_n") / F.lit(block_rows)).alias("_blocks"))
        units = rest.drop("_block", "_blocks").join(counts, F.col("source").eqNullSafe(F.col("_counted"))).drop("_counted")
        units = units.select(*[c for c in flown.columns if c != "_block"])
        level += 1
    done.append(rest.groupBy("source").applyInPandas(lambda pdf: _fly(pdf, True), rest.schema))
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    copies = (F.col("_whole") + F.col("_p")).cast("long")
    return result.withColumn("copies", copies).select(
        "doc_id", "source", "text_key", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of `docs`, each as often as `mixed` takes it.

    Rows are found by doc_id and text. Rows equal in both share the copies that the mix
    gives them together: as many each, and one more for the first of them by their other
    columns. A null text is a text like any other, a null doc_id an id. An empty table gives
    no rows. Other columns stay as they are.
    """
    own, text, copies, rows = (free_name(docs, name) for name in ("_id", "_text", "_copies", "_rows"))
    chosen = mixed.groupBy(F.col("doc_id").alias(own), F.col("text_key").alias(text))
    chosen = chosen.agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows)).where(F.col(copies) > 0)
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(text))
    single = docs.join(chosen.where(F.col(rows) == 1), same)
    taken = _repeated(single, docs.columns, F.col(copies))
    repeated = pin(chosen.where(F.col(rows) > 1), "mix-repeated")
    if repeated.isEmpty():
        return taken
    # Equal rows are counted before the shuffle; the window orders what differs, a row each.
    equal, before = free_name(docs, "_equal"), free_name(docs, "_before")
    parts = docs.join(repeated, same).groupBy(*docs.columns, own, text, copies, rows).agg(F.count(F.lit(1)).alias(equal))
    order = Window.partitionBy(own, text).orderBy(F.xxhash64(*docs.columns), *docs.columns)
    parts = parts.withColumn(before, F.sum(equal).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(equal))
    over = F.greatest(F.lit(0), F.least(F.col(equal), F.col(copies) % F.col(rows) - F.col(before)))
    number = F.col(equal) * F.floor(F.col(copies) / F.col(rows)) + over
    return taken.unionByName(_repeated(parts.where(number > 0), docs.columns, number))


def _repeated(df: DataFrame, columns: list[str], number: Column) -> DataFrame:
    """`columns` of the rows, each `number` times; `number` is at least 1."""
    lots, lot, copy = (free_name(df, name) for name in ("_n", "_lot", "_copy"))
    most = F.lit(LOT)
    each = df.withColumn(lots, number.cast("long"))
    each = each.select(*columns, lots, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(lots) - 1) / most))).alias(lot))
    left = F.least(most, F.col(lots) - F.col(lot) * most).cast("int")
    return each.select(*columns, F.explode(F.sequence(F.lit(1), left)).alias(copy)).drop(copy)
