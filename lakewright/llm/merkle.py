"""Merkle manifest of a table: one root, and for every row the siblings that prove it.

Slot pivot: the children of one parent are spread into `FANOUT` columns by conditional
aggregates. The columns put together give the parent's digest; without the row's own slot
they are its siblings. Rows lie by (group, block of positions), so the levels inside a block need
one shuffle and one sort for all: a position's digits to the base FANOUT are the sort keys, and each
level groups by a prefix of them. Blocks' own nodes are a new, far smaller table of leaves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewright.llm.common import pin

FANOUT = 3
#: Levels of a block, which holds FANOUT ** LEVELS nodes.
LEVELS = 6
BLOCK = FANOUT**LEVELS
STEP = "struct<before:string,after:string>"


def digest_of(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value as a leaf has it: its UTF-8 byte count, a colon, itself; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest_of(F.concat(*[field(v) for v in values]))


def position(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """`nodes` with `pos`, from 0 within `g` by `order`, and `n`, the number of nodes of `g`.

    A range sort over the cluster gives each part's rows in order; parts and groups, one
    row for each meeting of the two, tell how many rows come before. Equal rows are told
    apart by their place in the input, so a large number of them is split too.
    """
    keys = ["g", *order, "_tie"]
    rows = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    rows = pin(rows.drop("_tie"), "merkle-sorted")
    runs = rows.groupBy("g", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_held"))
    whole = Window.partitionBy("g")
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_held").over(earlier), F.lit(0))
    runs = runs.select("g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_held").over(whole).alias("n"))
    return rows.join(runs, ["g", "_part"]).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def climb(nodes: DataFrame) -> DataFrame:
    """`nodes` (g, pos, n, digest and others) with `block`, `top`, `top_n` and `steps`.

    `top` is the digest of the node's ancestor LEVELS higher, or of the root of `g` where that
    is lower; `top_n` counts the nodes of `g` there. A step holds the siblings before and
    behind the node's ancestor at one level.
    """
    digits = [f"_d{k}" for k in range(LEVELS)]
    rows = nodes.withColumns(
        {
            "block": F.expr(f"pos div {BLOCK}"),
            "top": F.col("digest"),
            "top_n": F.col("n"),
            "steps": F.array().cast(f"array<{STEP}>"),
            **{d: F.expr(f"pos div {FANOUT**k} % {FANOUT}") for k, d in enumerate(digits)},
        }
    ).repartition("g", "block")
    for k, digit in enumerate(digits):
        parent = Window.partitionBy("g", "block", *reversed(digits[k + 1 :]))
        own = F.col(digit)
        slots = {f"_c{j}": F.max(F.when(own == j, F.col("top"))).over(parent) for j in range(FANOUT)}
        rows = rows.withColumns(slots)
        before = F.concat_ws("", *[F.when(own > j, F.col(c)) for j, c in enumerate(slots)])
        after = F.concat_ws("", *[F.when(own < j, F.col(c)) for j, c in enumerate(slots)])
        step = F.array(F.struct(before.alias("before"), after.alias("after")))
        more = F.col("top_n") > 1
        rows = rows.withColumns(
            {
                "steps": F.when(more, F.concat("steps", step)).otherwise(F.col("steps")),
                "top": F.when(more, digest_of(F.concat_ws("", *slots))).otherwise(F.col("top")),
                "top_n": F.when(more, F.expr(f"(top_n + {FANOUT - 1}) div {FANOUT}")).otherwise(F.col("top_n")),
            }
        )
    return rows.drop(*digits, *[f"_c{j}" for j in range(FANOUT)])


def ascend(nodes: DataFrame) -> list[DataFrame]:
    """`nodes`, the tops of their blocks, the tops of those, up to one node for each `g`."""
    tables = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        tops = climb(tables[-1]).where(F.col("pos") % BLOCK == 0)
        tops = tops.select("g", F.col("block").alias("pos"), F.col("top_n").alias("n"), F.col("top").alias("digest"))
        tables.append(pin(tops, f"merkle-{len(tables)}"))
        most = -(-most // BLOCK)
    return tables


def descend(tables: list[DataFrame]) -> DataFrame:
    """The first table with `root`, the digest of its `g`, and `path`, all steps up to it."""
    above = tables[-1].withColumn("root", F.col("digest")).withColumn("path", F.array().cast(f"array<{STEP}>"))
    for nodes in reversed(tables[:-1]):
        over = above.select("g", F.col("pos").alias("block"), "root", F.col("path").alias("_upper"))
        rows = climb(nodes).drop("top", "top_n").join(over, ["g", "block"])
        above = rows.withColumn("path", F.concat("steps", "_upper")).drop("steps", "_upper", "block")
    return above


@dataclass(frozen=True)
class Manifest:
    """`leaves`: the columns to keep, `leaf`, `subroot`, `root` and `path`, one row for each row
    of the table; `subroots`: group, number of rows `n`, digest."""

    leaves: DataFrame
    subroots: DataFrame


def manifest(
    rows: DataFrame, values: Sequence[Column], group: Column, key: Column, keep: dict[str, Column]
) -> Manifest:
    """A tree for each value of `group` over its rows by ascending `key`, and one over these trees.

    A leaf is the digest of `values`; `keep` names what the result carries besides. While several
    nodes remain, each FANOUT consecutive ones become their digest, the last run being what is
    left, even one node; a lone leaf is its own root. Groups go by UTF-8 bytes, null, a
    group of its own, first. Keys ascend, null first; equal keys go by leaf, so that only equal
    leaves tie and the digests never depend on the layout. Empty strings differ from
    nulls. An empty table gives empty tables. Columns not named are not read.
    """
    named = {f"k{i}": column for i, column in enumerate(keep.values())}
    nodes = rows.select(
        F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit("")).alias("g"),
        key.alias("_key"),
        leaf(values).alias("digest"),
        *[column.alias(name) for name, column in named.items()],
    )
    nodes = position(pin(nodes, "merkle-leaves"), ["_key", "digest"]).drop("_key")
    trees = ascend(nodes)
    tops = trees[-1].select(F.lit("").alias("g"), F.col("g").alias("_group"), "digest")
    forest = descend(ascend(position(tops, ["_group"])))
    forest = pin(forest.select(F.col("_group").alias("g"), F.col("root").alias("_root"), F.col("path").alias("_last")), "merkle-roots")
    proved = descend(trees).withColumnRenamed("root", "subroot").join(forest, "g")
    kept = [F.col(inner).alias(name) for inner, name in zip(named, keep)]
    leaves = proved.select(
        *kept, F.col("digest").alias("leaf"), "subroot", F.col("_root").alias("root"), F.concat("path", "_last").alias("path")
    )
    sizes = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("g") != "", F.substring("g", 2, 2**31 - 1)).alias("group")
    return Manifest(leaves, trees[-1].select("g", "digest").join(sizes, "g").select(name, "n", "digest"))


def proof(path: Column) -> Column:
    """The siblings of a path put together, level by level and left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and the siblings of its path lead to."""
    return F.aggregate(path, digest, lambda held, s: digest_of(F.concat(s["before"], held, s["after"])))
