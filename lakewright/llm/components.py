"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.common import pin


def connected_components(links: DataFrame) -> DataFrame:
    """`node`, `root` for every node of `links` (u long, v long); equal roots, equal component.

    Contraction in rounds: each node points at the neighbour, or itself, with the
    smallest hash; links are redrawn between the nodes pointed at, and repeated ones and
    loops go. A hash that differs by round makes the number of rounds grow with the
    logarithm of the longest chain. Nodes with very many links are met by aggregates
    with map-side combination and by plain joins, which Spark can split. Rows with a
    null end are no links. No links give no rows.
    """
    ends = links.select("u", "v").where("u <> v")
    edges = pin(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links-0")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        level = F.lit(len(steps))
        nearest = edges.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", level).alias("h"), "v")).alias("_best"))
        own = F.struct(F.xxhash64("u", level).alias("h"), F.col("u").alias("v"))
        step = pin(nearest.select("u", F.least(F.col("_best"), own)["v"].alias("p")), f"parents-{len(steps)}")
        steps.append(step)
        left = step.select(F.col("u").alias("_u"), F.col("p").alias("pu"))
        right = step.select(F.col("u").alias("_v"), F.col("p").alias("pv"))
        edges = edges.join(left, F.col("u") == F.col("_u")).select("v", "pu").join(right, F.col("v") == F.col("_v"))
        edges = edges.where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct()
        edges = pin(edges, f"links-{len(steps)}")
    if not steps:
        return ends.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    labels = steps[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for step in steps[1:]:
        labels = labels.join(step, F.col("root") == F.col("u"), "left")
        labels = labels.select("node", F.coalesce("p", "root").alias("root"))
    return labels
