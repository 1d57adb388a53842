"""Connected components of an edge table by alternating stars.

Large-star links every larger neighbour of a node to the node's smallest
neighbour; small-star does the same for the smaller ones. Both keep the
components and shrink the edges towards one star per component, in a number
of rounds that grows with the logarithm of the longest path. A node's minimum
is a pre-aggregated value, so a node with many edges is no hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.llm.common import written


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """``edges``: distinct (u, v) with u > v."""
    if larger:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        kept = edges.join(low, "u")
        out = (kept.select(F.col("v").alias("u"), F.col("m").alias("v"))
               .union(low.select("u", F.col("m").alias("v"))))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its
    smallest node. An empty edge table gives an empty result."""
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(),
                  "components")
    state = None
    for _ in range(max_rounds):
        now = written(_star(_star(now, True), False), "components")
        # the same number of edges with the same sums twice: nothing moved
        seen = now.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")),
                       F.sum(F.col("v").cast("decimal(38,0)")),
                       F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state:
            nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return nodes.union(roots)
        state = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
