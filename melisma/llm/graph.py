"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): root is the least node of the component. edges: u, v (bigint); nodes without edges are absent.

    Alternates large stars (every greater neighbour is tied to a node's least neighbour) and small stars
    (every lesser neighbour is). Both keep components, and need a number of rounds of the order of the logarithm of the
    number of nodes. A node's neighbours are never gathered: only their least is, with map-side combining.
    """
    edges = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        small = stage(small, "small-stars")
        # done when every node is tied once, to a root that is not tied itself
        chained = small.join(small.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if chained.unionByName(small.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")).isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = small
    raise RuntimeError(f"components did not settle in {rounds} rounds")
