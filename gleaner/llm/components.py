"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import Scratch


def _state(edges: DataFrame) -> tuple:
    """Row count and content sum; equal states of two rounds mean that nothing moved any more."""
    sums = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), sums).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node that has an edge (columns u, v); root is the smallest node reachable.

    Large-star hands every larger neighbour of a node to the smallest one around it, small-star does so for
    the smaller ones; the number of edges never grows and after some log^2(n) rounds, in practice three to
    six, each component is a star around its smallest node. Each round is written to the shared folder, so a
    lost executor costs one round at most. Only a count and a sum come to the driver.
    """
    u, v = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = scratch.keep(edges.where("u != v").select(u, v).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(small.unionByName(smallest.withColumnRenamed("m", "v")).distinct())
        scratch.drop(now)
        before, now, state = state, after, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
