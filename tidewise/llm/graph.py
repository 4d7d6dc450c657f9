"""Connected components of links between 64-bit ids, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.llm.common import look_up, saved

#: Rounds of contraction; their number grows with the logarithm of the longest path.
MAX_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """Of each ``u``: the smallest of it and its neighbours, and the number of edges."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node that has a link, and the smallest node of its component.

    Each round sends every larger neighbour of a node to the smallest neighbour, then
    does so for the smaller ones; each round's edges are a written table, and a node with very
    many edges is looked up by a bounded broadcast. Self-links are ignored.
    """
    edges = saved(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    before = None
    for _ in range(0 if edges.isEmpty() else MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (look_up(both, "u", saved(_least(both), "least"), "n", "large").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = saved(large, "large")
        least = saved(_least(large), "least")
        small = look_up(large, "u", least, "n", "small").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = saved(small, "edges")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        if not edges.isEmpty():
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
