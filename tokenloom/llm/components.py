"""Connected components of an edge table by alternating star contraction.

Large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond") hook every node to the smallest neighbour until the
graph is a set of stars.  Minima are partially aggregated and written, and
joined back by a shuffle join whose hot keys AQE may split, so a centre with
very many neighbours never meets in one task.  Every round is a written table;
nothing but one count per round reaches the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of longs -> (node, root): root is the smallest node of the
    component.  Only nodes with an edge to another node appear."""
    pairs = scratch.keep(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                         .filter("hi > lo").distinct())
    total = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        both = pairs.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(
            pairs.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        low = scratch.keep(both.groupBy("n").agg(F.min("m").alias("x"))
                           .select(F.col("n").alias("_n"), F.least("n", "x").alias("x")))
        large = scratch.keep(both.join(low, F.col("n") == F.col("_n")).filter("m > n and m > x")
                             .select(F.col("m").alias("hi"), F.col("x").alias("lo")).distinct())
        # small star: a node and its smaller neighbours move to the smallest of them
        low2 = scratch.keep(large.groupBy("hi").agg(F.min("lo").alias("x")).select(F.col("hi").alias("_n"), "x"))
        joined = large.join(low2, F.col("hi") == F.col("_n"))
        newer = scratch.keep(joined.select(F.col("lo").alias("hi"), F.col("x").alias("lo")).filter("hi > lo")
                             .unionByName(low2.select(F.col("_n").alias("hi"), F.col("x").alias("lo"))).distinct())
        # stars: a fixed point of both steps has the same edges as before
        now = newer.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        for old in (pairs, low, large, low2):
            scratch.drop(old)
        pairs = newer
        if now == total or now[0] == 0:
            break
        total = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
