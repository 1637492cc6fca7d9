"""Connected components of a link table by alternating star operations.

Each round rewrites the links: large-star points every larger neighbour of a node at
the least label near it, small-star does so for the smaller ones. The links left in
the end are stars whose centres are the least members. Rounds grow with the logarithm
of the longest chain; links never grow in number. Labels are least values by
partial aggregation and the rewriting is a join with the stored labels, so a node with very
many links is never gathered in a task (adaptive execution splits a heavy join key). Each
step is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimlens.llm._spark import stored


def components(links: DataFrame) -> DataFrame:
    """(node, least) for every node of ``links`` (a, b): ``least`` is the smallest node
    reachable. Nodes may be any ordered type; loops and repeated links don't matter."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    known, count = None, edges.count()
    while True:
        # large star: with m the least of a node and its neighbours, larger neighbours go to m
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "links_near", 2 * count)
        large = (both.where("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        # small star: smaller neighbours and the node itself go to the least of them
        large = stored(large, "links_large", 2 * count)
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "links_low", 2 * count)
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        edges = stored(small, "links", 2 * count)     # a round makes at most two of each link
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if known == (state["n"], state["s"]):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("least")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct())
        known, count = (state["n"], state["s"]), state["n"]
