"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, stage_table


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of edges(a, b), the least node of its component. Nodes without an edge are absent.

    Each round joins the edges with one row per node (the node's least neighbour) and removes repeats with map-side
    aggregation, so a node with very many neighbours is only ever split or summed. A round is written to the shared
    folder; only its count and a checksum reach the driver. Rounds grow with the logarithm of the longest chain.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stage_table(edges, "edges")
    seen, rows = None, edges.count()
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # Large star: every greater neighbour of a node goes to the least one.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node's lesser neighbours, and itself, go to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        # A round makes no more edges than two for each it was given.
        edges, done = stage_table(small.where("a <> b").distinct(), "edges", 2 * rows), edges
        drop_tables(done)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            break
        seen, rows = now, now["n"]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
