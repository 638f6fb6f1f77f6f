"""Connected components of a distributed edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then the edges are final."""
    ends = edges.select(F.col("u").alias("n"), F.lit(True).alias("is_u"), "v").unionByName(edges.select(F.col("v").alias("n"), F.lit(False).alias("is_u"), F.lit(None).cast("long").alias("v")))
    odd = ends.groupBy("n").agg(F.max("is_u").alias("a"), F.min("is_u").alias("b"), F.min("v").alias("low"), F.max("v").alias("high"))
    return odd.where("(a and not b) or low <> high").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: u, v (long). node, root (the smallest node of its component) for every node with an edge to another.

    Only minima are aggregated (partially, before the shuffle) and only edges are joined; no neighbourhood is ever
    gathered. Each round is written to the shared folder, so lost executors cost no more than a round. It ends when all edges form
    stars, which is checked exactly.
    """
    big, small = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = materialise(edges.where("u <> v").select(big, small).distinct())
    most = now.count()  # edges never become more
    for _ in range(most_rounds):
        if _stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        # large star: each larger neighbour of a node joins the node's least neighbour
        large = now.join(least, F.col("v") == F.col("n")).select("u", F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours join the least of these
        first = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        moved = large.join(first, F.col("u") == F.col("n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(first.select(F.col("n").alias("u"), F.col("m").alias("v")).unionByName(moved).distinct(), most)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.unionByName(out.select(F.col("root").alias("node"), "root").distinct())
