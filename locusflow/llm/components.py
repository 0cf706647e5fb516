"""Connected components of a table of edges, by hash-to-minimum with shortcuts; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; the root is the component's smallest node.

    Alternates large-star and small-star rounds: neighbours of a node are linked to
    the smallest of them.  Each round groups by node with a partial minimum first.
    Loops and repeated edges are harmless; no edges give an empty table.
    """
    at = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    for _ in range(most_rounds):
        # large star: the larger neighbours of u go to the smallest node around u
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first: a join of two tables is one whose hot keys Spark splits
        low = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low")))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()
        large = scratch.save(large)
        # small star: the smaller neighbours of u, and u, go to the smallest of them
        scratch.drop(low)
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("low")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v"))).filter("u <> v").distinct()
        small = scratch.save(small)
        n, same = small.count(), small.intersect(at).count()
        scratch.drop(at, large, low)
        at = small
        if n == same and at.select("v").intersect(at.select("u")).isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
