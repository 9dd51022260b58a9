"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _to_smallest(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): every u's neighbours v and u itself, tied to the smallest of them (m)."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node in edges (u, v): component is the smallest node reachable.

    Each round ties neighbours to the smallest neighbour (large star), then smaller
    neighbours and the node itself to the smallest (small star); it ends when all
    edges are stars. No node's neighbours are gathered in one place: minima are
    aggregated before the shuffle and joined back, where AQE splits hot nodes.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        tied = _to_smallest(large)  # here every v is smaller than its u
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v")))
        after = cut(small.filter("u <> v").distinct())
        # Stars only: no smaller end of an edge is the larger end of another, and no node has two.
        done = after.groupBy("u").count().filter("count > 1").isEmpty() and after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        release(now)
        now = after
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
