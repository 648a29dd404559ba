"""Connected components of a graph given as a table of edges, by large-star and small-star steps.

Every step keeps connectivity and replaces neighbours by smaller ones; both are joins and minima by node, so a hub's
edges are pre-aggregated and its join can be split. Each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MOST_ROUNDS = 60


def _toward_minimum(directed: DataFrame) -> DataFrame:
    """(v, m) for every directed edge u -> v, m being the smallest of u and the nodes it points to; no loops, no repeats."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = directed.join(least, "u").select("v", "m").union(least.select(F.col("u").alias("v"), "m"))
    return moved.where("v <> m").distinct().select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges(u, v); nodes are longs, loops and repeats don't matter.

    Nulls take no part. An empty table of edges gives no components.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: the larger neighbours of a node go to the smallest of its neighbourhood
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of a node, and the node, go to the smallest of them
        after = written(_toward_minimum(large), "edges")
        mark = after.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        now = after
        if tuple(mark) == before:
            break
        before = tuple(mark)
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
