"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges (u, v)``; the root is the component's smallest node.

    Alternating large-star and small-star rounds: each hangs neighbours on the smallest node seen so far, which keeps the
    number of edges from growing and ends in one star for each component after about a logarithm of its size. Minima are
    combined on the map side and joined back, so that no task gathers a node's neighbours. Every round is checkpointed.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20)")).alias("h")).first()
        if state == (seen["n"], seen["h"]):
            break
        state = (seen["n"], seen["h"])
    root = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
