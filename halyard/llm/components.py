"""Connected components of an edge table, without gathering any of it.

Alternating large-star and small-star steps: each round every node points its neighbours at the
smallest node it knows, which shortens paths until all point at their component's smallest node.
Minima are pre-aggregated and saved, and meet the edges in plain equi-joins, so a node with very
many neighbours is split like any skewed join key.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm import cluster


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cluster.saved(both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("u2"), F.least("u", "w").alias("w")))
    joined = both.where("v > u").join(least, F.col("u") == F.col("u2"))
    return joined.select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cluster.saved(down.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("u2"), "w"))
    joined = down.join(least, F.col("u") == F.col("u2"))
    return joined.select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v").unionByName(least.select(F.col("u2").alias("u"), F.col("w").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each component of the edges (u, v), for every node
    that has an edge to another."""
    now = cluster.saved(edges.select("u", "v").where("u <> v").distinct())
    mark = F.bit_xor(F.xxhash64("u", "v"))
    before = None
    while True:
        now = cluster.saved(_small_star(_large_star(now)))
        state = now.agg(F.count(F.lit(1)), mark, F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first()
        if state == before or not state[0]:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
