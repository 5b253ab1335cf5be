"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stage

MAX_ROUNDS = 60


def _both_ways(edges):
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of itself and its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (near.where("v > u").join(least, "u").where("v <> m")
            .select(F.col("m").alias("u"), "v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("m").alias("u"), "v")
    return moved.unionByName(least.select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) of every node with an edge to another; component is the least node.

    ``edges`` has long columns u and v; loops, repeats and either direction are fine. Each round is
    written to the shared folder, so its lineage is cut and lost executors cost one round. Ends when
    every edge points from a centre to a node with no other edge, and raises after ``max_rounds``.
    """
    now = stage(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        now = stage(small_star(large_star(now)), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            centre = now.select(F.col("u").alias("component")).distinct()
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
                centre.select(F.col("component").alias("node"), "component"))
        seen = mark
    raise RuntimeError(f"components still change after {max_rounds} rounds")
