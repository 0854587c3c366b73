"""Connected components by alternating star contraction; no link or component ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """Links (u, v) -> (id, component): for every id that has a link to another, the smallest id it reaches.

    Each round at least halves the depth of the trees; rounds end when all trees are stars.
    """
    edges = stage(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        edges = stage(_small_star(_large_star(edges)), "stars")
        more = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        roots = edges.select(F.col("v").alias("u")).distinct()
        if more.unionByName(roots.join(edges.select("u"), "u", "left_semi")).isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select(F.col("u").alias("id"), F.col("u").alias("component")))
