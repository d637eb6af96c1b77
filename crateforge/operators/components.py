"""Connected components of an edge table by alternating star operations, each round staged in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateforge.sources.staging import discard, stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (itself included)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to its smallest neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select("m", F.explode(F.array("u", "v")).alias("v")).select(F.col("m").alias("u"), "v").where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node reachable.

    Self-links and repeats are fine, but a node with nothing but a self-link is not in the result; an empty edge table gives
    an empty result. A node's group is never collected: stars are joins with pre-aggregated minima.
    """
    spark = edges.sparkSession
    now, path = stage(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        new, new_path = stage(_small_star(_large_star(now)))
        same = new.count() == now.count() and new.join(now, ["u", "v"], "left_anti").isEmpty()
        discard(spark, path)
        now, path = new, new_path
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()
