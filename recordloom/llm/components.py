"""Connected components of an edge list, by alternating star steps that only aggregate and join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import cut, drop_old_shuffles, release


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: point neighbours at the least node of their star (larger ones, or smaller ones)."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .where("u <> v").distinct())
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u")
    return (tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct())


def connected(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the least node it reaches.

    Edges are undirected; loops, repeats and edges with a null end are ignored. Each step shrinks the
    paths to the root; it ends when a step changes nothing, after about log2 of the longest path.
    """
    now = cut(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        before, now = now, cut(_stars(_stars(now, True), False))
        release(before)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (seen["n"], seen["s"]) == mark:
            break
        mark = (seen["n"], seen["s"])
    drop_old_shuffles(now.sparkSession)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
