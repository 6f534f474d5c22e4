"""Small Spark helpers of the subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.shared import shared_folder


def checkpoint(df: DataFrame) -> DataFrame:
    """df with its lineage cut, stored in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of edges(a, b), both bigint; label is the least node of the connected component.

    Alternating large-star and small-star steps: each is an aggregation and a join, and the number of rounds grows with the
    logarithm of the longest path, not with the size of a component.
    """
    both = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = checkpoint(both), None
    while True:
        near = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        now = checkpoint(small)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == mark:
            break
        mark = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
