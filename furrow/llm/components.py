"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of node and neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(
        F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where(F.col("b") != F.col("m")).select(
        F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).where("a != b").distinct()


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots; root is the smallest node.

    Large and small stars by turns make every component a star around its smallest node. Each
    turn is one aggregation and one join over the edges, written to the shared folder; only a
    count and a checksum of the edges reach the driver.
    """
    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = materialize(edges.where("a != b").select("a", "b"), label)
    before = None
    while (now := state(edges)) != before:
        before = now
        edges = materialize(_small_star(materialize(_large_star(edges), label)), label)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
