"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stage


def _stars(edges: DataFrame) -> bool:
    """Whether every edge leads from a node to the centre of its star: no node has two, and no centre has one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    torn = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
    return not torn.agg(F.count(F.lit(1))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every end of an edge ``(a, b)``; the component
    is its smallest node.

    Each round links the larger neighbours of a node, then the smaller ones,
    to the smallest it knows of. A node is a row per edge, never a list, so a
    hub takes partial aggregates and a join that adaptive execution can split.
    Rounds grow with the logarithm of the longest path; each is written to the
    shared space. They end when all edges are stars around the smallest node
    of each, which one aggregate tells.
    """
    edges = stage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    while not _stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        small = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
