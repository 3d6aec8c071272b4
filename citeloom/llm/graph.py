"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star hangs larger neighbours on the least of a node's neighbourhood, small star the others."""
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    hung = around.join(least, "a")
    if large:  # repeated edges are dropped by the small star
        return hung.filter("b > a AND b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    out = hung.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge ``(a, b)``; a component is named by its least node.

    Each round is a written table, so a lost executor repeats one round at most. Nodes with very many edges
    appear as rows of joins that can be split, never as one list.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, before = cut_lineage(edges), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        before = now
        edges = cut_lineage(_star(cut_lineage(_star(edges, True)), False))
