"""Connected components of a graph in two tables, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrain.llm.shared import forget, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: link the larger neighbours (or else the smaller ones and itself) of each node to its least neighbour.

    The least neighbours are written before they are joined, so that both sides of the join are plain
    scans: a node with very many edges can then be split by Spark's skew handling.
    """
    around = _both_ways(edges) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if large:
        around = written(around, "around")
    least = written(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    linked = around.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = written(out.where("u <> v").distinct(), "star")
    forget(least)
    if large:
        forget(around)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes that have an edge; component is the least node reachable.

    edges has long columns u and v, in either order, repeats allowed. Each round is a pair of star
    contractions over the whole edge table and its result is written to the shared folder; the number
    of rounds grows with the logarithm of the number of nodes.
    """
    current = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        large = _star(current, True)
        small = _star(large, False)
        forget(large)
        forget(current)
        current = small
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
