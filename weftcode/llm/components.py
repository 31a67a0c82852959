"""Connected components by alternating stars.

Each round is two aggregations and joins over the edges; edges end as stars whose
centre is the smallest node of the component. A node with many edges is aggregated on the map side into a
written table; in the join with that table its rows may be split, so no task gathers a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, component) of each node of the edges (a, b); component is its smallest node."""
    now = ws.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = checksum(now)
    while True:
        large = ws.table(large_star(now, ws), "large-stars")
        ws.drop(now)
        after = ws.table(small_star(large, ws), "stars")
        ws.drop(large)
        new = checksum(after)
        now = after
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def large_star(edges: DataFrame, ws: Workspace) -> DataFrame:
    """Each node's larger neighbours move to the smallest of it and its neighbours."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    low = ws.table(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("low")), "low")
    return both.filter("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("low").alias("v")).distinct()


def small_star(edges: DataFrame, ws: Workspace) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest neighbour."""
    low = ws.table(edges.groupBy("u").agg(F.min("v").alias("low")), "low")
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v")
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    return row[0], row[1]
