"""Connected components of a graph given as edges between longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u, v) with u > v.

    Large: each node points its larger neighbours to its smallest neighbour. Small: each node points its smaller
    neighbours and itself to the smallest of them.
    """
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = cut(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))  # a table, so that the join can split a node of many edges
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Alternating large and small stars until nothing changes.

    ``edges``: two long columns, in any direction, repeats and loops allowed. Returns ``node`` and ``root`` (the
    smallest node of its component) for each node that has an edge to another; no edges give no rows. The state
    is one table of edges per round, written in the shared folder; only two numbers a round reach the driver.
    """
    a, b = edges.columns
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        before = mark
        now = cut(_star(_star(now, True), False))
