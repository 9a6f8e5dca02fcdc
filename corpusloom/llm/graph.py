"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import written


def contracted(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v), u > v."""
    both = e.union(e.select("v", "u")).toDF("x", "y")
    low = both.groupBy("x").agg(F.min("y").alias("m"))
    large = both.join(low, "x").where("y > x").select(F.col("y").alias("u"), F.least("x", "m").alias("v"))
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(low, "u")
    return moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(moved.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, component): the smallest id that each node reaches. Nodes without an edge to another aren't listed.

    Alternates large-star and small-star contraction: every node's larger neighbours move to its smallest neighbour, then
    its smaller ones do. The number of edges doesn't grow, a hub's work is one row per neighbour, and a logarithmic
    number of rounds suffices. Only a count and a checksum come to the driver. Self-loops and repeated edges are fine.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        seen = Observation()
        e = written(contracted(e).observe(seen, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")))
        if (seen.get["n"], seen.get["h"]) == state:
            break
        state = seen.get["n"], seen.get["h"]
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct()).distinct()
