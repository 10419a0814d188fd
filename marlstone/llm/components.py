"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


#: Edges of one vertex beyond which they are not dealt by it.
HUB = 1 << 20


def _with_least(edges: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """edges(u, v) with m: the least of u and its v. hubs(u, m): vertices whose edges stay where they are; there is at most
    one for each HUB edges, so that their table can go to every task."""
    if hubs is not None:
        own = edges.join(F.broadcast(hubs), "u")
        return _with_least(edges.join(F.broadcast(hubs), "u", "left_anti")).unionByName(own)
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.select("u", F.least("u", "m").alias("m")), "u")


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """edges(u long, v long), any direction -> (u, label): for each vertex with an edge, the least of its component.

    Each round makes every vertex point at a smaller neighbour's minimum; the rounds end when all edges are
    stars. Edges never outnumber those given; only a count and a checksum reach the driver.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen, step = None, 0
    while True:
        edges = scratch.table(edges, f"{name}{step}")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if step > 1:
            scratch.drop(f"{name}{step - 2}")
        if mark == seen or not mark[0]:
            return edges.select("u", F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("label")).distinct())
        seen, step = mark, step + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hubs = None
        if 2 * mark[0] > HUB:  # else no vertex can have so many
            hubs = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB).select("u", "m")
            hubs = scratch.table(hubs, f"{name}_hubs{step}")
        large = _with_least(both, hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large)
        edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
