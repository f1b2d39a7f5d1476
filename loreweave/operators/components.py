"""Connected components by alternating star operations (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.storage import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u > v, after one operation: each neighbour that qualifies is linked to the least one."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(least, "u")
    linked = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Component of each node that has an edge: id, component (its least id).

    ``edges`` has a and b; loops and repeated edges are ignored. Only minima are
    taken of a node's neighbours, so a hub is pre-aggregated like any key. Each
    round is written to the shared folder; it ends when nothing changes, after
    about the logarithm of the longest path. An empty table gives an empty result.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialize(links, "links")
    shape = None
    for _ in range(rounds):
        links = materialize(_stars(_stars(links, large=True), large=False), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == shape:
            break
        shape = tuple(now)
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
