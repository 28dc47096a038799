"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop, stored

ITERATIONS = 60


def _relinked(edges: DataFrame, large: bool) -> tuple[DataFrame, str]:
    """One star operation as a minimum per node and a join back.

    The minima are stored first, so that the join has a plain exchange on either side and Spark can split a
    node with many edges.
    """
    pairs = edges
    if large:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least, path = stored(least.select("u", F.least("u", "m").alias("m")))
    linked = pairs.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    result = stored(out.where("u > v").distinct())
    drop(edges.sparkSession, path)
    return result


def connected_components(edges: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(u, component) of every node that has an edge to a smaller one; component is the least id that it reaches.

    edges has u and v of one orderable type; loops, repeats, nulls and either direction are allowed. Nodes
    that are their component's least id, and nodes without edges, have no row. Each iteration is
    stored; the number needed grows with the logarithm of the number of nodes.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    spark = edges.sparkSession
    edges, path = stored(edges)
    state = None
    for _ in range(iterations):
        large, middle = _relinked(edges, True)
        edges, following = _relinked(large, False)
        drop(spark, path)
        drop(spark, middle)
        path = following
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select("u", F.col("v").alias("component"))
        state = now
    raise RuntimeError(f"components did not settle within {iterations} iterations")
