"""Graphs as tables of edges: components, shortest paths, spanning trees. Iterations are stored, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.storage import stored


def connected_components(nodes: DataFrame, edges: DataFrame, iterations: int = 60) -> DataFrame:
    """node and component, the least node that it reaches; edges have u and v, in either direction.

    Large-star and small-star alternate, so the number of passes grows with the logarithm of the nodes.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(iterations):
        for large in (True, False):
            pairs = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else now
            least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
            met = pairs.join(least, "u")
            if large:
                out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            now = stored(out.where("u > v").distinct())
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == state:
            break
        state = found
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))


def dijkstra(edges: DataFrame, source, directed: bool = False, iterations: int = 10_000) -> DataFrame:
    """node and distance of all that the source reaches over edges (u, v, weight from 0): each pass relaxes the edges of
    the nodes that came nearer in the pass before."""
    both = edges if directed else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    both = stored(both.select("u", "v", F.col("weight").cast("double").alias("weight")))
    kind = dict(both.dtypes)["u"]
    known = edges.sparkSession.range(1).select(F.lit(source).cast(kind).alias("node"), F.lit(0.0).alias("distance"))
    fresh = known
    for _ in range(iterations):
        reached = both.join(fresh, F.col("u") == F.col("node")).groupBy(F.col("v").alias("node")).agg(F.min(F.col("distance") + F.col("weight")).alias("near"))
        merged = stored(known.join(reached, "node", "full").select("node", F.least("distance", "near").alias("distance"), (F.col("near") < F.coalesce("distance", F.lit(float("inf")))).alias("new")))
        known, fresh = merged.select("node", "distance"), merged.where("new").select("node", "distance")
        if fresh.isEmpty():
            break
    return known


def dijkstra_all_pairs(nodes: DataFrame, edges: DataFrame, directed: bool = False, iterations: int = 10_000) -> DataFrame:
    """source, node and distance of all pairs that are joined; the result has a row for each, so only for few nodes."""
    both = edges if directed else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    both = stored(both.select("u", "v", F.col("weight").cast("double").alias("weight")))
    known = stored(nodes.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance")))
    fresh = known
    for _ in range(iterations):
        reached = both.join(fresh, F.col("u") == F.col("node")).groupBy("source", F.col("v").alias("node")).agg(F.min(F.col("distance") + F.col("weight")).alias("near"))
        merged = stored(known.join(reached, ["source", "node"], "full").select("source", "node", F.least("distance", "near").alias("distance"), (F.col("near") < F.coalesce("distance", F.lit(float("inf")))).alias("new")))
        known, fresh = merged.drop("new"), merged.where("new").drop("new")
        if fresh.isEmpty():
            break
    return known


def minimum_spanning_tree(edges: DataFrame, iterations: int = 60) -> DataFrame:
    """Edges (u, v, weight) of a forest of least weight: each component takes its lightest edge, ties by u and v (Boruvka)."""
    all_ = stored(edges.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("weight").alias("weight")))
    nodes = stored(all_.select(F.col("u").alias("node")).union(all_.select("v")).distinct())
    chosen = stored(all_.limit(0))
    for _ in range(iterations):
        part = connected_components(nodes, chosen)
        across = all_.join(part.select(F.col("node").alias("u"), F.col("component").alias("a")), "u").join(part.select(F.col("node").alias("v"), F.col("component").alias("b")), "v").where("a <> b")
        across = stored(across)
        ends = across.select(F.col("a").alias("part"), "u", "v", "weight").unionByName(across.select(F.col("b").alias("part"), "u", "v", "weight"))
        lightest = ends.groupBy("part").agg(F.min(F.struct("weight", "u", "v")).alias("e")).select("e.u", "e.v", "e.weight").distinct()
        new = stored(lightest)
        if new.isEmpty():
            break
        chosen = stored(chosen.unionByName(new.select(*chosen.columns)))
    return chosen


def kneighbors_edges(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest b of each a in a table of (a, b, distance); ties by b."""
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy("distance", "b"))).where(F.col("rank") <= k).drop("rank")
