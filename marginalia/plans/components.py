"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.plans.scratch import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))  # a join of two plain exchanges: a node with very many edges is split at run time
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = materialize(down.groupBy("a").agg(F.min("b").alias("m")))
    below = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return below.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)``, component the smallest node reachable.

    Nodes without an edge do not appear. Self loops and repeated edges are
    ignored. Only two numbers a round reach the driver; every round's edges are
    written to the shared folder, so no lineage grows.
    """
    edges = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    last, now = None, mark(edges)
    while now[0] and now != last:  # each round brings edges nearer to stars, until nothing changes
        edges = materialize(_small_star(_large_star(edges)))
        last, now = now, mark(edges)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
