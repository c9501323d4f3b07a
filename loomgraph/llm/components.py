"""Connected components by alternating large-star and small-star rounds, with each round's edges written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    """Equal before and after a round only if the edges are; sums of hashes do not depend on order."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("u", "v").cast("bigint"))).first())


def _star(neighbours: DataFrame, large: bool) -> DataFrame:
    """neighbours(u, w): each u's smallest neighbour or itself takes over u's larger (large) or smaller (small) neighbours."""
    if not large:
        neighbours = neighbours.where("w < u")
    least = neighbours.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = neighbours.join(least, "u")
    moved = joined.where("w > u").select(F.col("w").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("w").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs -> (u, v): each vertex but a component's smallest, with that smallest.

    Edges of a vertex are never gathered: minima are aggregated and joined back. Defined cases: loops and repeated edges count
    once, nulls are left out, no edges give no rows.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    before = _state(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.select("u", F.col("v").alias("w")).union(edges.select(F.col("v").alias("u"), F.col("u").alias("w")))
        large = _star(both, True)
        # small stars look at each edge from its larger end
        turned = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("w"))
        edges = materialize(_star(turned, False), "edges")
        after = _state(edges)
        if after == before:
            return edges
        before = after
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
