"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.session import materialized


def _nearest(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the least of u and all its neighbours; a busy u is aggregated, never gathered."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("m", "u"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id that has an edge; the component is its least id.

    A large-star step links every greater neighbour of u to the least neighbour; a small-star step
    does so for u and its smaller neighbours. Rounds end when the edges stay the same, after
    O(log^2) rounds; each round's edges are written to the shared folder.
    """
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialized(edges, "edges")
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _nearest(large.where(F.col("u") != F.col("v")).distinct())
        linked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = materialized(linked.where(F.col("u") != F.col("v")).distinct(), "edges")
        now = _mark(edges)
        if now == before:
            break
        before = now
    root = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(root)
