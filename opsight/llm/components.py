"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsight.llm.common import written


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """key and component (its smallest member) of every node of an edge list (a, b of long).

    Both directions, loops and repeated edges are fine; an empty list gives no rows.
    Every step is a pre-aggregated minimum and a join; the join is on the node's text,
    not on the key of the aggregate, so that Spark shuffles both sides and can split
    a node with very many edges.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        edges = written(_small_star(_large_star(edges)), "edges")
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    stars = edges.select(F.col("a").alias("key"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("key"), F.col("b").alias("component")).distinct())


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m")).select(F.col("u").cast("string").alias("t"), "m")
    return pairs.withColumn("t", F.col("u").cast("string")).join(least, "t").drop("t")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    told = _with_least(down)
    ties = told.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return ties.where("a <> b").distinct()
