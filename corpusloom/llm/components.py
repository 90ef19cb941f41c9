"""Connected components of an edge table by alternating star steps (large-star, small-star), in joins and aggregations.

A node's neighbours are never gathered in one task: a step takes each node's least neighbour by a partial aggregation
and joins it back to the edges. Every round is written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("b"), F.col("m").alias("a"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"))
    least = down.groupBy("b").agg(F.min("a").alias("m"))
    linked = down.join(least, "b")
    return linked.select(F.col("a").alias("b"), F.col("m").alias("a")).union(least.select("b", F.col("m").alias("a")))


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) of every node with an edge to another one; root is the least node of its component.

    ``edges`` has two columns of one ordered type; self-loops, repeats and either direction are allowed.
    """
    a, b = edges.columns
    now = materialize(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), tag)
    before = None
    for _ in range(MAX_ROUNDS):
        step = _small_star(_large_star(now)).where("a < b").select("a", "b").distinct()
        after = materialize(step, tag)
        discard(now)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = state
    raise RuntimeError("components did not settle")
