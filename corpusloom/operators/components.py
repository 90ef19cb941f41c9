"""Connected components of an edge table.

Up to ``SMALL`` edges are one bounded piece of work for one task; more of them go by alternating star steps, in joins and aggregations, each round written to the
shared folder, so that a node's neighbours are never gathered and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

MAX_ROUNDS = 60
SMALL = 200_000


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find; the root of a set is its least node."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    if nodes := [x for x in root if find(x) != x]:
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([find(x) for x in nodes])], names=["node", "root"])


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, root) of every node but the least of its component, which is the root. ``edges``: a and b, of one ordered type."""
    now = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    kind = now.schema["a"].dataType.simpleString()
    if now.count() <= small:
        return now.repartition(1).mapInArrow(_at_once, f"node {kind}, root {kind}")  # at most `small` edges
    before = None
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        down = large.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).union(low.select(F.col("m").alias("a"), "b"))
        after = materialize(down.where("a < b").distinct(), "edges")
        discard(now)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = state
    raise RuntimeError("components did not settle")
