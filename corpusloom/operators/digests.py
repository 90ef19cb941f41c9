"""Digests of ordered records as trees: a package of any size is hashed by many tasks, and a difference is found by descending.

Records are numbered in a total order (by ranges, so no task sorts them all); ``FAN`` neighbours make a node whose digest covers theirs in order, and so on up
to one root. A node never has more than ``FAN`` children. Two trees are compared from the root down: only below nodes that differ are children looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_row_number, materialize

FAN = 256


def record_digest(columns: list[str]) -> Column:
    """SHA-256 of the columns as canonical JSON: in the order of their names, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def leaves(records: DataFrame, order: list[str], columns: list[str], fan: int = FAN) -> DataFrame:
    """(level 0, place from 0, digest, ref): a row for each record in its order; ``ref`` is the first column of the order."""
    digested = records.select(*order, record_digest(columns).alias("digest"))
    numbered = global_row_number(digested, [*order, "digest"], "n")
    return numbered.select(F.lit(0).alias("level"), (F.col("n") - 1).alias("place"), "digest", F.col(order[0]).cast("string").alias("ref"))


def tree(records: DataFrame, order: list[str], columns: list[str], fan: int = FAN) -> DataFrame:
    """All nodes (level, place, digest, ref, parent); the last level has one node, the root. No records give no nodes."""
    now = materialize(leaves(records, order, columns), "leaves")
    out, level = now, 0
    while now.count() > 1:
        level += 1
        listed = F.array_sort(F.collect_list(F.struct("place", "digest", "ref")))
        up = now.groupBy(F.expr(f"place div {fan}").alias("up")).agg(listed.alias("c"))  # at most `fan`
        now = materialize(up.select(F.lit(level).alias("level"), F.col("up").alias("place"), F.sha2(F.array_join(F.transform("c", lambda x: x["digest"]), "\n"), 256).alias("digest"), F.col("c")[0]["ref"].alias("ref")), "nodes")
        out = out.unionByName(now)
    return out.withColumn("parent", F.expr(f"place div {fan}"))


def root(nodes: DataFrame) -> DataFrame:
    """One row: records, and the digest over their number and the root; of nothing as well."""
    top = nodes.agg(F.count_if(F.col("level") == 0).alias("records"), F.max_by("digest", "level").alias("top"))
    return top.select("records", F.sha2(F.concat_ws(":", F.col("records").cast("string"), F.coalesce("top", F.lit(""))), 256).alias("records_sha256"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(place, left_ref, right_ref) of the records at which two trees differ: descends from the top level, at each level only below nodes that differ.

    An altered record gives its place alone; a record more or less moves all that follow, and each of those places differs.
    """
    level = max(r or 0 for r in (left.agg(F.max("level")).first()[0], right.agg(F.max("level")).first()[0]))
    side = lambda nodes, at, name: nodes.where(F.col("level") == at).select("place", "parent", F.col("digest").alias(f"{name}_digest"), F.col("ref").alias(f"{name}_ref"))
    below = None
    for at in range(level, -1, -1):
        a, b = side(left, at, "left"), side(right, at, "right")
        if below is not None:
            a, b = (x.join(below.select(F.col("place").alias("parent")), "parent", "left_semi") for x in (a, b))
        both = a.drop("parent").join(b.drop("parent"), "place", "full_outer")
        below = materialize(both.where(~F.col("left_digest").eqNullSafe(F.col("right_digest"))).select("place", "left_ref", "right_ref"), "differ")
        if below.isEmpty():
            break
    return below
