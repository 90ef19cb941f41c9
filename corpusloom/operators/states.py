"""States of a scan that merge: sums, least and greatest values, and sets.

A scan of rows and a merge of scans are both one aggregation with a partial step before its shuffle, and it doesn't matter how the rows were split: the state of the
whole is the merge of the states of its parts. ``refresh`` keeps the states of files in a table of partitions, so that only new and changed files are scanned again, and
``inventory`` merges them by instance.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import partitions
from .common import materialize

#: Files whose states share one partition of the table.
BUCKETS = 64


@dataclass(frozen=True)
class Scan:
    """The fields of a state, each over one row of what is scanned. A null adds nothing; a condition counts as one where it holds. Sets must be small, as of versions."""

    sums: dict[str, Column]
    least: dict[str, Column] = field(default_factory=dict)
    greatest: dict[str, Column] = field(default_factory=dict)
    sets: dict[str, Column] = field(default_factory=dict)

    def of(self, rows: DataFrame, *keys: str) -> DataFrame:
        """The state of each key. Sums are longs."""
        total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
        return rows.groupBy(*keys).agg(*[total(c).alias(k) for k, c in self.sums.items()], *[F.min(c).alias(k) for k, c in self.least.items()], *[F.max(c).alias(k) for k, c in self.greatest.items()], *[F.array_sort(F.collect_set(c)).alias(k) for k, c in self.sets.items()])

    def merged(self, states: DataFrame, *keys: str) -> DataFrame:
        """The state of the union of what the states were taken of."""
        union = lambda k: F.array_sort(F.array_distinct(F.flatten(F.collect_list(k))))
        return states.groupBy(*keys).agg(*[F.sum(k).alias(k) for k in self.sums], *[F.min(k).alias(k) for k in self.least], *[F.max(k).alias(k) for k in self.greatest], *[union(k).alias(k) for k in self.sets])


def refresh(path: str, listed: DataFrame, scan: Callable[[DataFrame], DataFrame], schema: str) -> int:
    """Bring the table at ``path`` up to the listing (file, stamp): ``scan`` gets the files that are new or have another stamp and returns their states.

    ``schema``: the columns of a state, with ``file``. A file that the listing lacks goes. Returns how many files were scanned.
    """
    spark = listed.sparkSession
    columns = f"{schema}, stamp string"
    old = partitions.read(spark, path, columns, "bucket", form="parquet")
    bucket = F.pmod(F.xxhash64("file"), F.lit(BUCKETS)).cast("long")
    now = materialize(listed.select("file", F.col("stamp").cast("string").alias("stamp")), "listing")
    fresh = now.join(old.select("file", "stamp"), ["file", "stamp"], "left_anti")
    found = materialize(scan(fresh).join(fresh, "file").withColumn("bucket", bucket), "states")
    stays = old.join(now, ["file", "stamp"], "left_semi")
    gone = old.join(now, ["file", "stamp"], "left_anti").select("bucket")
    touched = materialize(found.select("bucket").union(gone).distinct(), "touched")
    if touched.isEmpty():
        return 0
    rows = materialize(stays.join(touched, "bucket", "left_semi").unionByName(found), "rows")
    partitions.change(rows, path, "bucket", ["file"], removed=touched.join(rows, "bucket", "left_anti"), form="parquet")
    return found.select("file").distinct().count()


def inventory(spark, path: str, schema: str, scan: Scan, *keys: str) -> DataFrame:
    """The merged states of all files, by instance."""
    return scan.merged(partitions.read(spark, path, f"{schema}, stamp string", "bucket", form="parquet"), *keys)
