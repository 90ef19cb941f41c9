"""Lines of files of any size, read by many tasks, with the line numbers of a single pass.

Spark splits a file into blocks; a line belongs to the block in which it begins. Within a block lines follow each other in one task, so a line's number is the number of lines in the
blocks before plus its place within its own. The first is a sum over a table of blocks (one row for each), the second a difference of row ids; no line
is sorted or sent anywhere. If the blocks of the second read aren't those of the first (files or settings changed meanwhile), the job fails instead of numbering wrongly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Up to so many blocks their table (some 150 bytes each) is sent to all executors; beyond that it is joined.
BROADCAST_BLOCKS = 100_000


def placed_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, file_name, file_size, modified, block, block_length, row_id, line; (path, block, row_id) is the order of the lines. Lines end with a line feed; broken UTF-8 becomes U+FFFD."""
    meta = lambda name: F.col("_metadata").getField(name)
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)
    return read.select(
        meta("file_path").alias("path"), meta("file_name").alias("file_name"), meta("file_size").alias("file_size"), meta("file_modification_time").alias("modified"),
        meta("file_block_start").alias("block"), meta("file_block_length").alias("block_length"), F.monotonically_increasing_id().alias("row_id"), F.make_valid_utf8("value").alias("line"),
    )


def numbered_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, file_name, file_size, modified, line_no (from 0), line, ``closed`` (null: it isn't known whether the last line has its end)."""
    rows = placed_lines(spark, path, pattern)
    blocks = rows.groupBy("path", "block", "block_length").agg(F.min("row_id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    base = blocks.select("path", "block", "block_length", "first", F.coalesce(before, F.lit(0)).alias("before")).persist()
    if base.count() <= BROADCAST_BLOCKS:
        base = F.broadcast(base)
    both = rows.join(base, ["path", "block", "block_length"], "left")
    number = F.when(F.col("first").isNull(), F.raise_error(F.lit("the files or their blocks changed while their lines were numbered"))).otherwise(F.col("row_id") - F.col("first") + F.col("before"))
    return both.select("path", "file_name", "file_size", "modified", F.lit(None).cast("boolean").alias("closed"), number.cast("long").alias("line_no"), "line")
