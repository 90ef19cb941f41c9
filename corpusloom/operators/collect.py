"""Collecting utterances of many sources: period and cutoff, checks of extracts, union, counts by source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from . import partitions
from .common import materialize


def within_bounds(ts: Column, start: Column, end: Column, cutoff: Column) -> Column:
    """Undated rows pass; dated ones lie between ``start`` and the earlier of ``end`` and ``cutoff``, both included."""
    return ts.isNull() | ts.between(start, F.least(end, cutoff))


def period_bounds(preset: str, now: Column) -> tuple[Column, Column]:
    """Start and end of a preset period in UTC; ``everything`` starts at the epoch."""
    days = dict(fixed.PRESETS)[preset]
    return (F.timestamp_seconds(F.lit(0)) if days is None else now - F.make_dt_interval(F.lit(days))), now


def eligible_instances(instances: DataFrame) -> DataFrame:
    """Instances that are stable, found and have candidates."""
    return instances.where((F.col("stability") == "stable") & (F.col("accessibility") == "found") & (F.col("candidate_messages") > 0))


def named(instances: DataFrame, name: str) -> DataFrame:
    """Instances by adapter id, label, or label without its number, whatever the case."""
    wanted, label = name.casefold(), F.lower("opaque_label")
    return instances.where((F.lower("adapter_id") == wanted) | (label == wanted) | (F.regexp_replace(label, " [^ ]*$", "") == wanted))


def missing_inputs(selected: DataFrame, instances: DataFrame) -> DataFrame:
    """Selected keys without an inventory row: an exclusion for each."""
    return selected.join(instances.select("instance_key"), "instance_key", "left_anti").select(F.substring("instance_key", 1, 12).alias("instance"), F.lit("LINEAGE_MISSING_INPUT").alias("reason"))


def extract_diagnostics(utterances: DataFrame, adapter: str, now: Column) -> DataFrame:
    """Faults of one extract: repeated ids, rows of another adapter, blank texts, times that can't be."""
    rows = utterances.select("utterance_id", "source_adapter", "text", "ts")
    fault = lambda code, where: rows.where(where).select(F.lit(code).alias("code"), F.col("utterance_id").alias("item_ref"))
    twice = rows.groupBy("utterance_id").count().where("count > 1").select(F.lit("CARDINALITY_MISMATCH").alias("code"), F.col("utterance_id").alias("item_ref"))
    foreign = fault("SCHEMA_INVALID_VALUE", ~F.col("source_adapter").eqNullSafe(F.lit(adapter)))
    blank = fault("SCHEMA_INVALID_VALUE", ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)))
    odd = fault("TIMESTAMP_IMPLAUSIBLE", (F.col("ts") < F.lit("2015-01-01").cast("timestamp")) | (F.col("ts") > now + F.make_dt_interval(F.lit(1))))
    return reduce(DataFrame.unionByName, (twice, foreign, blank, odd))


def collected(extracts: list[DataFrame], start: Column, end: Column, cutoff: Column) -> DataFrame:
    """The union of extracts within the period, null columns where an extract lacks one."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), extracts)
    return every.where(within_bounds(F.col("ts"), start, end, cutoff))


def per_source(utterances: DataFrame) -> DataFrame:
    return utterances.groupBy("source_adapter").agg(F.count("*").alias("kept"))


def judgment_rows(utterances: DataFrame) -> DataFrame:
    """What a judge of authorship sees: session, number, modality, text and flags."""
    return utterances.select("session_seq", "i", "modality", "text", "content_flags")


def prefilled(utterances: DataFrame, pasted: Column) -> DataFrame:
    """Sessions of which every row is a pasted document: their answers are empty without a judge."""
    whole = utterances.groupBy("session_seq").agg(F.bool_and(pasted).alias("all_pasted")).where("all_pasted").select("session_seq")
    return utterances.join(whole, "session_seq", "left_semi").select("session_seq", "i", F.lit("").alias("text"))


def rows_of_survivors(utterances: DataFrame, survivors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, with their session; rows that deduplication removed). A session that loses all rows is in the second only."""
    return utterances.join(survivors.select("utterance_id"), "utterance_id", "left_semi"), utterances.join(survivors.select("utterance_id"), "utterance_id", "left_anti")


def redistribute(spark: SparkSession, path: str, schema: str, survivors: DataFrame, key: str = "session_seq") -> tuple[int | None, DataFrame]:
    """Take the rows that deduplication removed out of a table of sessions. Only folders with sessions that lose rows are written anew, all in one change.

    ``schema``: the rows' columns without ``key``, by which ``write_sessions`` dealt the sessions into folders, with ``utterance_id`` and ``i``. A session that loses every row stays as an empty one: it
    isn't among the partitions any more but in the second result. Returns the new version (None if nothing changed) and (session_seq, removed, kept) of the sessions affected.
    """
    rows, by = partitions.read(spark, path, schema, key), sorted({key, "session_seq"})
    lost = rows.join(survivors.select("utterance_id"), "utterance_id", "left_anti").groupBy(*by).agg(F.count("*").alias("removed"))
    lost = materialize(lost, "lost")
    if lost.isEmpty():
        return None, lost.select("session_seq", "removed").withColumn("kept", F.lit(0).cast("long"))
    touched = rows.join(lost.select(key).distinct(), key, "left_semi")
    kept = touched.join(survivors.select("utterance_id"), "utterance_id", "left_semi")
    counts = kept.groupBy(*by).agg(F.count("*").alias("kept"))
    affected = materialize(lost.join(counts, by, "left").na.fill(0, ["kept"]), "affected")
    empty = lost.select(key).distinct().join(counts.select(key), key, "left_anti")
    version = partitions.change(kept, path, key, ["i"] if key == "session_seq" else ["session_seq", "i"], removed=empty)
    return version, affected.select("session_seq", "removed", "kept")
