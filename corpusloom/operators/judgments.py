"""Joins of outside judgments with the corpus: decisions, drafts, drops; checks become diagnostics, never exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .sessions import overlaps, span_code

DIAGNOSTIC = ("session_seq", "code", "item_ref")


def decision_diagnostics(source: DataFrame, decisions: DataFrame) -> DataFrame:
    """Faults of the answers of step c: unknown index, repeated index, missing answers, spans that aren't verbatim or in order.

    ``source``: session_seq, i, text; ``decisions``: session_seq, i, text. Indices are judged first; a session that fails there isn't judged further.
    """
    sizes = source.groupBy("session_seq").agg(F.count("*").alias("n"))
    answered = decisions.join(sizes, "session_seq", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    unknown = answered.where((F.col("i") < 1) | (F.col("i") > F.col("n"))).select("session_seq", F.lit("AUTHORSHIP_UNKNOWN_UTTERANCE").alias("code"), F.col("i").cast("string").alias("item_ref")).distinct()
    twice = decisions.groupBy("session_seq", "i").count().where("count > 1").select("session_seq", F.lit("AUTHORSHIP_DUPLICATE_DECISION").alias("code"), F.col("i").cast("string").alias("item_ref"))
    first = unknown.union(twice)
    given = decisions.groupBy("session_seq").agg(F.count("*").alias("given"))
    short = sizes.join(given, "session_seq", "left").where(F.coalesce("given", F.lit(0)) != F.col("n")).join(first.select("session_seq").distinct(), "session_seq", "left_anti")
    short = short.select("session_seq", F.lit("CARDINALITY_MISMATCH").alias("code"), F.lit(None).cast("string").alias("item_ref"))
    failed = first.union(short)
    pairs = decisions.join(failed.select("session_seq").distinct(), "session_seq", "left_anti").alias("d").join(source.alias("s"), ["session_seq", "i"])
    spans = pairs.where(F.col("d.text") != "").select("session_seq", span_code(F.col("d.text"), F.col("s.text")).alias("code"), F.col("i").cast("string").alias("item_ref")).where("code is not null")
    return failed.union(spans)


def apply_decisions(source: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the sessions without a fault, their text replaced by what was kept; diagnostics of the others)."""
    faults = decision_diagnostics(source.select("session_seq", "i", "text"), decisions)
    sound = source.join(faults.select("session_seq").distinct(), "session_seq", "left_anti")
    kept = decisions.select("session_seq", "i", F.col("text").alias("_kept"))
    return sound.join(kept, ["session_seq", "i"]).withColumn("text", F.col("_kept")).drop("_kept"), faults


def mistake_records(source: DataFrame, drafts: DataFrame) -> DataFrame:
    """Drafts with the utterance that their index names: record_id, span, texts, source_type, modality. Unknown indices stay out; see ``record_diagnostics``."""
    rows = drafts.join(source.select("session_seq", "i", "utterance_id", F.col("source_adapter").alias("source_type"), F.when(F.col("modality") == "spoken_asr", "spoken_asr").otherwise("written").alias("modality"), F.col("text").alias("utterance_text")), ["session_seq", "i"])
    return rows.withColumn("record_id", F.format_string("%s:%d-%d", "utterance_id", F.col("start").cast("long"), F.col("end").cast("long")))


def record_diagnostics(records: DataFrame, privacy: bool = True) -> DataFrame:
    """Faults of records: a span past its text or without visible characters, overlapping spans, forbidden content."""
    past = records.where(F.col("end") > F.length("utterance_text")).select("session_seq", F.lit("SCHEMA_INVALID_VALUE").alias("code"), F.col("record_id").alias("item_ref"))
    quoted = F.expr("substring(utterance_text, int(start) + 1, int(end - start))")
    empty = records.where((F.col("end") <= F.length("utterance_text")) & ~quoted.rlike(r"\S")).select("session_seq", F.lit("SCHEMA_INVALID_VALUE").alias("code"), F.col("record_id").alias("item_ref"))
    twice = overlaps(records, "utterance_id", "start", "end").select("session_seq", F.lit("CARDINALITY_MISMATCH").alias("code"), F.col("record_id").alias("item_ref"))
    out = past.union(empty).union(twice)
    if privacy:
        codes = text.record_codes(F.col("rule"), F.col("mistake"), F.col("example"), F.col("source_type"))
        out = out.union(records.select("session_seq", F.explode(codes).alias("code"), F.col("record_id").alias("item_ref")))
    return out


def unknown_drafts(source: DataFrame, drafts: DataFrame) -> DataFrame:
    gone = drafts.join(source.select("session_seq", "i"), ["session_seq", "i"], "left_anti")
    return gone.select("session_seq", F.lit("LINEAGE_MISSING_INPUT").alias("code"), F.col("i").cast("string").alias("item_ref")).distinct()


def drop_records(records: DataFrame, drops: DataFrame) -> DataFrame:
    """Records without those whose number in their session is dropped: ``drops`` has session_seq and an array ``drop``."""
    numbered = records.withColumn("n", F.row_number().over(Window.partitionBy("session_seq").orderBy("i", "start", "end")))
    return numbered.join(drops.select("session_seq", F.explode("drop").alias("n")).distinct(), ["session_seq", "n"], "left_anti")


def not_carried(later: DataFrame, earlier: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a later step that the earlier one did not write, and rows carried twice."""
    new = later.select(*columns).exceptAll(earlier.select(*columns)).withColumn("code", F.lit("SCHEMA_INVALID_VALUE"))
    twice = later.groupBy(*columns).count().where("count > 1").drop("count").withColumn("code", F.lit("CARDINALITY_MISMATCH"))
    return new.union(twice)


def file_set_difference(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Names on one side only, with the side."""
    a, b = left.select(name).distinct().withColumn("l", F.lit(1)), right.select(name).distinct().withColumn("r", F.lit(1))
    return a.join(b, name, "full_outer").where("l is null or r is null").select(name, F.when(F.col("l").isNull(), "right_only").otherwise("left_only").alias("side"))


def promoted_records(records: DataFrame, faults: DataFrame) -> DataFrame:
    """The records of the runs without any fault: a step's records are promoted all or none. Both with ``run_id``."""
    return records.join(faults.select("run_id").distinct(), "run_id", "left_anti")


def verification_weights(records: DataFrame) -> DataFrame:
    """By session the records to be verified and their words, the weights by which sessions are dealt to batches."""
    own = text.count_words(F.concat_ws(" ", "mistake", "rule", "example"))
    return records.groupBy("session_seq").agg(F.count("*").alias("records"), F.sum(own).alias("words"))
