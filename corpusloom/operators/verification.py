"""Independent checks of written steps, and the sinks: every fault is a row (code, item_ref), nothing raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import partitions


def _fault(rows: DataFrame, code: str, ref: str, where: Column) -> DataFrame:
    return rows.where(where).select(F.lit(code).alias("code"), F.col(ref).cast("string").alias("item_ref"))


def corpus_diagnostics(corpus: DataFrame, index: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Recounts a corpus (session_seq, utterance_id, text) against its index (session_seq, utterances, words) and ``totals`` (run_id, sessions, utterances, words)."""
    own = corpus.groupBy("session_seq").agg(F.count("*").alias("n"), F.sum(text.english_words(F.col("text"))).alias("w"))
    both = index.join(own, "session_seq", "full_outer")
    faults = [
        _fault(both, "CARDINALITY_MISMATCH", "session_seq", F.col("utterances").isNull()),  # not listed
        _fault(both, "LINEAGE_MISSING_INPUT", "session_seq", F.col("n").isNull() & (F.col("utterances") > 0)),
        _fault(both, "CARDINALITY_MISMATCH", "session_seq", F.col("n") != F.col("utterances")),
        _fault(both, "ARITHMETIC_INVARIANT_VIOLATION", "session_seq", F.col("w") != F.col("words")),
        corpus.groupBy("utterance_id").count().where("count > 1").select(F.lit("CARDINALITY_MISMATCH").alias("code"), F.col("utterance_id").alias("item_ref")),
    ]
    if totals is not None:
        sums = own.agg(F.count("*").alias("s"), F.sum("n").alias("n"), F.sum("w").alias("w"))
        one = totals.crossJoin(F.broadcast(sums))  # one row
        faults += [_fault(one, "CARDINALITY_MISMATCH", "run_id", (F.col("s") != F.col("sessions")) | (F.col("n") != F.col("utterances"))), _fault(one, "ARITHMETIC_INVARIANT_VIOLATION", "run_id", F.col("w") != F.col("words"))]
    return reduce(DataFrame.unionByName, faults)


def file_diagnostics(found: DataFrame, listed: DataFrame) -> DataFrame:
    """Files (file_name, sha256) against the index: missing ones, unlisted ones, other contents."""
    both = listed.select("file_name", F.col("sha256").alias("want")).join(found.select("file_name", F.col("sha256").alias("have")), "file_name", "full_outer")
    return reduce(DataFrame.unionByName, (_fault(both, "LINEAGE_MISSING_INPUT", "file_name", F.col("have").isNull()), _fault(both, "CARDINALITY_MISMATCH", "file_name", F.col("want").isNull()), _fault(both, "LINEAGE_HASH_MISMATCH", "file_name", F.col("have") != F.col("want"))))


def line_diagnostics(before: DataFrame, after: DataFrame, keys: list[str], untouched: list[str]) -> DataFrame:
    """Line for line: rows that went or came, and rows whose other columns than the text changed."""
    same = reduce(lambda a, b: a & b, [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in untouched], F.lit(True))
    both = before.withColumn("_b", F.lit(1)).alias("b").join(after.withColumn("_a", F.lit(1)).alias("a"), keys, "full_outer")
    code = F.when(F.col("_b").isNull() | F.col("_a").isNull(), "CARDINALITY_MISMATCH").when(~same, "SCHEMA_INVALID_VALUE")
    return both.select(code.alias("code"), F.concat_ws(":", *keys).alias("item_ref")).where("code is not null")


def step_report(diagnostics: DataFrame, severities: DataFrame) -> DataFrame:
    """One row: errors, warnings, and whether the step passes; ``severities``: code, severity."""
    rows = diagnostics.join(F.broadcast(severities), "code", "left")  # a row for each code of the catalogue
    return rows.agg(F.count_if(F.coalesce(F.col("severity"), F.lit("error")) == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")).withColumn("passed", F.col("errors") == 0)


def diagnostic_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("code").agg(F.count("*").alias("n"))


def write_sessions(rows: DataFrame, path: str, key: str = "session_seq") -> int:
    """JSON lines, a folder for each session, rows in their order; sessions that aren't in ``rows`` keep their files. Returns the version.

    With another ``key``, a column that depends on the session alone, sessions share a folder, and ``rows`` have all those of the folders that they name.
    """
    return partitions.change(rows, path, key, ["i"] if key == "session_seq" else ["session_seq", "i"])


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def next_step(steps: DataFrame) -> DataFrame:
    """By run the first step that isn't promoted and the last that is."""
    promoted = F.col("status") == "promoted"
    return steps.groupBy("run_id").agg(F.min(F.when(~promoted, F.col("step"))).alias("next_step"), F.max(F.when(promoted, F.col("step"))).alias("last_promoted"))


def invalidated(steps: DataFrame, earliest: DataFrame) -> DataFrame:
    """Promoted steps from each run's earliest affected one on become invalidated; ``earliest``: run_id, earliest_step."""
    joined = steps.join(earliest, "run_id", "left")
    hit = (F.col("status") == "promoted") & (F.col("step") >= F.col("earliest_step"))
    return joined.withColumn("status", F.when(hit, "invalidated").otherwise(F.col("status"))).drop("earliest_step")


def progress(items: DataFrame) -> DataFrame:
    """Done, total and the whole percent by run; 0 of nothing is 0."""
    out = items.groupBy("run_id").agg(F.count_if("done").alias("done"), F.count("*").alias("total"))
    return out.withColumn("percent", F.when(F.col("total") == 0, 0).otherwise(F.floor(100 * F.col("done") / F.col("total"))).cast("long"))
