"""Inventories of source instances: what each holds, what of it may leave, what an audit reads by default, and how an extract is checked against it.

An instance is a row: adapter_id, adapter_version, instance_key, path_hash, fingerprint, stability, accessibility, diagnostic_code, estimated_records, earliest, latest,
candidate_messages, candidate_words, candidate_bytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from .collect import eligible_instances, extract_diagnostics
from .states import Scan

#: What an agent may see of an instance: no path, no key, no fingerprint.
VISIBLE_COLUMNS = ("adapter_id", "adapter_version", "opaque_label", "stability", "accessibility", "diagnostic_code", "estimated_records", "earliest", "latest", "candidate_messages", "candidate_words", "candidate_bytes")
#: The six columns of a record that may be shared.
SHAREABLE_COLUMNS = ("mistake", "rule", "example", "example_type", "modality", "source_type")
#: What a judge of confidentiality sees.
CONFIDENTIAL_COLUMNS = ("mistake", "rule", "example", "example_type")


def candidates() -> Scan:
    """What an instance's candidates add up to; merges over files."""
    return Scan(sums={"candidate_messages": F.expr("true"), "candidate_words": text.count_words(F.col("text")), "candidate_bytes": F.octet_length("text")}, least={"earliest": F.col("ts")}, greatest={"latest": F.col("ts")})


def instances(utterances: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Instances with their candidates; ``verdicts``: adapter_id, instance_key, supported, estimated_records, fingerprint, version. An unsupported instance has a diagnostic and no candidates."""
    keys = ["adapter_id", "instance_key"]
    counted = candidates().of(utterances, *keys)
    rows = verdicts.join(counted, keys, "left")
    ok = F.col("supported")
    rows = rows.withColumns({c: F.when(ok, F.coalesce(c, F.lit(0))).otherwise(0).cast("long") for c in ("candidate_messages", "candidate_words", "candidate_bytes")})
    rows = rows.withColumns({c: F.when(ok, F.col(c)) for c in ("earliest", "latest")})
    return rows.withColumn("accessibility", F.when(ok, "found").otherwise("unsupported_schema")).withColumn("diagnostic_code", F.when(~ok, F.lit("SOURCE_UNSUPPORTED_SCHEMA"))).drop("supported")


def summaries(inventory: DataFrame, names: dict[str, str]) -> DataFrame:
    """The visible columns, with labels that number an adapter's instances in the order of their keys; ``names``: adapter -> its name for people."""
    name = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("adapter_id")]
    own = F.row_number().over(Window.partitionBy("adapter_id").orderBy("instance_key"))
    return inventory.withColumn("opaque_label", F.concat_ws(" ", F.coalesce(name, F.col("adapter_id")), own.cast("string"))).select(*VISIBLE_COLUMNS)


def default_selection(inventory: DataFrame, runtime: str) -> DataFrame:
    """The eligible instances of the runtime's own history, and none of any other source, even if it has none."""
    return eligible_instances(inventory).where(F.col("adapter_id") == fixed.RUNTIME_ADAPTERS[runtime]).select("instance_key")


def runtime_name(runtime: Column) -> Column:
    return F.translate(runtime, "_", "-")


def drift(inventory: DataFrame, utterances: DataFrame) -> DataFrame:
    """Instances of which an extract gave another number of utterances than the inventory counted: the history changed meanwhile, which excludes nothing."""
    found = utterances.groupBy("instance_key").agg(F.count("*").alias("n"))
    both = inventory.select("instance_key", "candidate_messages").join(found, "instance_key", "left").where(F.coalesce("n", F.lit(0)) != F.col("candidate_messages"))
    return both.select(F.lit("SOURCE_HISTORY_CHANGED").alias("code"), F.col("instance_key").alias("item_ref"))


def verified(inventory: DataFrame, utterances: DataFrame, adapter: str, now: Column, leaked: Column | None = None) -> DataFrame:
    """The checks of one adapter's extract (utterance_id, source_adapter, instance_key, text, ts): those of every extract, texts that begin as injected context does, and drift.

    ``leaked``: whether a text holds what the adapter's rules exclude.
    """
    found = [extract_diagnostics(utterances, adapter, now), drift(inventory, utterances)]
    if leaked is not None:
        found.append(utterances.where(F.coalesce(leaked, F.lit(False))).select(F.lit("SCHEMA_INVALID_VALUE").alias("code"), F.col("utterance_id").alias("item_ref")))
    return reduce(DataFrame.unionByName, found)


def confidentiality_rows(records: DataFrame) -> DataFrame:
    """What a judge of confidentiality sees of each session's records: their number and the four columns of content."""
    own = F.row_number().over(Window.partitionBy("session_seq").orderBy("record_id"))
    return records.select("session_seq", own.alias("i"), *CONFIDENTIAL_COLUMNS)


def line_count_differences(before: DataFrame, after: DataFrame, name: str = "file_name") -> DataFrame:
    """Files of both steps whose numbers of lines differ; files of one step only are another check's. Rows are lines."""
    count = lambda d, c: d.groupBy(name).agg(F.count("*").alias(c))
    both = count(before, "expected").join(count(after, "actual"), name).where("expected <> actual")
    return both.select(F.lit("CARDINALITY_MISMATCH").alias("code"), F.col(name).alias("item_ref"))


def index_not_carried(folders: DataFrame) -> DataFrame:
    """Steps without a session index whose predecessor has one; ``folders``: run_id, step, has_index."""
    before = F.lag("has_index").over(Window.partitionBy("run_id").orderBy("step"))
    return folders.withColumn("before", before).where("before and not has_index").select(F.lit("CARDINALITY_MISMATCH").alias("code"), F.concat_ws(":", "run_id", "step").alias("item_ref"))


def analysed_ids(authored: DataFrame, analysed: DataFrame) -> DataFrame:
    """Ids of non-empty authored rows in the sessions that the analysis has written, whatever it says itself."""
    return authored.where(F.col("text").rlike(r"\S")).join(analysed.select("session_seq").distinct(), "session_seq", "left_semi").select("utterance_id")


def found_count(drafts: DataFrame, target: int = fixed.FOUND_TARGET) -> DataFrame:
    """By run the non-empty draft lines, the sessions with a file, and whether there are enough; ``drafts``: run_id, session_seq, line (null for an empty file)."""
    seen = F.coalesce(F.col("line").rlike(r"\S"), F.lit(False))
    out = drafts.groupBy("run_id").agg(F.count_if(seen).alias("found"), F.count_distinct("session_seq").alias("sessions_analyzed"))
    return out.withColumn("target", F.lit(target).cast("long")).withColumn("enough", F.col("found") >= target)


def unfinished_runs(runs: DataFrame, steps: DataFrame, now: Column) -> DataFrame:
    """Runs that haven't ended, with the age of their checkpoint in hours (one decimal) and the last promoted step; order by ``started``, newest first, where they are shown.

    ``runs``: run_id, status, started, last_checkpoint (epoch seconds); ``steps``: run_id, step, status.
    """
    last = steps.where("status = 'promoted'").groupBy("run_id").agg(F.max("step").alias("last_promoted_step"))
    rows = runs.where(~F.col("status").isin(*fixed.ENDED)).join(last, "run_id", "left")
    return rows.select("run_id", "status", "started", F.round((now - F.col("last_checkpoint")) / 3600, 1).alias("checkpoint_age_hours"), "last_promoted_step")


def resume_report(runs: DataFrame, steps: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Unfinished runs with what to do about each, and whether it can be offered; ``decisions`` is of ``counts.resume_decision``."""
    rows = unfinished_runs(runs, steps, now).join(decisions, "run_id", "left")
    return rows.withColumn("offerable", F.col("decision").isin("continue", "invalidate_downstream"))


def live_versions(recorded: Column, installed: dict[str, str]) -> Column:
    """A run's recorded versions (a map) with today's for each adapter that is still there."""
    today = F.create_map(*[F.lit(x) for pair in installed.items() for x in pair]) if installed else F.create_map().cast("map<string,string>")
    return F.transform_values(recorded, lambda k, v: F.coalesce(today[k], v))


def profile_cell(estimates: DataFrame, profile: DataFrame) -> DataFrame:
    """Rows with the profile's cell of exactly their step, runtime, model and effort; null where there is none."""
    keys = ["step", "runtime", "model", "effort"]
    cells = profile.select(*keys, F.struct(*[c for c in profile.columns if c not in keys]).alias("cell"))
    return estimates.join(cells, keys, "left")


def measured_elsewhere(chosen: DataFrame) -> DataFrame:
    """By runtime whether any chosen cell was measured with another model or effort than is in force, and with which; ``chosen``: runtime, step, model, effort, own_model, own_effort."""
    other = ~F.col("model").eqNullSafe(F.col("own_model")) | ~F.col("effort").eqNullSafe(F.col("own_effort"))
    return chosen.groupBy("runtime").agg(F.bool_or(other).alias("elsewhere"), F.array_sort(F.collect_set(F.when(other, F.concat_ws("/", "model", "effort")))).alias("measured_with"))


def distinct_presets(rows: DataFrame) -> DataFrame:
    """The presets worth showing: ``everything``, and those whose numbers differ from it; all, if it has no words or isn't there. ``rows``: run_id, preset, words, utterances."""
    whole = rows.where("preset = 'everything'").select("run_id", F.col("words").alias("_w"), F.col("utterances").alias("_u"))
    both = rows.join(whole, "run_id", "left")
    keep = F.col("_w").isNull() | (F.col("_w") == 0) | (F.col("preset") == "everything") | (F.col("words") != F.col("_w")) | (F.col("utterances") != F.col("_u"))
    return both.where(keep).drop("_w", "_u")


def minutes_by_tokens(p50: Column, p90: Column) -> tuple[Column, Column]:
    """(least, most) minutes of an estimate: the typical tokens at the fast rate, the conservative ones at the slow rate."""
    return p50 / fixed.TOKENS_PER_MINUTE_HIGH, p90 / fixed.TOKENS_PER_MINUTE_LOW


def validation_code(missing: Column, extra: Column, wrong: Column, extra_first: bool = False) -> Column:
    """The one code of a line with several faults: missing before extra fields, or the other way round."""
    m, e = (missing, "SCHEMA_MISSING_FIELD"), (extra, "SCHEMA_UNEXPECTED_FIELD")
    (a, x), (b, y) = (e, m) if extra_first else (m, e)
    return F.when(a, x).when(b, y).when(wrong, "SCHEMA_INVALID_VALUE")


def repair_list(diagnostics: DataFrame) -> DataFrame:
    """(file_name, code) of everything to be mended, each once; ``item_ref`` begins with the file's name."""
    return diagnostics.select(F.split("item_ref", ":")[0].alias("file_name"), "code").distinct()


def attested_version(reports: DataFrame) -> DataFrame:
    """By run and step the version of the check that passed it, or why there is none; ``reports``: run_id, step, passed, verifier_version (null: no report)."""
    refusal = F.when(F.col("verifier_version").isNull(), "no report").when(~F.col("passed"), "failed")
    return reports.select("run_id", "step", F.when(refusal.isNull(), F.col("verifier_version")).alias("version"), refusal.alias("refusal"))


def missing_record_files(authored: DataFrame, records: DataFrame) -> DataFrame:
    """Sessions of the authored step without a file of records."""
    return authored.select("session_seq").distinct().join(records.select("session_seq").distinct(), "session_seq", "left_anti").select(F.lit("LINEAGE_MISSING_INPUT").alias("code"), F.col("session_seq").cast("string").alias("item_ref"))


def assignments(rows: DataFrame) -> DataFrame:
    """What a step hands out: by session its rows and words."""
    return rows.groupBy("session_seq").agg(F.count("*").alias("records"), F.sum(text.count_words(F.col("text"))).alias("words"))


def reusable(steps: DataFrame) -> DataFrame:
    """Steps whose artifacts may be used again: those that weren't invalidated."""
    return steps.where(F.col("status") != "invalidated")
