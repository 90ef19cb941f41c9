"""Counts that reconcile, digests, estimates, lifecycle decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from .common import materialize


def modality_counts(utterances: DataFrame, analyzed: Column) -> DataFrame:
    """Eligible and analyzed words and utterances by modality, with the total as modality ``all``."""
    words = text.english_words(F.col("text"))
    rows = utterances.where(F.col("text").rlike(r"\S")).select("modality", words.alias("w"), analyzed.alias("a"))
    out = rows.rollup("modality").agg(
        F.sum("w").alias("eligible_words"),
        F.coalesce(F.sum(F.when(F.col("a"), F.col("w"))), F.lit(0)).alias("analyzed_words"),
        F.count("*").alias("eligible_utterances"),
        F.count_if("a").alias("analyzed_utterances"),
    )
    return out.withColumn("modality", F.coalesce("modality", F.lit("all")))


def reconciles(counts: DataFrame) -> DataFrame:
    """One row: whether the parts of ``modality_counts`` sum to the total and no analyzed count exceeds its eligible one."""
    names = ("eligible_words", "analyzed_words", "eligible_utterances", "analyzed_utterances")
    part = lambda c: F.sum(F.when(F.col("modality") != "all", F.col(c)).otherwise(0))
    total = lambda c: F.sum(F.when(F.col("modality") == "all", F.col(c)).otherwise(0))
    ok = F.lit(True)
    for c in names:
        ok = ok & (part(c) == total(c))
    return counts.agg(ok.alias("parts_sum"), F.bool_and((F.col("analyzed_words") <= F.col("eligible_words")) & (F.col("analyzed_utterances") <= F.col("eligible_utterances"))).alias("bounded"))


def digest(rows: DataFrame, by: list[str], order: list[str], line: Column, separator: str = "\n") -> DataFrame:
    """SHA-256 of the ordered lines of each group. The lines of one group (a session, a run's file list) are bounded."""
    listed = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], line.alias("_line"))))
    joined = F.array_join(F.transform(listed, lambda x: x["_line"]), separator)
    return rows.groupBy(*by).agg(F.sha2(joined, 256).alias("digest"))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys and kept nulls; nested structs must already be in order."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles (linear between neighbours) of the values of each key: a column for each share.

    Equal values are counted first; the counts lie in ranges of (key, value), and a value's place is the sum of the ranges before it and its own running sum. So the values of a
    key are spread over many tasks, however many there are.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranged = materialize(counted.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy(*by, "_part").agg(F.sum("_n").alias("_size"))  # a row for each key and range
    whole = Window.partitionBy(*by)
    places = parts.select(*by, "_part", (F.sum("_size").over(whole.orderBy("_part")) - F.col("_size")).alias("_before"), F.sum("_size").over(whole).alias("_total"))
    end = F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy(value)) + F.col("_before")
    placed = ranged.join(places, [*by, "_part"]).withColumn("_end", end).withColumn("_begin", F.col("_end") - F.col("_n"))
    out = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_total") - 1)
        pick = lambda rank: F.max(F.when((F.col("_begin") <= rank) & (rank < F.col("_end")), F.col(value)))  # noqa: B023, E731
        low, high = pick(F.floor(at)), pick(F.ceil(at))
        out.append((low + F.max(at - F.floor(at)) * (high - low)).alias(name))
    return placed.groupBy(*by).agg(*out)


def robust_center(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median and 90th percentile (linear) of the values within three median absolute deviations of the median."""
    center = percentiles(rows, by, value, {"center": 0.5})
    off = rows.join(center, by).withColumn("off", F.abs(F.col(value) - F.col("center")))
    spread = percentiles(off, by, "off", {"mad": 0.5})
    kept = off.join(spread, by).withColumn("kept", F.col("off") <= fixed.MAD_CLAMP * F.col("mad"))
    inside = percentiles(kept.where("kept"), by, value, {"p50": 0.5, "p90": 0.9})
    used = kept.groupBy(*by).agg(F.count_if("kept").alias("records_used"), F.count_if(~F.col("kept")).alias("records_discarded"))
    return used.join(inside, by, "left").select(*by, "p50", F.greatest("p50", "p90").alias("p90"), "records_used", "records_discarded")


def window_fraction(first: Column, last: Column, start: Column, end: Column) -> Column:
    """Share of an instance's span inside a window, in epoch seconds; null if undated."""
    a, b = F.least(first, last), F.greatest(first, last)
    share = (F.least(b, end) - F.greatest(a, start)) / (b - a)
    inside = F.when((a >= start) & (a <= end), 1.0).otherwise(0.0)
    return F.when(first.isNull() | last.isNull(), F.lit(None)).when(b == a, inside).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def preset_counts(instances: DataFrame, presets: DataFrame, now: Column) -> DataFrame:
    """Words, utterances and undated instances of each preset window, with each instance's own contribution.

    ``instances``: adapter_id, instance_key, first, last (epoch seconds), candidate_words, candidate_messages; ``presets``: preset, ordinal, days.
    """
    start = F.when(F.col("days").isNull(), F.lit(0)).otherwise(now - F.col("days") * 86400)
    pairs = instances.crossJoin(F.broadcast(presets))  # six presets
    share = F.coalesce(window_fraction(F.col("first"), F.col("last"), start, now), F.lit(1.0))
    return pairs.withColumn("words", F.rint(F.col("candidate_words") * share).cast("long")).withColumn("utterances", F.rint(F.col("candidate_messages") * share).cast("long")).withColumn("undated", F.col("first").isNull() | F.col("last").isNull())


def idle_sources(contributions: DataFrame) -> DataFrame:
    """Apps that contribute nothing to a preset, by all their instances."""
    return contributions.groupBy("preset", "adapter_id").agg(F.bool_or((F.col("words") > 0) | (F.col("utterances") > 0)).alias("live")).where(~F.col("live")).select("preset", "adapter_id")


def step_tokens(words: Column, units: Column, cell: str, per_call: int = fixed.MESSAGES_PER_SESSION) -> tuple[Column, Column]:
    """(p50, p90) tokens of one step from a profile cell, a struct column."""
    c = F.col(cell)
    fixed_cost = F.ceil(units / per_call) * c["fixed_input_tokens_per_batch"]
    adjusted = (words - units * c["average_words_per_message"]) * c["input_tokens_per_word"]
    p50 = F.greatest(fixed_cost, F.ceil(units * c["p50_total_tokens_per_message"] + fixed_cost + adjusted))
    p90 = F.greatest(p50, F.ceil(units * c["p90_total_tokens_per_message"] + fixed_cost + adjusted))
    nothing = units == 0
    return F.when(nothing, 0).otherwise(p50).cast("long"), F.when(nothing, 0).otherwise(p90).cast("long")


def dearest_cells(profile: DataFrame) -> DataFrame:
    """The cell of each (step, runtime) with the largest p90, the first in order among equals."""
    best = F.max_by(F.struct(*profile.columns), F.struct("p90_total_tokens_per_message", (-F.col("ordinal")).alias("o")))
    return profile.groupBy("step", "runtime").agg(best.alias("cell"))


def estimate(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Tokens and minutes of each preset: ``counts`` has preset, words, utterances; ``cells`` one row of structs judge_authorship, find_mistakes, confirm_confidentiality."""
    rows = counts.crossJoin(F.broadcast(cells))  # one row
    units = F.col("utterances")
    analyzed, sessions = F.ceil(units * fixed.AUTHORED_UTTERANCE_RETENTION), F.ceil(units / fixed.MESSAGES_PER_SESSION)
    kept_words = F.rint(F.col("words") * fixed.AUTHORED_WORD_RETENTION).cast("long")
    steps = (
        step_tokens(F.col("words"), units, "judge_authorship"),
        step_tokens(kept_words, analyzed, "find_mistakes"),
        step_tokens(F.rint(sessions * F.col("confirm_confidentiality.average_words_per_message")).cast("long"), sessions, "confirm_confidentiality", 1),
    )
    sure = F.lit(True)
    for c in ("judge_authorship", "find_mistakes", "confirm_confidentiality"):
        sure = sure & (F.floor(F.col(f"{c}.messages_measured") / fixed.CALIBRATED_BATCH_SIZE) >= fixed.HIGH_CONFIDENCE_MIN_RECORDS)
    total_units = units + analyzed + sessions
    return rows.select(
        "preset", "words", "utterances",
        (steps[0][0] + steps[1][0] + steps[2][0]).alias("p50_tokens"),
        F.ceil((steps[0][1] + steps[1][1] + steps[2][1]) * F.when(sure, 1.0).otherwise(fixed.LOW_CONFIDENCE_WIDENING)).cast("long").alias("p90_tokens"),
        F.when(sure, "high").otherwise("low").alias("confidence"),
        (total_units * fixed.SECONDS_PER_UNIT_LOW / 60).alias("low_minutes"),
        (total_units * fixed.SECONDS_PER_UNIT_HIGH / 60 * F.when(sure, 1.0).otherwise(fixed.LOW_CONFIDENCE_WIDENING)).alias("high_minutes"),
    )


def recommend_preset(rows: DataFrame) -> DataFrame:
    """The smallest window of at least twice the target words, else the largest; ``ordinal`` breaks ties."""
    have = rows.where("words > 0")
    order = F.struct("words", "ordinal")
    enough = F.min_by("preset", F.when(F.col("words") >= 2 * fixed.TARGET_WORDS, order))
    return have.agg(F.coalesce(enough, F.max_by("preset", order)).alias("preset"))


def transitions(spark, table: dict[str, tuple[str, ...]]) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, targets in table.items() for b in targets], "from_status string, to_status string")


def illegal_transitions(observed: DataFrame, legal: DataFrame) -> DataFrame:
    return observed.join(F.broadcast(legal), ["from_status", "to_status"], "left_anti")  # a fixed table


def resume_decision(runs: DataFrame, current: DataFrame, now: Column) -> DataFrame:
    """expired, restart, invalidate_downstream (with the earliest step) or continue, for each run.

    ``runs``: run_id, status, last_checkpoint (epoch seconds), fingerprint (map); ``current``: one row with a map ``fingerprint``.
    """
    rows = runs.crossJoin(F.broadcast(current.select(F.col("fingerprint").alias("_now"))))  # one row
    changed = lambda name: ~F.col("fingerprint")[name].eqNullSafe(F.col("_now")[name])
    ended = F.col("status").isin("completed", "completed_with_exclusions", "expired")
    old = now - F.col("last_checkpoint") > fixed.RETENTION_DAYS * 86400
    restart = F.lit(False)
    for name in fixed.RESTART_FIELDS:
        restart = restart | changed(name)
    steps = F.array_compact(F.array(*[F.when(changed(name), F.lit(step)) for name, step in fixed.DOWNSTREAM_FIELDS]))
    decision = F.when(ended | old, "expired").when(restart, "restart").when(F.size(steps) > 0, "invalidate_downstream").otherwise("continue")
    return rows.select("run_id", decision.alias("decision"), F.when(decision == "invalidate_downstream", F.array_min(steps)).alias("earliest_step"))


def highest_version(rows: DataFrame, by: list[str], version: str) -> DataFrame:
    """The greatest version by numeric components."""
    parts = F.transform(F.split(version, r"\."), lambda x: x.cast("int"))
    return rows.groupBy(*by).agg(F.max_by(version, parts).alias("highest_version"))


def tightest_window(rows: DataFrame, by: list[str], name: str, used: str) -> DataFrame:
    """The quota window with the largest utilisation, the first by name among equals."""
    ranked = Window.partitionBy(*by).orderBy(F.col(used).desc(), name)
    return rows.withColumn("_n", F.row_number().over(ranked)).where("_n = 1").drop("_n")
