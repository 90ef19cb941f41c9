"""Reviews: toggles as a log of changes whose counts follow by differences, and packages checked against the review that they come from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from . import digests, partitions
from .common import materialize
from .counts import canonical_json

BUCKETS = 64
STATE = "run_id long, record_id string, included boolean, seq long"


def latest_changes(changes: DataFrame) -> DataFrame:
    """Of each record's changes (run_id, record_id, seq, included) the last one."""
    return changes.groupBy("run_id", "record_id").agg(F.max(F.struct("seq", "included")).alias("c")).select("run_id", "record_id", "c.seq", "c.included")


def toggled(records: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records after the changes, differences of the counts by run).

    ``records``: run_id, record_id, included, seq (of the change in force, null for none). Changes of unknown records and changes older than the one in force do nothing.
    Only records that a change names are looked at for the differences: (run_id, shared, withheld) to be added to the counts.
    """
    last = latest_changes(changes).withColumnsRenamed({"seq": "new_seq", "included": "new_included"})
    both = records.join(last, ["run_id", "record_id"], "left")
    newer = F.col("new_seq").isNotNull() & (F.col("seq").isNull() | (F.col("new_seq") > F.col("seq")))
    after = both.select("run_id", "record_id", F.when(newer, F.col("new_included")).otherwise(F.col("included")).alias("included"), F.when(newer, F.col("new_seq")).otherwise(F.col("seq")).alias("seq"))
    moved = records.join(last, ["run_id", "record_id"]).where(newer & (F.col("included") != F.col("new_included")))
    step = F.when(F.col("new_included"), 1).otherwise(-1)
    return after, moved.groupBy("run_id").agg(F.sum(step).alias("shared"), F.sum(-step).alias("withheld"))


def recounted(counts: DataFrame, difference: DataFrame) -> DataFrame:
    """Counts (run_id, shared_mistakes, withheld_by_user, ...) with a difference added; other columns stay."""
    both = counts.join(difference, "run_id", "left").na.fill(0, ["shared", "withheld"])
    return both.withColumn("shared_mistakes", F.col("shared_mistakes") + F.col("shared")).withColumn("withheld_by_user", F.col("withheld_by_user") + F.col("withheld")).drop("shared", "withheld").select(*counts.columns)


def record_counts(records: DataFrame) -> DataFrame:
    """The recount of all records."""
    return records.groupBy("run_id").agg(F.count_if("included").alias("shared_mistakes"), F.count_if(~F.col("included")).alias("withheld_by_user"))


def kept_toggles(path: str, changes: DataFrame) -> DataFrame:
    """Apply changes to the review at ``path`` (a table of partitions with the columns of ``STATE``); only partitions with a changed record are written. Returns the differences."""
    spark = changes.sparkSession
    bucket = F.pmod(F.xxhash64("run_id", "record_id"), F.lit(BUCKETS)).cast("long")
    touched = changes.select(bucket.alias("bucket")).distinct()
    old = partitions.read(spark, path, STATE, "bucket", form="parquet").join(touched, "bucket", "left_semi")
    after, difference = toggled(old.drop("bucket"), changes)
    difference = materialize(difference, "difference")
    if not difference.isEmpty():
        partitions.change(materialize(after.withColumn("bucket", bucket), "toggled"), path, "bucket", ["run_id", "record_id"], form="parquet")
    return difference


def new_review(path: str, records: DataFrame) -> int:
    """Write the records (run_id, record_id, included) as a review that nobody has changed yet."""
    bucket = F.pmod(F.xxhash64("run_id", "record_id"), F.lit(BUCKETS)).cast("long")
    rows = records.select(F.col("run_id").cast("long").alias("run_id"), F.col("record_id").cast("string").alias("record_id"), "included", F.lit(None).cast("long").alias("seq")).withColumn("bucket", bucket)
    return partitions.change(rows, path, "bucket", ["run_id", "record_id"], form="parquet")


def package(records: DataFrame, header: dict[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, header, nodes): the included records in the order of their ids with their digests, one row of the header, and the tree that its hash covers."""
    content = [c for c in records.columns if c != "included"]
    kept = records.where("included").select(*content)
    nodes = digests.tree(kept, ["record_id"], content)
    rows = kept.withColumn("record_sha256", digests.record_digest(content))
    head = digests.root(nodes).select(*[v.alias(k) for k, v in header.items()], "records", "records_sha256")
    names = head.columns
    return rows, head.withColumn("payload_hash", F.sha2(canonical_json({c: F.col(c) for c in names}), 256)), nodes


def package_diagnostics(rows: DataFrame, head: DataFrame, texts: dict[str, str], content: list[str]) -> DataFrame:
    """The gate of one package: (code, item_ref).

    Its hash, which is made anew from the rows; that it has records; that the version fields are plain versions and pass the scan; and the scan of every record.
    ``texts``: the columns for rule, mistake, example and source_type.
    """
    made = digests.root(digests.tree(rows, ["record_id"], content)).withColumnsRenamed({"records": "n", "records_sha256": "digest"})
    one = head.crossJoin(F.broadcast(made))  # one row each
    names = [c for c in head.columns if c != "payload_hash"]
    true_hash = F.sha2(canonical_json({c: F.col("digest") if c == "records_sha256" else F.col("n") if c == "records" else F.col(c) for c in names}), 256)
    fault = lambda code, where, ref: one.where(where).select(F.lit(code).alias("code"), F.lit(ref).alias("item_ref"))
    found = [fault("SUBMISSION_HASH_MISMATCH", ~true_hash.eqNullSafe(F.col("payload_hash")), None), fault("SUBMISSION_NO_RECORDS", F.col("n") == 0, None)]
    for field in (c for c in fixed.VERSION_FIELDS if c in head.columns):
        value = F.col(field).cast("string")
        found.append(fault("SUBMISSION_FORBIDDEN_FIELD", ~F.coalesce(value.rlike(fixed.VERSION_PATTERN), F.lit(False)), field))
        found.append(one.select(F.explode(text.version_codes(F.coalesce(value, F.lit("")))).alias("code"), F.lit(field).alias("item_ref")))
    codes = text.record_codes(*[F.coalesce(F.col(texts[k]), F.lit("")) for k in ("rule", "mistake", "example", "source_type")])
    found.append(rows.select(F.explode(codes).alias("code"), F.concat(F.lit("records["), "record_id", F.lit("]")).alias("item_ref")))
    return reduce(DataFrame.unionByName, (f.select("code", F.col("item_ref").cast("string").alias("item_ref")) for f in found))


def package_against_review(rows: DataFrame, head: DataFrame, reviewed: DataFrame, content: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Differences of a package from the included records of its review, one for each place, and of its counts from ``counts`` (one row, columns named as in the header)."""
    own, want = digests.tree(rows, ["record_id"], content), digests.tree(reviewed.where("included"), ["record_id"], content)
    out = digests.differences(own, want).select(F.lit("SUBMISSION_COUNT_MISMATCH").alias("code"), F.coalesce("left_ref", "right_ref").alias("item_ref"))
    if counts is not None:
        one = head.crossJoin(F.broadcast(counts.select(*[F.col(c).alias(f"_{c}") for c in counts.columns])))  # one row each
        differ = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in counts.columns])
        out = out.unionByName(one.where(differ).select(F.lit("SUBMISSION_COUNT_MISMATCH").alias("code"), F.lit("counts").alias("item_ref")))
    return out


#: Counts of a run that its modalities partition.
PARTITIONED = ("eligible_words", "analyzed_words", "eligible_utterances", "analyzed_utterances")
COUNT_COLUMNS = (*PARTITIONED, "written", "spoken_asr", "verified_total_mistakes", "shared_mistakes", "withheld_by_user", "withheld_for_privacy", "other_withheld")


def audit_counts(modalities: DataFrame, records: DataFrame) -> DataFrame:
    """One row for each run: the totals of its modalities, which stay beside them as structs, and its mistakes by what became of them.

    ``modalities``: run_id, modality (written or spoken_asr) and the four counts; ``records``: run_id, fate (shared, user, privacy, or another reason's code).
    """
    part = lambda m: F.struct(*[F.coalesce(F.sum(F.when(F.col("modality") == m, F.col(c))), F.lit(0)).alias(c) for c in PARTITIONED]).alias(m)
    counted = modalities.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in PARTITIONED], part("written"), part("spoken_asr"))
    fates = records.groupBy("run_id", "fate").agg(F.count("*").alias("n"))
    of = lambda name: F.coalesce(F.sum(F.when(F.col("fate") == name, F.col("n"))), F.lit(0))
    others = F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("fate").isin("shared", "user", "privacy"), F.struct("fate", "n")))))  # a few codes
    mistakes = fates.groupBy("run_id").agg(F.sum("n").alias("verified_total_mistakes"), of("shared").alias("shared_mistakes"), of("user").alias("withheld_by_user"), of("privacy").alias("withheld_for_privacy"), others.alias("other_withheld"))
    out = counted.join(mistakes, "run_id", "left").na.fill(0, ["verified_total_mistakes", "shared_mistakes", "withheld_by_user", "withheld_for_privacy"])
    return out.withColumn("other_withheld", F.coalesce("other_withheld", F.create_map().cast("map<string,bigint>"))).select("run_id", *COUNT_COLUMNS)


def audit_violations(counts: DataFrame, reasons: tuple[str, ...] = fixed.WITHHELD_REASONS) -> DataFrame:
    """(run_id, invariant) of every broken rule: mistakes that don't add up, more analyzed than eligible, modalities that don't sum to the whole, negative counts, unknown reasons."""
    other = F.aggregate(F.map_values("other_withheld"), F.lit(0).cast("long"), lambda a, n: a + n)
    kept = F.col("shared_mistakes") + F.col("withheld_by_user") + F.col("withheld_for_privacy") + other
    rules = {"mistakes": kept == F.col("verified_total_mistakes"), "words_bounded": F.col("analyzed_words") <= F.col("eligible_words"), "utterances_bounded": F.col("analyzed_utterances") <= F.col("eligible_utterances")}
    rules |= {f"partition_{c}": F.col(f"written.{c}") + F.col(f"spoken_asr.{c}") == F.col(c) for c in PARTITIONED}
    plain = [c for c in COUNT_COLUMNS if c not in ("written", "spoken_asr", "other_withheld")]
    rules["not_negative"] = reduce(lambda a, b: a & b, [F.col(c) >= 0 for c in plain]) & ~F.exists(F.map_values("other_withheld"), lambda n: n < 0)
    rules["known_reasons"] = F.size(F.array_except(F.map_keys("other_withheld"), F.array(*map(F.lit, reasons)))) == 0
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return counts.select("run_id", F.explode(broken).alias("invariant"))


def submission_counts(counts: DataFrame) -> DataFrame:
    """What of a run's counts goes into its package; runs with a broken rule have none."""
    return counts.join(audit_violations(counts).select("run_id").distinct(), "run_id", "left_anti").select("run_id", *COUNT_COLUMNS)


def not_counted(index: DataFrame, removed: DataFrame) -> DataFrame:
    """By run what its counts leave out: utterances of quarantined sessions, and duplicates removed; ``index``: run_id, quarantined_utterances; ``removed``: run_id, session_seq, ids (an array)."""
    quarantined = index.groupBy("run_id").agg(F.sum("quarantined_utterances").alias("unjudged"))
    gone = removed.groupBy("run_id").agg(F.sum(F.size("ids")).alias("duplicates_removed"))
    return quarantined.join(gone, "run_id", "full_outer").na.fill(0, ["unjudged", "duplicates_removed"])
