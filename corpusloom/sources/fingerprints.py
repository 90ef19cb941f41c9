"""Fingerprints: short strings that say how an instance's storage looks and nothing of what it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .formats import HISTORY_OPTIONAL, HISTORY_REQUIRED, KNOWN_EXTRA_TABLES


def history(base: Column, line_ending: Column, parse_failures: Column, degraded: Column) -> Column:
    """The channel, its line ends, and whether its times parse."""
    return F.concat_ws(";", base, line_ending, F.when(parse_failures > 0, "ts-parse-errors"), F.when(degraded, "ts-degraded"))


def chats(files: DataFrame) -> DataFrame:
    """By instance the generation of its supported files (or ``mixed``, or ``empty``) and the features that any of them has.

    ``files``: instance, supported, generation, display, notices, kind, subagent_dirs, checkpoints.
    """
    own = F.col("supported")
    out = files.groupBy("instance").agg(
        F.array_sort(F.collect_set(F.when(own, F.col("generation")))).alias("g"), *[F.coalesce(F.bool_or(own & F.col(c)), F.lit(False)).alias(c) for c in ("display", "notices", "kind")], *[F.bool_or(c).alias(c) for c in ("subagent_dirs", "checkpoints")],
    )
    base = F.when(F.size("g") == 0, "empty").when(F.size("g") > 1, "mixed").otherwise(F.col("g")[0])
    return out.select("instance", F.concat_ws("+", base, *[F.when(F.col(c), n) for c, n in (("display", "display"), ("notices", "notices"), ("kind", "kind"), ("subagent_dirs", "subagent-dirs"), ("checkpoints", "checkpoints"))]).alias("fingerprint"))


def composers(scans: DataFrame) -> DataFrame:
    """By store the generations that it has and the versions of its composers and bubbles; ``scans``: of ``composers.store_scan``, with the flags ``g1``, ``g2`` and ``g5`` of legacy material."""
    v, b = F.col("composer_versions"), F.col("bubble_versions")
    names = F.concat_ws("+", F.when(F.col("g1"), "g1"), F.when(F.col("g2"), "g2"), F.when(F.col("embedded") > 0, "g3"), F.when(F.col("current") > 0, "g4"), F.when(F.col("g5"), "g5"))
    low, high = F.array_min(v).cast("string"), F.array_max(v).cast("string")
    return scans.select("path", F.concat_ws(";", F.when(names == "", "empty").otherwise(names), F.when(F.size(v) > 0, F.concat(F.lit("composer_v="), low, F.when(low != high, F.concat(F.lit("-"), high)).otherwise(""))), F.when(F.size(b) > 0, F.concat(F.lit("bubble_v="), F.array_join(F.transform(b, lambda x: x.cast("string")), ",")))).alias("fingerprint"))


def dictation(structure: DataFrame, migrations: DataFrame | None = None) -> DataFrame:
    """By store how many optional columns its history has, its migrations, and its other tables, known and unknown; ``structure``: of ``stores.structure``, ``migrations``: path, n."""
    name, own = F.lower("tbl"), F.lower(F.col("tbl")) == "history"
    extra = ~own & (name != "sequelizemeta") & ~name.startswith("sqlite_")
    out = structure.groupBy("path").agg(F.array_sort(F.collect_set(F.when(own, F.lower("col")))).alias("have"), F.bool_or(F.coalesce(own, F.lit(False))).alias("history"), F.collect_set(F.when(extra, name)).alias("others"))
    out = out.withColumn("n", F.lit(None).cast("long")) if migrations is None else out.join(migrations.select("path", "n"), "path", "left")
    has = lambda names: F.size(F.array_intersect("have", F.array(*[F.lit(n.lower()) for n in names])))
    known = F.size(F.array_intersect("others", F.array(*map(F.lit, KNOWN_EXTRA_TABLES))))
    steps = F.when(F.col("n").isNull(), "mig-none").otherwise(F.concat(F.lit("mig"), "n"))
    shape = F.concat(F.lit("history-2024/opt"), has(HISTORY_OPTIONAL), F.lit(f"of{len(HISTORY_OPTIONAL)}/"), steps, F.lit("/extra"), known, F.lit("+"), F.size("others") - known)
    return out.select("path", F.when(~F.col("history"), "unsupported:no-history").when(has(HISTORY_REQUIRED) < len(HISTORY_REQUIRED), "unsupported:missing-required").otherwise(shape).alias("fingerprint"))


def proven_variant(os_environment: Column, accessibility: Column) -> Column:
    """Editor states are held against prompts only where that was shown to work."""
    return (os_environment == "macos") & (accessibility == "found")
