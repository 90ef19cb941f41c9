"""Cached quotas of a host: windows of an object whose keys nobody promised, read with a check of every shape; any surprise is an unknown, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .formats import QUOTA_AGE_LIMIT, QUOTA_INSTANT, QUOTA_WINDOWS
from .records import is_object, kind, string

_CACHE = "$.cachedUsageUtilization"


def _number(v: Column, path: str) -> Column:
    """A number at the path; booleans and strings are none."""
    own = kind(v, path)
    return F.when(own.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(own, F.lit("DECIMAL")), F.variant_get(v, path, "double"))


def windows(configs: DataFrame) -> DataFrame:
    """(path, name, utilization, resets_at): the windows that the configuration (path, value) states, in whole percent; ``resets_at`` only if it is an instant."""
    rows = configs.select("path", F.try_parse_json("value").alias("v"))
    own = F.when(is_object(F.col("v"), f"{_CACHE}.utilization"), F.variant_get("v", f"{_CACHE}.utilization", "map<string,variant>"))
    each = rows.select("path", F.explode(own).alias("name", "w")).where(F.col("name").isin(*QUOTA_WINDOWS) & is_object(F.col("w"), "$"))
    at = string(F.col("w"), "$.resets_at")
    found = each.select("path", "name", _number(F.col("w"), "$.utilization").alias("used"), F.when(at.rlike(QUOTA_INSTANT), at).alias("resets_at"))
    return found.where("used is not null").select("path", "name", F.when(F.col("used") < 0, F.ceil("used")).otherwise(F.floor("used")).cast("long").alias("utilization"), "resets_at")


def allowance(configs: DataFrame, now: Column) -> DataFrame:
    """By configuration: how many windows, the tightest one (the first by name among equals), whether overage is on, the age of the figures in seconds, and whether they are stale.

    ``now``: seconds since the epoch. A file that is no JSON object, or has another shape, has no windows, and null for all the rest.
    """
    v = F.col("v")
    rows = configs.select("path", F.try_parse_json("value").alias("v"))
    on = F.when(kind(v, f"{_CACHE}.utilization.extra_usage.is_enabled") == "BOOLEAN", F.variant_get(v, f"{_CACHE}.utilization.extra_usage.is_enabled", "boolean"))
    age = F.when(is_object(v, _CACHE), F.greatest(F.lit(0.0), now.cast("double") - _number(v, f"{_CACHE}.fetchedAtMs") / 1000))
    age = F.when(_number(v, f"{_CACHE}.fetchedAtMs").isNotNull(), age)
    best = windows(configs).groupBy("path").agg(F.count("*").alias("windows"), F.max_by(F.struct("name", "utilization", "resets_at"), F.struct("utilization", (F.col("name") == min(QUOTA_WINDOWS)).alias("first"))).alias("t"))
    out = rows.select("path", on.alias("overage_enabled"), age.alias("age_seconds")).join(best, "path", "left")
    return out.select("path", F.coalesce("windows", F.lit(0)).cast("long").alias("windows"), F.col("t.name").alias("tightest"), F.col("t.utilization").alias("utilization"), F.col("t.resets_at").alias("resets_at"), "overage_enabled", "age_seconds", F.coalesce(F.col("age_seconds") > QUOTA_AGE_LIMIT, F.lit(False)).alias("stale"))
