"""Session folders of the third generation of tasks: ``sessions/<id>/<id>.messages.json`` beside a manifest ``<id>.json``.

Only the file that bears its folder's name is a source; other agents' files are counted by name and never read. A session goes wholly if its manifest says that it wasn't
interactive, if it is another agent's or another session's, of another version, or if over a tenth of its messages are no objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import formats
from .records import elements, has_key, is_array, is_object, kind, string, strip
from .task_trees import UNRECOGNISED_SHARE


def _false(v: Column, path: str) -> Column:
    return (kind(v, path) == "BOOLEAN") & (F.variant_get(v, path, "string") == "false")


def located(found: DataFrame) -> DataFrame:
    """Files (path, file_name, modified, value) with ``folder`` and ``unit`` (the folder's name), and what each is: lead, manifest or other messages."""
    rows = found.withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]+$", 1)).withColumn("unit", F.regexp_extract("path", "([^/]+)/[^/]+$", 1))
    what = F.when(F.col("file_name") == F.concat("unit", F.lit(formats.MESSAGES_SUFFIX)), "lead").when(F.endswith("file_name", F.lit(formats.MESSAGES_SUFFIX)), "other").when(F.col("file_name") == F.concat("unit", F.lit(".json")), "manifest")
    return rows.withColumn("what", what).where("what is not null")


def units(found: DataFrame) -> DataFrame:
    """By folder its status (supported, excluded, malformed, unsupported), the number of messages and of files of other agents, and the time that stands for missing ones."""
    rows = located(found).withColumn("v", F.when(F.col("what") != "other", F.try_parse_json("value")))
    v = F.col("v")
    lead, own = F.col("what") == "lead", F.col("what") == "manifest"
    version = F.when(kind(v, "$.version").isin("BIGINT", "DOUBLE") | F.startswith(kind(v, "$.version"), F.lit("DECIMAL")), F.variant_get(v, "$.version", "double"))
    agent = has_key(v, "$.agent") & (kind(v, "$.agent") != "VOID") & ~F.coalesce(string(v, "$.agent") == "lead", F.lit(False))
    state = (
        F.when(~is_object(v, "$"), "malformed").when(~version.eqNullSafe(F.lit(1.0)), "unsupported").when(agent, "excluded").when(F.coalesce(string(v, "$.sessionId") != F.col("unit"), F.lit(False)), "excluded")
        .when(~is_array(v, "$.messages"), "malformed").otherwise("supported")
    )
    messages = F.when(is_array(v, "$.messages"), elements(v, "$.messages"))
    per = rows.groupBy("folder", "unit").agg(
        F.count_if(F.col("what") == "other").alias("other_files"), F.max(F.when(lead, state)).alias("lead_state"), F.max(F.when(lead, F.size(messages))).alias("n"), F.max(F.when(lead, F.size(F.filter(messages, lambda m: ~is_object(m, "$"))))).alias("odd"),
        F.max(F.when(lead, F.col("modified"))).alias("file_ts"), F.bool_or(own & _false(v, "$.interactive")).alias("alone"), F.max(F.when(own, text.iso_timestamp(string(v, "$.started_at")))).alias("started"),
    )
    status = (
        F.when(F.coalesce("alone", F.lit(False)), "excluded").when(F.col("lead_state").isNull(), F.when(F.col("other_files") > 0, "excluded").otherwise("malformed"))
        .when((F.col("lead_state") == "supported") & (F.col("n") > 0) & (F.col("odd") * UNRECOGNISED_SHARE > F.col("n")), "unsupported").otherwise(F.col("lead_state"))
    )
    return per.select("folder", "unit", status.alias("status"), F.when(status.isin("supported", "unsupported"), F.col("n")).alias("messages"), "other_files", F.coalesce("started", "file_ts").alias("fallback_ts"))


def _part(x: Column) -> Column:
    """struct(text, unwrapped) of one text block: what stands in the user's input tag, or the whole without mode notices; null for what the runtime composed."""
    plain = F.regexp_replace(x, formats.MODE_NOTICE, "")
    tagged = F.regexp_count(plain, F.lit(formats.USER_INPUT)) > 0
    body = strip(F.when(tagged, F.regexp_extract(plain, formats.USER_INPUT, 1)).otherwise(plain))
    gone = F.lit(False)
    for p in formats.INJECTED_BLOCKS:
        gone = gone | F.ltrim(x).startswith(p)
    for p in formats.COMPOSED_PREFIXES:
        gone = gone | body.startswith(p)
    return F.when(~gone & ~x.contains(formats.USER_COMMAND) & (body != ""), F.struct(body.alias("text"), (~tagged).alias("unwrapped")))


def utterances(found: DataFrame) -> DataFrame:
    """The user's messages of supported sessions: folder, unit, record, ref, text, text_status, flags, confidence, ts. A message with a tool's result is none."""
    good = units(found).where("status = 'supported'").select("folder", "unit", "fallback_ts")
    rows = located(found).where("what = 'lead'").withColumn("v", F.try_parse_json("value")).join(good, ["folder", "unit"])
    each = rows.select("folder", "unit", "fallback_ts", F.posexplode(elements(F.col("v"), "$.messages")).alias("record", "m"))
    m, v = F.col("m"), lambda x: F.filter(elements(F.col("m"), "$.content"), x)
    each = each.where(string(m, "$.role").eqNullSafe(F.lit("user")) & is_array(m, "$.content"))
    result = F.size(v(lambda b: string(b, "$.type").eqNullSafe(F.lit("tool_result")))) > 0
    texts = F.transform(v(lambda b: string(b, "$.type").eqNullSafe(F.lit("text")) & string(b, "$.text").isNotNull()), lambda b: F.variant_get(b, "$.text", "string"))
    each = each.where(~result).withColumn("parts", F.filter(F.transform(texts, _part), lambda p: p.isNotNull())).where(F.size("parts") > 0)
    loose = F.exists("parts", lambda p: p["unwrapped"])
    ms = F.when(kind(m, "$.ts").isin("BIGINT", "DOUBLE"), F.variant_get(m, "$.ts", "double"))
    return each.select(
        "folder", "unit", "record", F.coalesce(F.nullif(string(m, "$.id"), F.lit("")), F.format_string("m%04d", F.col("record") + 1)).alias("ref"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text"),
        F.when(loose, "unknown").otherwise("verbatim").alias("text_status"), F.when(loose, F.array(F.lit("unwrapped_user_text"))).otherwise(F.array().cast("array<string>")).alias("flags"), F.when(loose, 0.7).otherwise(0.9).cast("double").alias("confidence"), F.coalesce(text.epoch_ms(ms), "fallback_ts").alias("ts"),
    )


def task_time(task: Column) -> Column:
    """The time that a task's id states, if it is one of milliseconds."""
    return F.when(task.rlike(r"\A[0-9]{1,18}\z"), text.epoch_ms(F.when(task.rlike(r"\A[0-9]{1,18}\z"), task).cast("double")))
