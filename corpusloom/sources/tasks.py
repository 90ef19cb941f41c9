"""Task folders: user text in wrappers inside API histories, with times from the UI's own stream.

Rows are (path, record, ...) where ``path`` is the task; a history is one JSON document, a list of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators.dedup import first_of
from .formats import INJECTED_BLOCKS, INSTRUCTIONS, MENTION_MARKER, MENTION_TAGS, WRAPPERS
from .records import elements, is_array, is_object, kind, string, strip


def documents(found: DataFrame) -> DataFrame:
    """A row for each record of each document that is a JSON list: path, record, v. Others are reported by ``broken``."""
    rows = found.withColumn("doc", F.try_parse_json("value")).where(is_array(F.col("doc"), "$"))
    return rows.select("path", F.posexplode(elements(F.col("doc"), "$")).alias("record", "v"))


def broken(found: DataFrame) -> DataFrame:
    return found.withColumn("doc", F.try_parse_json("value")).where(~is_array(F.col("doc"), "$")).select(F.when(F.col("doc").isNull(), "SOURCE_MALFORMED_FILE").otherwise("SOURCE_UNSUPPORTED_SCHEMA").alias("code"), F.col("path").alias("item_ref"))


def _text_of(block: Column) -> Column:
    """The texts of a block: its own, or those of a tool's result."""
    none = F.array().cast("array<string>")
    inner = F.transform(F.filter(elements(block, "$.content"), lambda p: string(p, "$.type").eqNullSafe(F.lit("text")) & string(p, "$.text").isNotNull()), lambda p: F.variant_get(p, "$.text", "string"))
    own = string(block, "$.text")
    what = string(block, "$.type")
    return F.when(what.eqNullSafe(F.lit("text")) & own.isNotNull(), F.array(own)).when(what.eqNullSafe(F.lit("tool_result")) & (kind(block, "$.content") == "STRING"), F.array(F.variant_get(block, "$.content", "string"))).when(what.eqNullSafe(F.lit("tool_result")), inner).otherwise(none)


def payloads(records: DataFrame) -> DataFrame:
    """A row for each text of the user's records: path, record, at, payload, is_result."""
    v = F.col("v")
    own = records.where(string(v, "$.role").eqNullSafe(F.lit("user")))
    blocks = F.when(kind(v, "$.content") == "STRING", F.array(F.struct(F.lit(False).alias("r"), F.array(F.variant_get(v, "$.content", "string")).alias("t")))).otherwise(F.transform(elements(v, "$.content"), lambda b: F.struct(string(b, "$.type").eqNullSafe(F.lit("tool_result")).alias("r"), _text_of(b).alias("t"))))
    each = own.select("path", "record", "v", F.posexplode(blocks).alias("block", "b"))
    return each.select("path", "record", "v", "block", F.col("b.r").alias("is_result"), F.posexplode("b.t").alias("part", "payload"))


def spans(rows: DataFrame) -> DataFrame:
    """Wrapped spans of payloads by the balanced rule: a payload with an unbalanced wrapper gives none; spans with injected mentions go."""
    p = F.col("payload")
    injected, balanced, found = F.lit(False), F.lit(True), []
    for x in INJECTED_BLOCKS:
        injected = injected | F.ltrim(p).startswith(x)
    for w in WRAPPERS:
        balanced = balanced & (F.regexp_count(p, F.lit(f"<{w}>")) == F.regexp_count(p, F.lit(f"</{w}>")))
        found.append(F.transform(F.regexp_extract_all(p, F.lit(f"(?s)<{w}>(.*?)</{w}>"), F.lit(1)), _span(w)))
    kept = F.when(~injected & balanced, F.flatten(F.array(*found))).otherwise(F.expr("array()").cast("array<struct<wrapper:string,text:string>>"))
    out = rows.withColumn("balanced", balanced | injected).select(*rows.columns, "balanced", F.posexplode(kept).alias("span", "s")).select(*rows.columns, "balanced", "span", "s.*").where("text <> ''")
    for x in MENTION_TAGS:
        out = out.where(~F.col("text").contains(x))
    tag = F.regexp_extract("text", r"^<([A-Za-z][A-Za-z0-9_-]*)[\s>]", 1)
    return out.withColumn("flags", F.array_compact(F.array(F.when((tag != "") & (tag != "explicit_instructions"), F.lit("unknown_wrapper"))))).withColumn("text_status", F.when(F.col("text").rlike(MENTION_MARKER), "cleaned").otherwise("verbatim"))


def _span(wrapper: str):
    return lambda t: F.struct(F.lit(wrapper).alias("wrapper"), strip(F.regexp_replace(t, INSTRUCTIONS, "")).alias("text"))


def spans_any(rows: DataFrame) -> DataFrame:
    """The other rule: spans of whichever wrapper closes what it opened; an opener left over excludes the payload, and so does nested context its span."""
    p = F.col("payload")
    whole = r"(?s)<(task|feedback|answer|user_message)>(.*?)</\1>"
    left = F.regexp_replace(p, whole, "").rlike(r"<(?:task|feedback|answer|user_message)>")
    found = F.when(~left, F.regexp_extract_all(p, F.lit(whole), F.lit(2))).otherwise(F.array().cast("array<string>"))
    out = rows.select(*rows.columns, F.posexplode(F.transform(found, strip)).alias("span", "text")).where((F.col("text") != "") & ~F.col("text").contains("<environment_details>"))
    return out.withColumn("flags", F.array_compact(F.array(F.when(F.col("text").rlike(r"</?[A-Za-z][A-Za-z0-9_.-]*(?:\s[^<>]*)?/?>"), F.lit("unknown_wrapper"))))).withColumn("text_status", F.when(F.col("text").contains("(see below for file content)") | F.col("text").contains("<file_content") | F.col("text").rlike(r"'[^'\n]*'\s*\(see below"), "cleaned").otherwise("verbatim"))


def status_feedback(rows: DataFrame) -> DataFrame:
    """Feedback inside payloads that are a JSON object with ``status``."""
    j = F.try_parse_json(strip(F.col("payload")))
    seen = rows.withColumn("_j", j).where(is_object(F.col("_j"), "$") & kind(F.col("_j"), "$.status").isNotNull())
    return seen.withColumn("text", strip(string(F.col("_j"), "$.feedback"))).where("text <> ''").drop("_j")


def new_task_arguments(records: DataFrame) -> DataFrame:
    """(argument) of every delegated task, white space made even."""
    uses = records.select(F.explode(elements(F.col("v"), "$.content")).alias("b")).where(string(F.col("b"), "$.type").eqNullSafe(F.lit("tool_use")) & string(F.col("b"), "$.name").eqNullSafe(F.lit("new_task")))
    args = uses.select(F.explode(F.array(string(F.col("b"), "$.input.context"), string(F.col("b"), "$.input.message"))).alias("argument")).where("argument is not null")
    return args.select(even(F.col("argument")).alias("argument")).where("argument <> ''").distinct()


def even(x: Column) -> Column:
    """White space collapsed to single blanks."""
    return F.array_join(text.split_words(x), " ")


def own_tasks(found: DataFrame, arguments: DataFrame) -> DataFrame:
    """Spans of the tasks whose first text no other task handed over."""
    first = found.groupBy("path").agg(F.min_by("text", F.struct("record", "block", "part", "span")).alias("first"))
    delegated = first.withColumn("argument", even(F.col("first"))).join(arguments, "argument", "left_semi").select("path")
    return found.join(delegated, "path", "left_anti")


def feedback_times(ui: DataFrame) -> DataFrame:
    """From the UI's records (path, record, v): (path, n, ts), n is 0 for the task and counts the feedback from 1."""
    v = F.col("v")
    said = ui.where(string(v, "$.type").eqNullSafe(F.lit("say"))).withColumn("say", string(v, "$.say")).withColumn("ts", text.epoch_ms(F.when(kind(v, "$.ts").isin("BIGINT", "DOUBLE"), F.variant_get(v, "$.ts", "double"))))
    task = said.where("say = 'task'").groupBy("path").agg(F.min_by(F.struct("ts"), "record").alias("t")).select("path", F.lit(0).alias("n"), "t.ts")
    after = said.where(F.col("say").isin("user_feedback", "user_feedback_diff")).withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("record")))
    return task.union(after.select("path", "n", "ts"))


def timed(found: DataFrame, times: DataFrame, start: Column) -> DataFrame:
    """Spans with times by place: the first is the task, the n-th of the others the n-th feedback; else ``start``, the task's own."""
    n = F.row_number().over(Window.partitionBy("path").orderBy("record", "block", "part", "span")) - 1
    return found.withColumn("n", n).join(times, ["path", "n"], "left").withColumn("ts", F.coalesce("ts", start)).drop("n")


def one_of_each_text(found: DataFrame, hash_of: Column) -> DataFrame:
    """Of equal texts the earliest, then by path and place."""
    rows = found.withColumn("_h", hash_of)
    return first_of(rows, ["_h"], [F.col("ts").isNull(), F.coalesce(F.col("ts"), F.lit("9999-12-31").cast("timestamp")), F.col("path"), F.col("record"), F.col("block"), F.col("part"), F.col("span")]).drop("_h")
