"""Task folders whose tasks hand work over to other tasks: the second of the two formats of ``tasks``, with rules of its own.

A task is a folder with a history (a JSON list of records), an item of metadata, and the UI's messages. Rows carry ``instance`` (the folder of all tasks) and ``task``. The user's
words stand in wrappers, or as the feedback of a JSON status; records that are summaries, marks of truncation or of a type of their own aren't words of the user. A task
that another one handed over is excluded whole: by its metadata, or, where it has none, because its first text is the argument of a hand-over.
Times come from the record, else the metadata, else the UI's first message, else the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators.common import materialize
from .formats import API_HISTORY, HISTORY_ITEM, LEGACY_UI, TASK_UI
from .records import MOST_BYTES, elements, has_key, is_array, is_object, is_true, kind, string, strip
from .tasks import _text_of, spans_any, status_feedback

SPAN_KEYS = ["instance", "task", "record", "block", "part"]
UNRECOGNISED_SHARE = 10


def located(found: DataFrame) -> DataFrame:
    """Files (path, file_name, file_size, modified, value) with instance and task from their path."""
    where = lambda i: F.regexp_extract("path", "^(.*)/([^/]+)/[^/]+$", i)
    return found.withColumn("instance", where(1)).withColumn("task", where(2))


def _ms(v: Column, path: str) -> Column:
    """A time from milliseconds, fractions included; null for what is no number or no time of a calendar."""
    own = kind(v, path)
    x = F.when(own.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(own, F.lit("DECIMAL")), F.variant_get(v, path, "double"))
    return F.when(x.between(-62_135_596_800_000, 253_402_300_799_999), F.timestamp_micros(F.round(x * 1000).cast("long")))


def elements_of(found: DataFrame) -> DataFrame:
    """A row for each record of each history that is a list: its role (null: not recognised), whether it can hold the user's words, its time, and the record."""
    v = F.col("v")
    rows = found.where(F.col("file_name") == API_HISTORY).withColumn("doc", F.try_parse_json("value")).where(is_array(F.col("doc"), "$"))
    each = rows.select("instance", "task", F.posexplode(elements(F.col("doc"), "$")).alias("record", "v"))
    content = (kind(v, "$.content") == "STRING") | is_array(v, "$.content")
    role = F.when(is_object(v, "$") & string(v, "$.role").isin("user", "assistant") & F.coalesce(content, F.lit(False)), string(v, "$.role"))
    other = is_true(v, "$.isSummary") | is_true(v, "$.isTruncationMarker") | has_key(v, "$.type")
    return each.select("instance", "task", "record", role.alias("role"), (role.eqNullSafe(F.lit("user")) & ~other).alias("own"), _ms(v, "$.ts").alias("ts"), "v")


def payloads(records: DataFrame) -> DataFrame:
    """A row for each text of the user's records, as ``tasks.payloads``."""
    v = F.col("v")
    blocks = F.when(kind(v, "$.content") == "STRING", F.array(F.struct(F.lit(False).alias("r"), F.array(F.variant_get(v, "$.content", "string")).alias("t")))).otherwise(F.transform(elements(v, "$.content"), lambda b: F.struct(string(b, "$.type").eqNullSafe(F.lit("tool_result")).alias("r"), _text_of(b).alias("t"))))
    each = records.where("own").select("instance", "task", "record", "ts", F.posexplode(blocks).alias("block", "b"))
    return each.select("instance", "task", "record", "ts", "block", F.col("b.r").alias("is_result"), F.posexplode("b.t").alias("part", "payload"))


def candidates(rows: DataFrame) -> DataFrame:
    """Spans of payloads, wrapped or as a status's feedback, with their place in the block."""
    keys = [*SPAN_KEYS, "ts"]
    wrapped = spans_any(rows).select(*keys, F.lit("wrapper").alias("carrier"), "span", "text", "flags", "text_status")
    # A payload with an opener left over is excluded whole, its feedback as well.
    open_left = F.regexp_replace("payload", r"(?s)<(task|feedback|answer|user_message)>(.*?)</\1>", "").rlike(r"<(?:task|feedback|answer|user_message)>")
    cleaned = F.col("text").contains("(see below for file content)") | F.col("text").contains("<file_content") | F.col("text").rlike(r"'[^'\n]*'\s*\(see below")
    told = status_feedback(rows.where("is_result").where(~open_left)).select(*keys, F.lit("json_feedback").alias("carrier"), F.lit(1 << 30).alias("span"), "text", F.array().cast("array<string>").alias("flags"), F.when(cleaned, "cleaned").otherwise("verbatim").alias("text_status"))
    place = F.row_number().over(Window.partitionBy("instance", "task", "record", "block").orderBy("part", "span")) - 1
    return wrapped.unionByName(told).withColumn("span", place)


def hand_overs(records: DataFrame) -> DataFrame:
    """(instance, argument): what assistants handed over to tasks of their own."""
    uses = records.where("role = 'assistant'").select("instance", F.explode(elements(F.col("v"), "$.content")).alias("b")).where(string(F.col("b"), "$.type").eqNullSafe(F.lit("tool_use")) & string(F.col("b"), "$.name").eqNullSafe(F.lit("new_task")))
    return uses.select("instance", strip(string(F.col("b"), "$.input.message")).alias("argument")).where("argument <> ''").distinct()


def metadata(found: DataFrame) -> DataFrame:
    """By task its own id, parent, root and time, ``readable``, and whether they say that another task handed it over."""
    v = F.col("v")
    rows = found.where(F.col("file_name") == HISTORY_ITEM).withColumn("v", F.try_parse_json("value"))
    filled = lambda p: F.nullif(string(v, p), F.lit(""))
    own = F.coalesce(filled("$.id"), F.col("task"))
    rows = rows.select("instance", "task", is_object(v, "$").alias("readable"), own.alias("own_id"), filled("$.parentTaskId").alias("parent_id"), filled("$.rootTaskId").alias("root_id"), _ms(v, "$.ts").alias("history_ts"))
    return rows.withColumn("subtask", F.col("readable") & (F.col("parent_id").isNotNull() | F.coalesce(F.col("root_id") != F.col("own_id"), F.lit(False))))


def ancestry(items: DataFrame) -> DataFrame:
    """The end of each task's chain of parents: instance, own_id, ``top``, ``depth``; both null for a chain that comes back to itself.

    Each round doubles the steps that a task has looked up, so n tasks take log2(n) rounds; chains that still go on then are cycles. A parent that isn't there is the top of its children.
    """
    now = materialize(items.groupBy("instance", "own_id").agg(F.min("parent_id").alias("up")).withColumn("depth", F.col("up").isNotNull().cast("long")), "ancestry")
    above = lambda rows: rows.where("up is not null").select("instance", F.col("own_id").alias("up"), F.col("up").alias("over"), F.col("depth").alias("more"))
    for _ in range(now.count().bit_length() + 1):
        step = now.join(above(now), ["instance", "up"], "left")
        if step.where("over is not null").isEmpty():
            break
        now = materialize(step.select("instance", "own_id", F.coalesce("over", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "ancestry")
    on = now.join(above(now).select("instance", "up", "over"), ["instance", "up"], "left")
    return on.select("instance", "own_id", F.when(F.col("over").isNull(), F.coalesce("up", "own_id")).alias("top"), F.when(F.col("over").isNull(), F.col("depth")).alias("depth"))


def ui_times(found: DataFrame) -> DataFrame:
    """By task the UI's first time and the hashes of its feedback; nothing else of the UI's messages is read."""
    v = F.col("v")
    rows = found.where(F.col("file_name") == TASK_UI).withColumn("doc", F.try_parse_json("value")).select("instance", "task", F.explode(elements(F.col("doc"), "$")).alias("v"))
    said = F.when(string(v, "$.type").eqNullSafe(F.lit("say")) & string(v, "$.say").eqNullSafe(F.lit("user_feedback")), F.nullif(strip(string(v, "$.text")), F.lit("")))
    rows = rows.select("instance", "task", _ms(v, "$.ts").alias("ts"), F.sha2(text.nfc(said), 256).alias("said"))
    return rows.groupBy("instance", "task").agg(F.min("ts").alias("ui_ts"), F.array_sort(F.collect_set("said")).alias("ui_feedback"))


def scans(found: DataFrame, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(tasks, spans): by task its status, generation, counters and metadata; and the spans of the tasks whose status is ``ok``, with times.

    Status, in the order of the rules: ``oversized`` and ``malformed`` histories, ``excluded_subtask``, ``empty``, ``unsupported`` (over a tenth of the records aren't recognised, or there is
    text of the user but no known carrier of it anywhere), ``ok``.
    """
    found = located(found)
    every = found.select("instance", "task", "file_name").groupBy("instance", "task").agg(F.bool_or(F.col("file_name") == LEGACY_UI).alias("legacy"), F.bool_or(F.col("file_name") == HISTORY_ITEM).alias("has_item"))
    doc = F.try_parse_json("value")
    api = found.where(F.col("file_name") == API_HISTORY).select("instance", "task", (F.col("file_size") > most).alias("over"), F.col("modified").alias("file_ts"), (~is_array(doc, "$")).alias("broken"))
    records = elements_of(found.where(F.col("file_size") <= most))
    per_record = records.groupBy("instance", "task").agg(F.count("*").alias("total"), F.count_if(F.col("role").isNull()).alias("unrecognised"), F.bool_or(F.col("ts").isNotNull()).alias("has_record_ts"), F.min(F.when(F.col("role") == "user", F.col("record"))).alias("first_user"))
    texts = payloads(records)
    spans = candidates(texts)
    p, whole = F.col("payload"), r"(?s)<(task|feedback|answer|user_message)>(.*?)</\1>"
    left = F.regexp_replace(p, whole, "").rlike(r"<(?:task|feedback|answer|user_message)>")
    status = F.try_parse_json(strip(p))
    plain = ~F.col("is_result") & (strip(p) != "") & ~p.rlike(whole)
    per_text = texts.groupBy("instance", "task").agg(
        F.count_if(left).alias("unbalanced"), F.bool_or(p.rlike(r"<(?:task|feedback|answer)>")).alias("g1"), F.bool_or(p.contains("<user_message>")).alias("g3"),
        F.bool_or(~left & F.col("is_result") & is_object(status, "$") & has_key(status, "$.status")).alias("g2"), F.bool_or(~left & plain).alias("plain"),
    )
    counted = spans.groupBy("instance", "task").agg(F.count("*").alias("candidates"))
    info = metadata(found)
    keys = ["instance", "task"]
    rows = every.join(api, keys, "left").join(per_record, keys, "left").join(per_text, keys, "left").join(counted, keys, "left").join(info, keys, "left").join(ui_times(found), keys, "left")
    rows = rows.na.fill(0, ["total", "unrecognised", "unbalanced", "candidates"]).na.fill(False, ["g1", "g2", "g3", "plain", "readable", "subtask", "over", "has_record_ts"])
    generation = F.when(F.col("g3"), "g3-user-message").when(F.col("g2"), "g2-native-json").when(F.col("g1"), "g1-xml")
    rows = rows.withColumn("generation", generation)
    what = (
        F.when(F.col("over"), "oversized").when(F.coalesce(F.col("broken"), F.lit(False)), "malformed").when(F.col("subtask"), "excluded_subtask").when(F.col("total") == 0, "empty")
        .when((F.col("unrecognised") * UNRECOGNISED_SHARE > F.col("total")) | (F.col("plain") & (F.col("candidates") == 0) & F.col("generation").isNull()), "unsupported").otherwise("ok")
    )
    rows = rows.withColumn("status", what)
    # Without metadata, a task whose first wrapped text was handed over by another one is that task's.
    opening = spans.where("carrier = 'wrapper'").join(per_record.select(*keys, F.col("first_user").alias("record")), [*keys, "record"], "left_semi").groupBy(*keys).agg(F.min_by("text", F.struct("block", "span")).alias("argument"))
    handed = opening.join(hand_overs(records), ["instance", "argument"], "left_semi").select(*keys, F.lit(True).alias("handed"))
    tasks = rows.join(handed, keys, "left").withColumn("status", F.when((F.col("status") == "ok") & ~F.col("readable") & F.coalesce("handed", F.lit(False)), "excluded_subtask").otherwise(F.col("status")))
    tasks = tasks.select(*keys, "status", "generation", "total", "unrecognised", "unbalanced", "legacy", "has_item", "has_record_ts", F.col("readable").alias("has_metadata"), (F.col("has_item") & ~F.col("readable")).alias("metadata_unreadable"), "first_user", "own_id", "parent_id", F.coalesce("history_ts", "ui_ts", "file_ts").alias("fallback_ts"), "ui_feedback")
    good = spans.join(tasks.where("status = 'ok'").select(*keys, "has_metadata", "first_user", "fallback_ts"), keys)
    initial = (F.col("record") == F.col("first_user")) & ~F.col("has_metadata")
    flags = F.when(initial, F.concat("flags", F.array(F.lit("possible_delegated_task")))).otherwise(F.col("flags"))
    out = good.select(*keys, "record", "block", "span", "carrier", "text", "text_status", flags.alias("flags"), F.when(initial, 0.6).otherwise(0.9).alias("confidence"), F.coalesce("ts", "fallback_ts").alias("ts"))
    return tasks, out


def fingerprint(tasks: DataFrame, indexed: DataFrame | None = None) -> DataFrame:
    """By instance what its tasks look like: their generation (or ``mixed``), metadata, times; ``indexed``: the instances with an index of their own."""
    rows = tasks.groupBy("instance").agg(F.array_sort(F.collect_set("generation")).alias("g"), F.bool_or("has_item").alias("meta"), F.bool_or("has_record_ts").alias("ts"))
    if indexed is not None:
        rows = rows.join(indexed.select("instance", F.lit(True).alias("index")).distinct(), "instance", "left")
        rows = rows.withColumn("meta", F.col("meta") | F.coalesce("index", F.lit(False)))
    one = F.when(F.size("g") == 1, F.col("g")[0]).otherwise("mixed")
    return rows.select("instance", F.when(F.size("g") == 0, "empty").otherwise(F.concat_ws("+", one, F.when(F.col("meta"), "meta"), F.when(F.col("ts"), "ts"))).alias("fingerprint"))


def utterances(found: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    return scans(found, most)[1]
