"""Registered queries of reviews, lifecycles, packages, task trees, editor states, quotas and partition-safe writing. Raw rows are made from the test tables, so that SQL knows the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import collect, counts, digests, judgments, lifecycle, partitions, review, verification
from ..operators.common import shared_dir
from ..sources import composers, editor_states, formats, quotas, task_trees
from ..streaming import events as event_log
from .raw import _turns, sql_strip
from .registry import query, sql_count_words
from .tables import START, conversation_utterances, document_utterances, table

#: About as many rows of sessions share a folder.
FOLDER_ROWS = 10_000


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/corpusloom-core/{name}-{uuid.uuid4().hex}"


# --- Editor states and stores ---


def _text_node(x: Column) -> Column:
    return F.concat(F.lit('{"type":"text",'), F.substring(F.to_json(F.struct(x.alias("text"))), F.lit(2), F.lit(1 << 30)))


def _composer_items(spark: SparkSession, sf_dir: str, placed: Callable[[DataFrame, Column], Column] = lambda turns, name: name) -> DataFrame:
    """Conversations as composers, turns as bubbles beside an editor state of depth 4; by turn: exact, a nudge, no state, a conflict, other white space, a mention.

    Every fifth composer names another id, every fifth is one of several tries; every seventh misses its odd bubbles. ``placed``: the path of a turn in the store of that name.
    """
    k = F.when(F.col("turn") % 12 == 9, 0).otherwise(F.col("turn") % 6)
    turns = _turns(spark, sf_dir)
    rows = turns.withColumn("k", k).withColumn("c", F.concat(F.lit("c"), "conv_id")).withColumn("b", F.concat(F.lit("b"), "turn")).withColumn("path", placed(turns, F.concat(F.lit("s"), F.pmod("conv_id", F.lit(3)))))
    heads = F.struct(F.lit(12).alias("_v"), F.when(F.col("conv_id") % 5 == 0, "other").otherwise(F.col("c")).alias("composerId"), F.when(F.col("conv_id") % 5 == 1, True).alias("isBestOfNSubcomposer"), F.col("h").alias("fullConversationHeadersOnly"))
    own = rows.groupBy("path", "conv_id", "c").agg(F.collect_list(F.struct(F.col("b").alias("bubbleId"), F.lit(1).alias("type"))).alias("h")).select("path", F.concat(F.lit("composerData:"), "c").alias("key"), F.to_json(heads).alias("value"))
    mention = F.when(F.col("k") == 5, '{"type":"mention","mentionName":"f.py"},{"type":"text","text":" "},').otherwise("")
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.lit('{"type":"paragraph","children":[{"type":"list","children":[{"type":"paragraph","children":['), F.when(i == 0, mention).otherwise(""), F.when((F.col("k") == 3) & (i == 0), '{"type":"text","text":"OTHER "},').otherwise(""), _text_node(x), F.lit("]}]}]}")))
    state = F.when(F.col("k") != 2, F.concat(F.lit('{"root":{"type":"root","children":['), F.array_join(lines, ","), F.lit("]}}")))
    stored = F.when(F.col("k") == 4, F.replace("text", F.lit(" "), F.lit("  "))).when(F.col("k") == 5, F.concat(F.lit("@f.py "), "text")).otherwise(F.col("text"))
    bubble = F.struct(F.lit(3).alias("_v"), F.lit(1).alias("type"), stored.alias("text"), F.when(F.col("k") == 1, True).alias("isNudge"), state.alias("richText"))
    kept = rows.where("conv_id % 7 <> 0 or turn % 2 = 0").select("path", F.concat_ws(":", F.lit("bubbleId"), "c", "b").alias("key"), F.to_json(bubble).alias("value"))
    return own.unionByName(kept)


_K = "CASE WHEN turn % 12 = 9 THEN 0 ELSE turn % 6 END"
_BUBBLES = f"""b AS (SELECT conv_id, turn, 's' || conv_id % 3 AS path, {_K} AS k, text, CASE {_K} WHEN 4 THEN replace(text, ' ', '  ') WHEN 5 THEN '@f.py ' || text ELSE text END AS stored,
conv_id % 7 = 0 AND turn % 2 = 1 AS missing, conv_id % 5 NOT IN (0, 1) AS eligible FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)),
g AS (SELECT *, count(*) FILTER (missing) OVER (PARTITION BY conv_id) * 10 > count(*) OVER (PARTITION BY conv_id) AS gone FROM b),
m AS (SELECT *, {sql_strip("array_to_string(list_transform(string_split(regexp_replace(' ' || text, '[ \\t]{2,}', ' ', 'g'), chr(10)), lambda l: " + sql_strip('l') + "), chr(10))")} AS less FROM g),
live AS (SELECT *, CASE k WHEN 5 THEN less ELSE stored END AS own FROM m WHERE eligible AND NOT gone AND NOT missing AND k <> 1 AND {sql_strip('stored')} <> '')"""


@query(f"""WITH {_BUBBLES}
SELECT 'c' || conv_id AS composer_id, 'b' || turn AS bubble_id, CASE WHEN k = 5 THEN 'verbatim_mention_sigil' WHEN k = 4 AND contains(text, ' ') THEN 'verbatim_whitespace' ELSE 'verbatim_exact' END AS gate, sha256(own) AS digest
FROM live WHERE k IN (0, 4, 5) AND {sql_strip('own')} <> ''""")
def composer_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that agree with their editor states, less their mentions."""
    return composers.utterances(_composer_items(spark, sf_dir)).select("composer_id", "bubble_id", "gate", F.sha2("text", 256).alias("digest"))


@query(f"""WITH {_BUBBLES},
c AS (SELECT 's' || conv_id % 3 AS path, count(DISTINCT conv_id) AS composers, count(DISTINCT conv_id) FILTER (conv_id % 5 <> 0) AS current, count(DISTINCT conv_id) FILTER (conv_id % 5 = 0) AS id_mismatch, count(DISTINCT conv_id) FILTER (conv_id % 5 = 1) AS best_of_n FROM conversations GROUP BY 1),
r AS (SELECT path, count(*) AS referenced, count(*) FILTER (missing) AS missing, count(*) FILTER (NOT missing AND k = 1) AS bubbles_excluded_nudge FROM g WHERE eligible GROUP BY path),
l AS (SELECT path, count(*) AS kept, count(*) FILTER (k IN (0, 4, 5)) AS verbatim, count(*) FILTER (k = 2) AS no_editor_state, count(*) FILTER (k = 3) AS text_projection_mismatch, count(*) FILTER (k = 5) AS mention_stripped,
sum({sql_count_words('stored')}) AS candidate_words, sum(strlen(stored)) AS candidate_bytes, count(*) FILTER (k IN (0, 4, 5) AND {sql_strip('own')} <> '') AS analyzable FROM live GROUP BY path)
SELECT path, CAST(composers AS BIGINT) AS composers, CAST(current AS BIGINT) AS current, CAST(id_mismatch AS BIGINT) AS id_mismatch, CAST(best_of_n AS BIGINT) AS best_of_n, CAST(referenced AS BIGINT) AS referenced, CAST(missing AS BIGINT) AS missing, CAST(bubbles_excluded_nudge AS BIGINT) AS bubbles_excluded_nudge,
CAST(kept AS BIGINT) AS kept, CAST(verbatim AS BIGINT) AS verbatim, CAST(no_editor_state AS BIGINT) AS no_editor_state, CAST(text_projection_mismatch AS BIGINT) AS text_projection_mismatch, CAST(mention_stripped AS BIGINT) AS mention_stripped, CAST(candidate_words AS BIGINT) AS candidate_words, CAST(candidate_bytes AS BIGINT) AS candidate_bytes, CAST(analyzable AS BIGINT) AS analyzable,
text_projection_mismatch * 4 > verbatim + text_projection_mismatch AS drifted FROM c JOIN r USING (path) JOIN l USING (path)""")
def composer_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of stores, scanned in five parts and merged."""
    facts = composers.facts(_composer_items(spark, sf_dir)).withColumn("part", F.pmod(F.xxhash64("composer_id", "text"), F.lit(5)))
    whole = composers.judged_scan(composers.merged_scans(composers.store_scan(facts, "path", "part"), "path"))
    return whole.select("path", "composers", "current", "id_mismatch", "best_of_n", "referenced", "missing", "bubbles_excluded_nudge", "kept", "verbatim", "no_editor_state", "text_projection_mismatch", "mention_stripped", "candidate_words", "candidate_bytes", "analyzable", "drifted")


@query("""SELECT conv_id, turn, coalesce(text, '') || chr(9) || 'f.py' AS text, CAST(len(string_split(coalesce(text, ''), chr(10))) AS INT) AS names FROM conversations""")
def editor_state_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections of states whose lines are paragraphs of different depths; each ends in a tab and a mention."""
    deep = lambda i, x: F.concat(F.repeat(F.lit('{"type":"paragraph","children":['), i % 7 + 1), x, F.repeat(F.lit("]}"), i % 7 + 1))
    tail = F.lit(',{"type":"tab"},{"type":"mention","name":"f.py"}')
    rows = _turns(spark, sf_dir)
    last = F.size(F.split("text", "\n", -1)) - 1
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: deep(i, F.concat(_text_node(x), F.when(i == last, tail).otherwise(F.lit(',{"type":"mention","label":" "}')))))
    state = F.concat(F.lit('{"root":{"children":['), F.array_join(lines, ","), F.lit("]}}"))
    made = rows.withColumn("p", editor_states.projection(state))
    return made.select("conv_id", "turn", F.col("p.text").alias("text"), (F.size("p.names") + last).cast("int").alias("names"))


# --- Task trees ---


def _task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each conversation; by turn: wrapped feedback, a summary, a typed record, a status with feedback, an answer of the assistant. Every seventh task is broken, handed over, or has metadata only."""
    rows, k = _turns(spark, sf_dir), F.col("turn") % 5
    fb = F.concat(F.lit("<feedback>"), "text", F.lit("</feedback>"))
    stamp = F.when(F.col("turn") % 2 == 0, (F.lit(START) + F.col("conv_id") * 3600 + F.col("turn") * 60) * 1000)
    plain = F.to_json(F.struct(F.when(k == 4, "assistant").otherwise("user").alias("role"), fb.alias("content"), stamp.alias("ts"), F.when(k == 1, True).alias("isSummary"), F.when(k == 2, "reasoning").alias("type")))
    told = F.to_json(F.struct(F.lit("ok").alias("status"), F.col("text").alias("feedback")))
    result = F.to_json(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("tool_result").alias("type"), told.alias("content"))).alias("content"), stamp.alias("ts")))
    listed = F.array_sort(F.collect_list(F.struct("turn", F.when(k == 3, result).otherwise(plain).alias("j"))))
    docs = rows.groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["j"]), ","), F.lit("]")).alias("value")).withColumn("value", F.when(F.col("conv_id") % 7 == 0, "{").otherwise(F.col("value")))
    item = F.to_json(F.struct(F.concat(F.lit("t"), "conv_id").alias("id"), F.when(F.col("conv_id") % 7 == 1, "other").alias("parentTaskId"), ((F.lit(START) + F.col("conv_id")) * 1000).alias("ts")))
    items = rows.select("conv_id").distinct().where("conv_id % 7 in (1, 2)").select("conv_id", item.alias("value"))
    shape = lambda d, name: d.select(F.concat(F.lit("/x/tasks/t"), "conv_id", F.lit(f"/{name}")).alias("path"), F.lit(name).alias("file_name"), F.length("value").cast("long").alias("file_size"), F.timestamp_seconds(F.lit(START)).alias("modified"), "value")
    return shape(docs, formats.API_HISTORY).union(shape(items, formats.HISTORY_ITEM))


@query(f"""WITH t AS (SELECT conv_id, turn, {sql_strip("coalesce(text, '')")} AS text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS record FROM conversations),
f AS (SELECT *, min(record) FILTER (turn % 5 <> 4) OVER (PARTITION BY conv_id) AS first_user FROM t)
SELECT 't' || conv_id AS task, record, CASE WHEN turn % 5 = 3 THEN 'json_feedback' ELSE 'wrapper' END AS carrier, sha256(text) AS digest, CASE WHEN record = first_user AND conv_id % 7 <> 2 THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
CAST(CASE WHEN turn % 2 = 0 THEN {START} + conv_id * 3600 + turn * 60 WHEN conv_id % 7 = 2 THEN {START} + conv_id ELSE {START} END AS BIGINT) AS epoch FROM f WHERE conv_id % 7 NOT IN (0, 1) AND turn % 5 IN (0, 3) AND text <> ''""")
def task_tree_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = task_trees.utterances(_task_files(spark, sf_dir))
    return out.select("task", "record", "carrier", F.sha2("text", 256).alias("digest"), F.col("confidence").cast("double").alias("confidence"), F.unix_seconds("ts").alias("epoch"))


@query("""SELECT 't' || conv_id AS task, CASE conv_id % 7 WHEN 0 THEN 'malformed' WHEN 1 THEN 'excluded_subtask' ELSE 'ok' END AS status, conv_id % 7 IN (1, 2) AS has_metadata, CAST(CASE WHEN conv_id % 7 = 0 THEN 0 ELSE count(*) END AS BIGINT) AS total FROM conversations GROUP BY conv_id""")
def task_tree_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_trees.scans(_task_files(spark, sf_dir))[0].select("task", "status", "has_metadata", "total")


@query("""WITH RECURSIVE up(doc_id, top, depth) AS (SELECT doc_id, doc_id, 0 FROM documents WHERE doc_id % 100 = 0 UNION SELECT d.doc_id, u.top, u.depth + 1 FROM documents d JOIN up u ON d.doc_id - d.doc_id % 3 - 1 = u.doc_id WHERE d.doc_id % 100 <> 0),
orphan(doc_id, top, depth) AS (SELECT doc_id, doc_id - doc_id % 3 - 1, 1 FROM documents WHERE doc_id % 100 <> 0 AND doc_id - doc_id % 3 - 1 NOT IN (SELECT doc_id FROM documents) UNION SELECT d.doc_id, o.top, o.depth + 1 FROM documents d JOIN orphan o ON d.doc_id - d.doc_id % 3 - 1 = o.doc_id WHERE d.doc_id % 100 <> 0)
SELECT CAST(doc_id AS VARCHAR) AS task, CAST(top AS VARCHAR) AS top, CAST(depth AS BIGINT) AS depth FROM (SELECT * FROM up UNION SELECT * FROM orphan)""")
def task_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of parents over all documents; every hundredth document begins one, and so does each whose parent isn't there."""
    d = table(spark, sf_dir, "documents").select(F.lit("i").alias("instance"), F.col("doc_id").cast("string").alias("own_id"), F.when(F.col("doc_id") % 100 != 0, (F.col("doc_id") - F.col("doc_id") % 3 - 1).cast("string")).alias("parent_id"))
    return task_trees.ancestry(d).select(F.col("own_id").alias("task"), "top", "depth")


# --- Quotas ---

@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 101 AS a, c_custkey % 97 AS b FROM customer)
SELECT CAST(k AS VARCHAR) AS path, 'five_hour' AS name, CAST(a AS BIGINT) AS utilization, CASE WHEN k % 2 = 0 THEN '2024-05-01T10:00:00Z' END AS resets_at FROM c WHERE k % 9 NOT IN (1, 2, 3, 4)
UNION ALL SELECT CAST(k AS VARCHAR), 'seven_day', CAST(b AS BIGINT), NULL FROM c WHERE k % 9 NOT IN (1, 5)""")
def quota_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotas.windows(_quota_configs(spark, sf_dir))


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 101 AS a, c_custkey % 97 AS b FROM customer), w AS (SELECT *, k % 9 NOT IN (1, 2, 3, 4) AS five, k % 9 NOT IN (1, 5) AS seven FROM c)
SELECT CAST(k AS VARCHAR) AS path, CAST(five::INT + seven::INT AS BIGINT) AS windows, CASE WHEN five AND (NOT seven OR a >= b) THEN 'five_hour' WHEN seven THEN 'seven_day' END AS tightest, CAST(CASE WHEN five AND (NOT seven OR a >= b) THEN a WHEN seven THEN b END AS BIGINT) AS utilization,
CASE WHEN k % 9 NOT IN (1, 6) THEN k % 2 = 1 END AS overage_enabled, CASE WHEN k % 9 NOT IN (1, 7) THEN greatest(0.0, 9000.0 - k % 10000) END AS age_seconds, coalesce(CASE WHEN k % 9 NOT IN (1, 7) THEN 9000.0 - k % 10000 > 3600 END, false) AS stale FROM w""")
def quota_allowance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotas.allowance(_quota_configs(spark, sf_dir), F.lit(9000)).select("path", "windows", "tightest", "utilization", "overage_enabled", F.col("age_seconds").cast("double").alias("age_seconds"), "stale")


def _quota_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration for each customer: broken, or with a window that is null, a boolean, a string or a list, or missing; windows of other products; odd times and switches."""
    k, shape = F.col("c_custkey"), F.col("c_custkey") % 9
    number = (k % 101).cast("string")
    five = F.when(shape == 2, "null").when(shape == 3, F.concat(F.lit('{"utilization":true}'))).when(shape == 4, '{"utilization":"12"}').otherwise(F.concat(F.lit('{"utilization":'), number, F.lit('.7,"resets_at":"'), F.when(k % 2 == 0, "2024-05-01T10:00:00Z").otherwise("soon"), F.lit('"}')))
    seven = F.when(shape == 5, "[1]").otherwise(F.concat(F.lit('{"utilization":'), (k % 97).cast("string"), F.lit(',"resets_at":7}')))
    extra = F.concat(F.lit('{"is_enabled":'), F.when(shape == 6, '"yes"').otherwise((k % 2 == 1).cast("string")), F.lit("}"))
    fetched = F.when(shape == 7, "true").otherwise((k % 10000 * 1000).cast("string"))
    value = F.concat(F.lit('{"other":1,"cachedUsageUtilization":{"fetchedAtMs":'), fetched, F.lit(',"utilization":{"five_hour":'), five, F.lit(',"seven_day":'), seven, F.lit(',"seven_day_other":{"utilization":99},"extra_usage":'), extra, F.lit("}}}"))
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("path"), F.when(shape == 1, "[1").otherwise(value).alias("value"))


# --- Lifecycles ---

_STEPS = "[" + ", ".join(f"'{s}'" for s in fixed.STEP_TRANSITIONS) + "]"
_STEP_EDGES = ", ".join(f"('{a}', '{b}')" for a, t in fixed.STEP_TRANSITIONS.items() for b in t)
_PAIRS = f"(SELECT event_id, {_STEPS}[event_id % 9 + 1] AS status, {_STEPS}[event_id // 9 % 9 + 1] AS target FROM events)"
_PATH = "[" + ", ".join(f"'{s}'" for s in fixed.PROMOTION_PATH) + "]"


def _step_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*map(F.lit, fixed.STEP_TRANSITIONS))
    return table(spark, sf_dir, "events").select("event_id", states[(F.col("event_id") % 9).cast("int")].alias("status"), states[F.expr("cast(event_id div 9 % 9 as int)")].alias("target"))


@query(f"""WITH RECURSIVE e(a, b) AS (VALUES {_STEP_EDGES}), w(a, b, n) AS (SELECT a, b, 1 FROM e UNION SELECT w.a, e.b, w.n + 1 FROM w JOIN e ON w.b = e.a WHERE w.n < 9), s AS (SELECT a, b, min(n) AS n FROM w GROUP BY a, b)
SELECT event_id, status, target, CAST(n AS INT) AS steps FROM {_PAIRS} LEFT JOIN s ON status = a AND target = b""")
def step_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of the shortest legal walk between two states of a step, null if none leads there."""
    reach = lifecycle.reachable(lifecycle.legal_steps(spark)).withColumnsRenamed({"from_status": "status", "to_status": "target"})
    return _step_pairs(spark, sf_dir).join(F.broadcast(reach), ["status", "target"], "left").select("event_id", "status", "target", F.col("steps").cast("int").alias("steps"))  # at most 81 rows


@query(f"""WITH p AS (SELECT *, coalesce(list_position({_PATH}, status), 0) AS here, coalesce(list_position({_PATH}, target), 0) AS there FROM {_PAIRS}),
w AS (SELECT *, CASE WHEN status = target OR here >= there THEN [] ELSE {_PATH}[here + 1:there] END AS walk FROM p),
c AS (SELECT *, CASE WHEN status = target THEN NULL WHEN there = 0 THEN 'SCHEMA_INVALID_VALUE' WHEN len(walk) > 0 AND (status, walk[1]) NOT IN (VALUES {_STEP_EDGES}) THEN 'STATE_INVALID_TRANSITION' END AS code FROM w)
SELECT event_id, CASE WHEN code IS NULL AND len(walk) > 0 THEN walk[len(walk)] ELSE status END AS new_status, array_to_string(CASE WHEN code IS NULL THEN walk ELSE [] END, '>') AS walk, code FROM c""")
def step_advances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.advanced(_step_pairs(spark, sf_dir)).select("event_id", "new_status", F.array_join("walk", ">").alias("walk"), "code")


@query("""WITH s AS (SELECT doc_id // 10 AS run_id, doc_id % 10 AS step, doc_id % 3 <> 0 AND doc_id % 10 >= doc_id // 10 % 10 AS is_open FROM documents)
SELECT CAST(run_id AS BIGINT) AS run_id, coalesce(string_agg(CAST(step AS VARCHAR), ',' ORDER BY step) FILTER (is_open AND step <= 5), '') AS unfinished, max(step) FILTER (NOT is_open AND step < coalesce(first_open, 99)) AS promoted_through, count(*) FILTER (is_open AND step <= 5) = 0 AS allowed
FROM (SELECT *, min(step) FILTER (is_open) OVER (PARTITION BY run_id) AS first_open FROM s) GROUP BY run_id""")
def promotion_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = (F.col("doc_id") % 3 != 0) & (F.col("doc_id") % 10 >= F.expr("doc_id div 10 % 10"))
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("run_id"), (F.col("doc_id") % 10).alias("step"), F.when(pending, "pending").otherwise("promoted").alias("status"))
    return lifecycle.promotion_guard(d, F.lit(5)).select("run_id", F.array_join(F.transform("unfinished", lambda s: s.cast("string")), ",").alias("unfinished"), "promoted_through", "allowed")


_EVENT_KINDS = ("artifact_produced", "artifact_verified", "artifact_promoted", "checkpoint_written", "downstream_invalidated")
_EVENT_STATES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in event_log.STATUS_OF.items()) + "}"


@query(f"""WITH e AS (SELECT user_id AS run_id, event_id % 5 AS step_id, event_id, event_id // 3 AS moment, ['{"', '".join(_EVENT_KINDS)}'][event_id * 7 % 5 + 1] AS kind FROM events)
SELECT CAST(run_id AS BIGINT) AS run_id, CAST(step_id AS BIGINT) AS step_id, event_id, {_EVENT_STATES}[kind] AS status FROM e WHERE kind <> 'checkpoint_written' QUALIFY row_number() OVER (PARTITION BY run_id, step_id ORDER BY moment DESC, event_id DESC) = 1""")
def event_log_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of events as a stream of several files in several micro-batches, each event twice; the states that the stream leaves."""
    kinds = F.array(*map(F.lit, _EVENT_KINDS))
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("run_id"), (F.col("event_id") % 5).cast("long").alias("step_id"), F.col("event_id").cast("long").alias("event_id"), F.timestamp_seconds(F.expr("event_id div 3")).alias("at"), kinds[(F.col("event_id") * 7 % 5).cast("int")].alias("kind"))
    log, kept, marks = (_folder(spark, x) for x in ("log", "states", "marks"))
    # Of two copies one comes early and one late, in other files; about a third of the files comes at a time.
    each = max(1, spark.sparkContext.defaultParallelism // 3)
    e.union(e).repartition(3 * each, F.rand(5)).write.parquet(log)
    stream = spark.readStream.schema(event_log.EVENT).option("maxFilesPerTrigger", each).parquet(log)
    event_log.keep(spark, stream, kept, marks)
    return event_log.kept(spark, kept).select("run_id", "step_id", "event_id", "status")


# --- Reviews and packages ---


def _review_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("run_id"), F.col("doc_id").cast("string").alias("record_id"), (F.col("doc_id") % 3 != 0).alias("included"))


@query("""WITH n AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id % 20 AS run_id, doc_id, doc_id % 3 <> 0 AS included FROM documents), t AS (SELECT event_id * 31 % n.n AS doc_id, arg_max(event_id % 2 = 0, event_id) AS included FROM events, n GROUP BY 1)
SELECT run_id, CAST(count(*) FILTER (coalesce(t.included, r.included)) AS BIGINT) AS shared_mistakes, CAST(count(*) FILTER (NOT coalesce(t.included, r.included)) AS BIGINT) AS withheld_by_user FROM r LEFT JOIN t USING (doc_id) GROUP BY run_id""")
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of reviews after two batches of toggles, kept by differences: only the records that a toggle names are looked at."""
    records = _review_records(spark, sf_dir)
    total = records.count()
    path = _folder(spark, "review")
    review.new_review(path, records)
    changes = table(spark, sf_dir, "events").select(F.pmod(F.col("event_id") * 31, F.lit(total)).alias("doc_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 2 == 0).alias("included")).select((F.col("doc_id") % 20).alias("run_id"), F.col("doc_id").cast("string").alias("record_id"), "seq", "included")
    numbers = review.record_counts(records)
    for half in (1, 0):  # the later half comes first
        numbers = review.recounted(numbers, review.kept_toggles(path, changes.where(F.col("seq") % 2 == half)))
    return numbers


def _package_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("record_id"), F.col("doc_id"), "lang", (F.col("doc_id") % 4 != 0).alias("included"))


_LEAVES = """r AS (SELECT concat_ws(':', source, doc_id) AS record_id, doc_id, lang FROM documents WHERE doc_id % 4 <> 0),
h AS (SELECT *, sha256(to_json({'doc_id': doc_id, 'lang': lang, 'record_id': record_id})) AS d, row_number() OVER (ORDER BY record_id, sha256(to_json({'doc_id': doc_id, 'lang': lang, 'record_id': record_id}))) - 1 AS place FROM r)"""


@query(f"""WITH {_LEAVES},
a AS (SELECT place // {digests.FAN} AS place, sha256(string_agg(d, chr(10) ORDER BY place)) AS d FROM h GROUP BY 1), b AS (SELECT place // {digests.FAN} AS place, sha256(string_agg(d, chr(10) ORDER BY place)) AS d FROM a GROUP BY 1), c AS (SELECT place // {digests.FAN} AS place, sha256(string_agg(d, chr(10) ORDER BY place)) AS d FROM b GROUP BY 1)
SELECT CAST((SELECT count(*) FROM h) AS BIGINT) AS records, sha256((SELECT count(*) FROM h) || ':' || CASE WHEN (SELECT count(*) FROM h) <= 1 THEN coalesce((SELECT min(d) FROM h), '') WHEN (SELECT count(*) FROM a) = 1 THEN (SELECT min(d) FROM a) WHEN (SELECT count(*) FROM b) = 1 THEN (SELECT min(d) FROM b) ELSE (SELECT min(d) FROM c) END) AS records_sha256, '1.0' AS client_version""")
def package_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of a package over the included documents: their number and the root of the tree of their digests."""
    return review.package(_package_content(spark, sf_dir), {"client_version": F.lit("1.0")})[1].select("records", "records_sha256", "client_version")


@query(f"WITH {_LEAVES} SELECT CAST(place AS BIGINT) AS place, record_id AS left_ref, record_id AS right_ref FROM h WHERE doc_id % 97 = 1")
def package_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that differ between a package and its review, found by descending from the roots of their trees."""
    rows = _package_content(spark, sf_dir)
    own = rows.where("included").drop("included")
    changed = own.withColumn("lang", F.when(F.col("doc_id") % 97 == 1, F.concat(F.coalesce("lang", F.lit("")), F.lit("!"))).otherwise(F.col("lang")))
    tree = lambda d: digests.tree(d, ["record_id"], ["record_id", "doc_id", "lang"])
    return digests.differences(tree(own), tree(changed)).select("place", "left_ref", "right_ref")


@query("""SELECT 'SUBMISSION_FORBIDDEN_FIELD' AS code, 'producer_version' AS item_ref UNION ALL SELECT 'SCHEMA_INVALID_VALUE', 'records[' || concat_ws(':', source, doc_id) || ']' FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 10 = 1
UNION ALL SELECT 'PRIVACY_LONG_SOURCE_PHRASE', 'records[' || concat_ws(':', source, doc_id) || ']' FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 10 = 2 UNION ALL SELECT unnest(['PRIVACY_EMAIL_PRESENT', 'PRIVACY_URL_PRESENT']), 'records[' || concat_ws(':', source, doc_id) || ']' FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 10 = 3
UNION ALL SELECT 'SUBMISSION_HASH_MISMATCH', NULL""")
def package_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of a package whose hash, one version and three tenths of whose records are at fault."""
    k = F.col("doc_id") % 10
    rows = table(spark, sf_dir, "documents").select(
        F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("record_id"), "doc_id", F.lit("Use the past tense.").alias("rule"), F.when(k == 3, "write to me@example.com").otherwise("He go.").alias("mistake"),
        F.when(k == 2, F.repeat(F.lit("word "), fixed.MAX_EXAMPLE_WORDS + 1)).otherwise("He goes.").alias("example"), F.when(k == 1, "elsewhere").otherwise("codex").alias("source_type"), (F.col("doc_id") % 4 != 0).alias("included"),
    )
    content = [c for c in rows.columns if c != "included"]
    own, head, _ = review.package(rows, {"client_version": F.lit("1.0"), "producer_version": F.lit("next"), "privacy_verifier_version": F.lit("2")})
    texts = {c: c for c in ("rule", "mistake", "example", "source_type")}
    return review.package_diagnostics(own, head.withColumn("payload_hash", F.reverse("payload_hash")), texts, content)


# --- Writing ---


@query("""WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY conv_id, turn) = 1 AS kept FROM conversations)
SELECT conv_id AS session_seq, conv_id || ':' || turn AS utterance_id, CAST(turn AS BIGINT) AS i FROM u WHERE kept""")
def redistributed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as a table of partitions, of which only those that lose rows to deduplication are written anew. Sessions share a folder, so that files don't grow in number with them."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_seq"), F.concat_ws(":", "conv_id", "turn").alias("utterance_id"), F.col("turn").cast("long").alias("i"), F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    path, folders = _folder(spark, "sessions"), max(1, rows.count() // FOLDER_ROWS)
    verification.write_sessions(rows.drop("h").withColumn("folder", F.pmod(F.xxhash64("session_seq"), F.lit(folders))), path, "folder")
    first = rows.groupBy("h").agg(F.min(F.struct("session_seq", "i", "utterance_id")).alias("m")).select("m.utterance_id")
    schema = "session_seq long, utterance_id string, i long"
    collect.redistribute(spark, path, schema, first, "folder")
    return partitions.read(spark, path, schema, "folder").select("session_seq", "utterance_id", "i")


# --- Collecting, reports ---


@query("SELECT c_custkey AS instance_key, 'beta' AS adapter_id FROM customer WHERE c_custkey % 4 <> 1 AND c_custkey % 5 <> 2 AND c_custkey % 6 <> 0 AND c_nationkey % 3 = 1")
def eligible_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable, found instances with candidates that a name picks."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    names = F.element_at(F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    rows = c.select(k.alias("instance_key"), names.alias("adapter_id"), F.concat(F.lit("Source "), k).alias("opaque_label"), F.when(k % 4 == 1, "beta").otherwise("stable").alias("stability"), F.when(k % 5 == 2, "unsupported").otherwise("found").alias("accessibility"), (k % 6).alias("candidate_messages"))
    return collect.named(collect.eligible_instances(rows), "BETA").select("instance_key", "adapter_id")


@query("SELECT substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 12) AS instance, 'LINEAGE_MISSING_INPUT' AS reason FROM customer WHERE c_custkey % 3 = 0")
def missing_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.col("c_custkey").cast("string"), 256).alias("instance_key"))
    return collect.missing_inputs(keys, keys.where("c_custkey % 3 <> 0"))


@query("SELECT conv_id AS session_seq, CAST(turn AS BIGINT) AS i, '' AS text FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_and(length(coalesce(text, '')) > 20))")
def prefilled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_utterances(spark, sf_dir).select(F.col("conv_id").alias("session_seq"), F.col("turn").cast("long").alias("i"), "text")
    return collect.prefilled(rows, F.length(F.coalesce("text", F.lit(""))) > 20)


@query("SELECT code, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS code FROM events) GROUP BY code")
def diagnostics_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.diagnostic_counts(_diagnostics(spark, sf_dir))


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("event_id") % 4 + 1).cast("int")).alias("code"), F.col("event_id").cast("string").alias("item_ref"))


@query("SELECT CAST(count(*) FILTER (event_id % 4 IN (0, 3)) AS BIGINT) AS errors, CAST(count(*) FILTER (event_id % 4 = 1) AS BIGINT) AS warnings, count(*) FILTER (event_id % 4 IN (0, 3)) = 0 AS passed FROM events")
def step_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings by a catalogue that lacks one code, which so counts as an error."""
    severities = spark.createDataFrame([("A", "error"), ("B", "warning"), ("C", "info")], "code string, severity string")
    return verification.step_report(_diagnostics(spark, sf_dir), severities)


@query("SELECT o_custkey AS run_id, o_orderpriority AS name, CAST(floor(o_totalprice) AS BIGINT) AS used FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(floor(o_totalprice) AS BIGINT) DESC, o_orderpriority) = 1")
def tightest_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("name"), F.floor("o_totalprice").cast("long").alias("used"))
    return counts.tightest_window(rows, ["run_id"], "name", "used")


@query("SELECT p_size AS step, p_brand AS runtime, p_partkey AS ordinal, CAST(p_retailprice AS DOUBLE) AS p90_total_tokens_per_message FROM part QUALIFY row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_retailprice DESC, p_partkey) = 1")
def dearest_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("step"), F.col("p_brand").alias("runtime"), F.col("p_partkey").alias("ordinal"), F.col("p_retailprice").cast("double").alias("p90_total_tokens_per_message"))
    return counts.dearest_cells(rows).select("cell.*")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'SCHEMA_INVALID_VALUE' ELSE 'CARDINALITY_MISMATCH' END AS code FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 UNION ALL SELECT doc_id, 'CARDINALITY_MISMATCH' FROM documents WHERE doc_id % 35 = 0 UNION ALL SELECT doc_id, 'SCHEMA_INVALID_VALUE' FROM documents WHERE doc_id % 7 = 0")
def carried_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a later step: every fifth is new, every seventh comes twice (and so once more than it was written)."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return judgments.not_carried(d.union(d.where("doc_id % 7 = 0")), d.where("doc_id % 5 <> 0"), ["doc_id"]).select("doc_id", "code")


@query("SELECT doc_id, source AS session_seq FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) % 4 <> 2")
def records_after_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth record of a session, from the second on, is on its drop list."""
    d = document_utterances(spark, sf_dir).select("doc_id", F.col("source_adapter").alias("session_seq"), F.col("doc_id").alias("i"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    most = d.groupBy("session_seq").count()
    drops = most.select("session_seq", F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("count").cast("int")), F.lit(4)).alias("drop"))
    return judgments.drop_records(d, drops).select("doc_id", "session_seq")


# --- Audit counts ---


def _audit_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Counts by run and modality, and records by what became of them."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 17).cast("long").alias("run_id"), F.when(F.col("conv_id") % 5 == 0, "spoken_asr").otherwise("written").alias("modality"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("w"), (F.col("turn") % 3 != 0).alias("a"))
    parts = c.groupBy("run_id", "modality").agg(F.sum("w").alias("eligible_words"), F.coalesce(F.sum(F.when(F.col("a"), F.col("w"))), F.lit(0)).alias("analyzed_words"), F.count("*").alias("eligible_utterances"), F.count_if("a").alias("analyzed_utterances"))
    fates = F.array(*map(F.lit, ("shared", "shared", "user", "privacy", "WITHHELD_PROCESSING_FAILED")))
    records = table(spark, sf_dir, "documents").select((F.col("doc_id") % 17).alias("run_id"), fates[(F.col("doc_id") % 5).cast("int")].alias("fate"))
    return parts, records


_AUDIT = """c AS (SELECT CAST(conv_id % 17 AS BIGINT) AS run_id, conv_id % 5 = 0 AS spoken, length(coalesce(text, '')) AS w, turn % 3 <> 0 AS a FROM conversations),
t AS (SELECT run_id, CAST(sum(w) AS BIGINT) AS eligible_words, CAST(coalesce(sum(w) FILTER (a), 0) AS BIGINT) AS analyzed_words, CAST(count(*) AS BIGINT) AS eligible_utterances, CAST(count(*) FILTER (a) AS BIGINT) AS analyzed_utterances, CAST(coalesce(sum(w) FILTER (spoken AND a), 0) AS BIGINT) AS spoken_analyzed_words FROM c GROUP BY run_id),
m AS (SELECT doc_id % 17 AS run_id, CAST(count(*) AS BIGINT) AS verified_total_mistakes, CAST(count(*) FILTER (doc_id % 5 < 2) AS BIGINT) AS shared_mistakes, CAST(count(*) FILTER (doc_id % 5 = 2) AS BIGINT) AS withheld_by_user, CAST(count(*) FILTER (doc_id % 5 = 3) AS BIGINT) AS withheld_for_privacy, CAST(count(*) FILTER (doc_id % 5 = 4) AS BIGINT) AS other FROM documents GROUP BY 1)"""


@query(f"WITH {_AUDIT} SELECT run_id, eligible_words, analyzed_words, eligible_utterances, analyzed_utterances, spoken_analyzed_words, coalesce(verified_total_mistakes, 0) AS verified_total_mistakes, coalesce(shared_mistakes, 0) AS shared_mistakes, coalesce(withheld_by_user, 0) AS withheld_by_user, coalesce(withheld_for_privacy, 0) AS withheld_for_privacy, coalesce(other, 0) AS other FROM t LEFT JOIN m USING (run_id) WHERE run_id % 4 <> 1 OR eligible_words = 0")
def submission_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of runs that hold to every rule; of every fourth run the total of words is one too many."""
    whole = review.audit_counts(*_audit_parts(spark, sf_dir))
    bent = whole.withColumn("eligible_words", F.col("eligible_words") + F.when((F.col("run_id") % 4 == 1) & (F.col("eligible_words") > 0), 1).otherwise(0))
    out = review.submission_counts(bent)
    return out.select("run_id", *review.PARTITIONED, F.col("spoken_asr.analyzed_words").alias("spoken_analyzed_words"), "verified_total_mistakes", "shared_mistakes", "withheld_by_user", "withheld_for_privacy", F.coalesce(F.try_element_at("other_withheld", F.lit("WITHHELD_PROCESSING_FAILED")), F.lit(0).cast("long")).alias("other"))


@query(f"""WITH {_AUDIT} SELECT run_id, unnest(CASE run_id % 5 WHEN 0 THEN ['mistakes'] WHEN 1 THEN ['words_bounded', 'partition_analyzed_words'] WHEN 2 THEN ['partition_eligible_utterances'] WHEN 3 THEN ['known_reasons'] ELSE [] END) AS invariant FROM t""")
def audit_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of counts that were bent in four ways."""
    k = F.col("run_id") % 5
    whole = review.audit_counts(*_audit_parts(spark, sf_dir))
    bent = whole.withColumn("shared_mistakes", F.col("shared_mistakes") + F.when(k == 0, 1).otherwise(0)).withColumn("analyzed_words", F.when(k == 1, F.col("eligible_words") + 1).otherwise(F.col("analyzed_words"))).withColumn("eligible_utterances", F.col("eligible_utterances") + F.when(k == 2, 1).otherwise(0))
    bent = bent.withColumn("other_withheld", F.when(k == 3, F.map_concat("other_withheld", F.create_map(F.lit("WHIM"), F.lit(0).cast("long")))).otherwise(F.col("other_withheld")))
    return review.audit_violations(bent)


@query("""WITH q AS (SELECT conv_id % 17 AS run_id, count(*) AS n FROM conversations WHERE conv_id % 3 = 0 GROUP BY 1), r AS (SELECT doc_id % 17 AS run_id, sum(doc_id % 4) AS n FROM documents GROUP BY 1)
SELECT CAST(run_id AS BIGINT) AS run_id, CAST(coalesce(q.n, 0) AS BIGINT) AS unjudged, CAST(coalesce(r.n, 0) AS BIGINT) AS duplicates_removed FROM q FULL JOIN r USING (run_id)""")
def not_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("conv_id % 3 = 0").groupBy((F.col("conv_id") % 17).cast("long").alias("run_id"), "conv_id").agg(F.count("*").alias("quarantined_utterances"))
    r = table(spark, sf_dir, "documents").select((F.col("doc_id") % 17).alias("run_id"), F.col("doc_id").alias("session_seq"), F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (F.col("doc_id") % 4).cast("int")).alias("ids"))
    return review.not_counted(c, r)
