"""Registered queries of inventories, verifiers, session folders, old trees and reports; raw rows are made from the test tables, so that SQL knows the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import inventories, judgments, lifecycle
from ..sources import composers, fingerprints, formats, sdk_sessions, stores, transcripts
from .raw import _turns, sql_strip
from .registry import query, sql_count_words
from .tables import CONVERSATIONS, START, conversation_utterances, table


def _iso(x: Column) -> Column:
    return F.date_format(F.timestamp_seconds(x), "yyyy-MM-dd'T'HH:mm:ss'Z'")


# --- Session folders of the third generation ---


def _session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each conversation; by turn: tagged input behind a notice, bare text, a tool's result with text, a command, injected context beside tagged input, an answer. Of seven sessions one isn't interactive, one of another version, one of another agent, one of another session."""
    rows, k = _turns(spark, sf_dir), F.col("turn") % 6
    block = lambda x: F.concat(F.lit('{"type":"text","text":'), F.substring(F.to_json(F.struct(x.alias("t"))), F.lit(6), F.lit(1 << 30)))
    tagged = F.concat(F.lit("<user_input mode='act'>"), "text", F.lit("</user_input>"))
    blocks = (
        F.when(k == 0, block(F.concat(F.lit("<mode_notice>now\nact</mode_notice> "), tagged))).when(k == 2, F.concat(F.lit('{"type":"tool_result","content":"x"},'), block(F.col("text")))).when(k == 3, block(F.concat(F.lit("<user_command>x</user_command>"), "text")))
        .when(k == 4, F.concat(block(F.lit(" <environment_details>x</environment_details>")), F.lit(","), block(tagged))).otherwise(block(F.col("text")))
    )
    stamp = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(',"ts":'), ((F.lit(START) + F.col("conv_id") * 3600 + F.col("turn") * 60) * 1000).cast("string"))).otherwise("")
    message = F.concat(F.lit('{"role":"'), F.when(k == 5, "assistant").otherwise("user"), F.lit('","content":['), blocks, F.lit("]"), stamp, F.lit("}"))
    listed = F.array_sort(F.collect_list(F.struct("turn", message.alias("m"))))
    c = F.col("conv_id") % 7
    head = F.concat(F.lit('{"version":'), F.when(c == 1, "2").otherwise("1"), F.lit(',"agent":"'), F.when(c == 2, "helper").otherwise("lead"), F.lit('","sessionId":"'), F.when(c == 3, "other").otherwise(F.concat(F.lit("s"), "conv_id")), F.lit('","messages":['))
    leads = rows.groupBy("conv_id").agg(F.array_join(F.transform(listed, lambda x: x["m"]), ",").alias("ms")).select("conv_id", F.lit(formats.MESSAGES_SUFFIX).alias("ends"), F.concat(head, "ms", F.lit("]}")).alias("value"))
    manifests = rows.select("conv_id").distinct().where("conv_id % 7 in (0, 4)").select("conv_id", F.lit(".json").alias("ends"), F.to_json(F.struct((c != 0).alias("interactive"), _iso(F.lit(START) + F.col("conv_id")).alias("started_at"))).alias("value"))
    name = F.concat(F.lit("s"), "conv_id", "ends")
    return leads.union(manifests).select(F.concat(F.lit("/x/sessions/s"), "conv_id", F.lit("/"), name).alias("path"), name.alias("file_name"), F.timestamp_seconds(F.lit(START)).alias("modified"), "value")


@query(f"""WITH t AS (SELECT conv_id, turn, {sql_strip("coalesce(text, '')")} AS text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS record FROM conversations)
SELECT 's' || conv_id AS unit, record, format('m{{:04d}}', record + 1) AS ref, sha256(text) AS digest, CASE WHEN turn % 6 = 1 THEN 'unknown' ELSE 'verbatim' END AS text_status, CASE WHEN turn % 6 = 1 THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
CAST(CASE WHEN turn % 2 = 0 THEN {START} + conv_id * 3600 + turn * 60 WHEN conv_id % 7 = 4 THEN {START} + conv_id ELSE {START} END AS BIGINT) AS epoch FROM t WHERE conv_id % 7 NOT IN (0, 1, 2, 3) AND turn % 6 IN (0, 1, 4) AND text <> ''""")
def sdk_session_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sdk_sessions.utterances(_session_files(spark, sf_dir))
    return out.select("unit", "record", "ref", F.sha2("text", 256).alias("digest"), "text_status", "confidence", F.unix_seconds("ts").alias("epoch"))


@query("""SELECT 's' || conv_id AS unit, CASE conv_id % 7 WHEN 0 THEN 'excluded' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'excluded' WHEN 3 THEN 'excluded' ELSE 'supported' END AS status, CAST(CASE WHEN conv_id % 7 IN (1, 4, 5, 6) THEN count(*) END AS INT) AS messages FROM conversations GROUP BY conv_id""")
def sdk_session_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sdk_sessions.units(_session_files(spark, sf_dir)).select("unit", "status", F.col("messages").cast("int").alias("messages"))


# --- Oldest trees and project inventories ---


def _old_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of five projects; by turn a message has its parts in files, inside itself, or nowhere."""
    rows = _turns(spark, sf_dir).withColumn("base", F.concat(F.lit("/r/project/p"), F.pmod("conv_id", F.lit(5)), F.lit("/storage/session/"))).withColumn("ses", F.concat(F.lit("ses_"), "conv_id")).withColumn("msg", F.concat(F.lit("msg_"), "turn"))
    info = rows.select("base", "ses", "conv_id").distinct().select(F.concat("base", F.lit("info/"), "ses", F.lit(".json")).alias("path"), F.to_json(F.struct(F.col("ses").alias("id"), F.when(F.col("conv_id") % 4 == 0, "x").alias("parentID"), F.concat(F.lit("0."), F.col("conv_id") % 3).alias("version"))).alias("value"))
    part = lambda x, i: F.struct(F.concat(F.lit("prt_"), F.lit(i)).alias("id"), F.lit("text").alias("type"), x.alias("text"), F.lit(i == 1).alias("synthetic"))
    own = [part(F.lit("more"), 2), part(F.lit("not the user's"), 1), part(F.col("text"), 0)]
    inside = F.when(F.col("turn") % 3 == 1, F.array(*own))
    role = F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")
    messages = rows.select(F.concat("base", F.lit("message/"), "ses", F.lit("/"), "msg", F.lit(".json")).alias("path"), F.to_json(F.struct(F.col("msg").alias("id"), role.alias("role"), F.struct(((F.lit(START) + F.col("turn")) * 1000).alias("created")).alias("time"), inside.alias("parts"))).alias("value"))
    parts = rows.where("turn % 3 = 0").select("base", "ses", "msg", F.explode(F.array(*own)).alias("p")).select(F.concat("base", F.lit("part/"), "ses", F.lit("/"), "msg", F.lit("/"), "p.id", F.lit(".json")).alias("path"), F.to_json("p").alias("value"))
    return info.union(messages).union(parts)


@query(f"""SELECT 'p' || conv_id % 5 AS project_key, 'ses_' || conv_id AS session_id, 'msg_' || turn AS message_id, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, '0.' || conv_id % 3 AS version, conv_id % 4 = 0 AS has_parent,
sha256(CASE WHEN text = '' THEN 'more' ELSE text || chr(10) || chr(10) || 'more' END) AS digest, CAST({START} + turn AS BIGINT) AS epoch FROM (SELECT conv_id, turn, {sql_strip("coalesce(text, '')")} AS text FROM conversations) WHERE turn % 3 <> 2""")
def old_tree_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stores.part_project_messages(_old_tree(spark, sf_dir))
    return out.select("project_key", "session_id", "message_id", "role", "version", F.col("parent_id").isNotNull().alias("has_parent"), F.sha2("text", 256).alias("digest"), F.unix_seconds("ts").alias("epoch"))


@query("""WITH m AS (SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 2), v AS (SELECT DISTINCT conv_id % 5 AS p, '0.' || conv_id % 3 AS v FROM m)
SELECT 'p' || p AS project_key, CAST(n AS BIGINT) AS records, string_agg(v, ',' ORDER BY v) AS versions, CASE WHEN count(*) = 1 THEN min(v) ELSE min(v) || '-' || max(v) END AS version_range FROM v JOIN (SELECT conv_id % 5 AS p, count(*) AS n FROM m GROUP BY 1) USING (p) GROUP BY p, n""")
def project_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and versions of each project; the newer generation holds half of the messages as well, which count once."""
    old = stores.part_project_messages(_old_tree(spark, sf_dir))
    both = old.unionByName(old.where("message_id like '%0'").withColumn("generation", F.lit("json-j2")))
    return stores.canonical_counts(both).select("project_key", "records", F.array_join("versions", ",").alias("versions"), "version_range")


# --- Instances ---


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = conversation_utterances(spark, sf_dir).select(F.element_at(F.array(F.lit("codex"), F.lit("claude_code"), F.lit("cursor")), (F.col("conv_id") % 3 + 1).cast("int")).alias("adapter_id"), F.concat(F.lit("k"), F.col("conv_id") % 8).alias("instance_key"), F.coalesce("text", F.lit("")).alias("text"), "ts")
    keys = u.select("adapter_id", "instance_key").distinct()
    verdicts = keys.select("*", (F.col("instance_key") != "k7").alias("supported"), F.lit(1).cast("long").alias("estimated_records"), F.lit("1.0").alias("adapter_version"), F.when(F.col("instance_key") == "k6", "beta").otherwise("stable").alias("stability"))
    return inventories.instances(u, verdicts)


_ADAPTER = "['codex', 'claude_code', 'cursor'][conv_id % 3 + 1]"
_INSTANCES = f"""i AS (SELECT {_ADAPTER} AS adapter_id, 'k' || conv_id % 8 AS instance_key, count(*) AS n, sum({sql_count_words("coalesce(text, '')")}) AS w, sum(strlen(coalesce(text, ''))) AS b, min(epoch) AS a, max(epoch) AS z FROM {CONVERSATIONS} GROUP BY 1, 2)"""


@query(f"""WITH {_INSTANCES} SELECT adapter_id, CASE adapter_id WHEN 'cursor' THEN 'Cursor' ELSE adapter_id END || ' ' || row_number() OVER (PARTITION BY adapter_id ORDER BY instance_key) AS opaque_label, CASE WHEN instance_key = 'k7' THEN 'unsupported_schema' ELSE 'found' END AS accessibility, CASE WHEN instance_key = 'k7' THEN 'SOURCE_UNSUPPORTED_SCHEMA' END AS diagnostic_code,
CAST(CASE WHEN instance_key = 'k7' THEN 0 ELSE n END AS BIGINT) AS candidate_messages, CAST(CASE WHEN instance_key = 'k7' THEN 0 ELSE w END AS BIGINT) AS candidate_words, CAST(CASE WHEN instance_key = 'k7' THEN 0 ELSE b END AS BIGINT) AS candidate_bytes, CAST(CASE WHEN instance_key <> 'k7' THEN a END AS BIGINT) AS earliest, CAST(CASE WHEN instance_key <> 'k7' THEN z END AS BIGINT) AS latest FROM i""")
def instance_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inventories.summaries(_inventory(spark, sf_dir), {"cursor": "Cursor"})
    return out.select("adapter_id", "opaque_label", "accessibility", "diagnostic_code", "candidate_messages", "candidate_words", "candidate_bytes", F.unix_seconds("earliest").alias("earliest"), F.unix_seconds("latest").alias("latest"))


@query(f"WITH {_INSTANCES} SELECT instance_key FROM i WHERE adapter_id = 'codex' AND instance_key NOT IN ('k6', 'k7')")
def default_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codex runtime reads its own stable, supported instances and nothing else."""
    return inventories.default_selection(_inventory(spark, sf_dir), "codex")


@query(f"""WITH u AS (SELECT conv_id, turn, 'k' || conv_id % 8 AS k, CASE WHEN (conv_id + turn) % 13 = 0 THEN '/' ELSE '' END || coalesce(text, '') AS text FROM conversations), n AS (SELECT k, count(*) AS n FROM u GROUP BY k)
SELECT 'SOURCE_HISTORY_CHANGED' AS code, k AS item_ref FROM n WHERE k IN ('k1', 'k2') UNION ALL SELECT 'SCHEMA_INVALID_VALUE', conv_id || ':' || turn FROM u WHERE starts_with(text, '/') UNION ALL SELECT 'SCHEMA_INVALID_VALUE', conv_id || ':' || turn FROM u WHERE NOT regexp_matches(text, '\\S')""")
def adapter_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extract with texts that begin like commands, against an inventory that counted two instances differently."""
    leaky = F.when((F.col("conv_id") + F.col("turn")) % 13 == 0, F.lit("/")).otherwise("")
    u = conversation_utterances(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("utterance_id"), F.lit("gemini_cli").alias("source_adapter"), F.concat(F.lit("k"), F.col("conv_id") % 8).alias("instance_key"), F.concat(leaky, F.coalesce("text", F.lit(""))).alias("text"), "ts")
    counted = u.groupBy("instance_key").agg(F.count("*").alias("n")).select("instance_key", (F.col("n") + F.when(F.col("instance_key").isin("k1", "k2"), 1).otherwise(0)).alias("candidate_messages"))
    return inventories.verified(counted, u, "gemini_cli", F.timestamp_seconds(F.lit(START + 10**9)), transcripts.starts_injected(F.ltrim("text")))


# --- Reports ---


@query("""WITH r AS (SELECT o_custkey AS run_id, ['created', 'processing', 'completed', 'checkpointed', 'expired', 'review'][o_custkey % 6 + 1] AS status, max(o_orderkey) AS started, 1700000000 - o_custkey * 360 AS last_checkpoint FROM orders GROUP BY o_custkey), s AS (SELECT o_custkey AS run_id, max(o_orderkey % 5) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT run_id, status, started, round(run_id * 360 / 3600.0, 1)::DOUBLE AS checkpoint_age_hours, p AS last_promoted_step, CASE run_id % 3 WHEN 0 THEN 'continue' WHEN 1 THEN 'restart' ELSE 'invalidate_downstream' END AS decision, run_id % 3 <> 1 AS offerable FROM r LEFT JOIN s USING (run_id) WHERE status NOT IN ('completed', 'expired')""")
def resume_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfinished runs with the age of their checkpoint, their last promoted step and what to do."""
    o = table(spark, sf_dir, "orders")
    states = F.array(*map(F.lit, ("created", "processing", "completed", "checkpointed", "expired", "review")))
    runs = o.groupBy(F.col("o_custkey").alias("run_id")).agg(F.max("o_orderkey").alias("started")).select("run_id", states[(F.col("run_id") % 6).cast("int")].alias("status"), "started", (F.lit(1_700_000_000) - F.col("run_id") * 360).alias("last_checkpoint"))
    steps = o.select(F.col("o_custkey").alias("run_id"), (F.col("o_orderkey") % 5).alias("step"), F.when(F.col("o_orderstatus") == "F", "promoted").otherwise("pending").alias("status"))
    decisions = runs.select("run_id", F.element_at(F.array(F.lit("continue"), F.lit("restart"), F.lit("invalidate_downstream")), (F.col("run_id") % 3 + 1).cast("int")).alias("decision"))
    return inventories.resume_report(runs, steps, decisions, F.lit(1_700_000_000)).select("run_id", "status", "started", F.col("checkpoint_age_hours").cast("double").alias("checkpoint_age_hours"), "last_promoted_step", "decision", "offerable")


@query("""WITH p AS (SELECT c_custkey AS run_id, unnest(['last-7-days', 'last-year', 'everything']) AS preset, unnest([c_custkey % 5 * 10, c_custkey % 7 * 10, c_custkey % 5 * 10]) AS words, unnest([c_custkey % 3, 1, c_custkey % 3]) AS utterances FROM customer)
SELECT run_id, preset, words, utterances FROM p WHERE run_id % 5 = 0 OR preset = 'everything' OR (preset = 'last-year' AND (run_id % 7 <> run_id % 5 OR run_id % 3 <> 1))""")
def distinct_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    row = lambda name, w, u: F.struct(F.lit(name).alias("preset"), w.alias("words"), u.cast("long").alias("utterances"))
    rows = table(spark, sf_dir, "customer").select(k.alias("run_id"), F.inline(F.array(row("last-7-days", k % 5 * 10, k % 3), row("last-year", k % 7 * 10, F.lit(1)), row("everything", k % 5 * 10, k % 3))))
    return inventories.distinct_presets(rows)


@query(f"SELECT CAST(conv_id % 10 AS BIGINT) AS run_id, CAST(count(*) FILTER (text IS NOT NULL AND regexp_matches(text, '\\S') AND turn % 3 <> 0) AS BIGINT) AS found, CAST(count(DISTINCT conv_id) AS BIGINT) AS sessions_analyzed, CAST({fixed.FOUND_TARGET} AS BIGINT) AS target, count(*) FILTER (text IS NOT NULL AND regexp_matches(text, '\\S') AND turn % 3 <> 0) >= {fixed.FOUND_TARGET} AS enough FROM conversations GROUP BY 1")
def found_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 10).cast("long").alias("run_id"), F.col("conv_id").alias("session_seq"), F.when(F.col("turn") % 3 != 0, F.col("text")).otherwise(" ").alias("line"))
    return inventories.found_count(rows)


@query("SELECT o_custkey AS run_id, o_orderkey AS step, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 0 THEN '1.' || o_orderkey % 7 END AS version, CASE WHEN o_orderkey % 4 = 0 THEN 'no report' WHEN o_orderkey % 3 = 0 THEN 'failed' END AS refusal FROM orders")
def attested_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return inventories.attested_version(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), k.alias("step"), (k % 3 != 0).alias("passed"), F.when(k % 4 != 0, F.concat(F.lit("1."), k % 7)).alias("verifier_version")))


@query("SELECT l.l_orderkey, l.l_linenumber, o.o_totalprice AS price FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey AND o.o_orderkey % 2 = 0 AND l.l_returnflag = 'A' AND l.l_linestatus = 'F'")
def profile_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of exactly a row's four keys; every second order has one."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("step"), F.col("l_returnflag").alias("runtime"), F.col("l_linestatus").alias("model"), F.lit("e").alias("effort"))
    profile = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("step"), F.lit("A").alias("runtime"), F.lit("F").alias("model"), F.lit("e").alias("effort"), F.col("o_totalprice").alias("price"))
    return inventories.profile_cell(rows, profile).select("l_orderkey", "l_linenumber", F.col("cell.price").alias("price"))


@query("SELECT l_returnflag AS runtime, bool_or(l_linestatus <> 'F' OR l_linenumber <> 1) AS elsewhere, coalesce(string_agg(DISTINCT l_linestatus || '/' || l_linenumber, ',' ORDER BY l_linestatus || '/' || l_linenumber) FILTER (l_linestatus <> 'F' OR l_linenumber <> 1), '') AS measured_with FROM lineitem GROUP BY l_returnflag")
def measured_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("runtime"), F.col("l_linestatus").alias("model"), F.col("l_linenumber").cast("string").alias("effort"), F.lit("F").alias("own_model"), F.lit("1").alias("own_effort"))
    return inventories.measured_elsewhere(rows).withColumn("measured_with", F.array_join("measured_with", ","))


@query("SELECT conv_id AS session_seq, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY conv_id || ':' || turn) AS INT) AS i, role AS mistake, CAST(turn AS VARCHAR) AS rule, coalesce(text, '') AS example, 'own' AS example_type FROM conversations")
def confidentiality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_seq"), F.concat_ws(":", "conv_id", "turn").alias("record_id"), F.col("role").alias("mistake"), F.col("turn").cast("string").alias("rule"), F.coalesce("text", F.lit("")).alias("example"), F.lit("own").alias("example_type"), F.lit("hidden").alias("source_type"))
    return inventories.confidentiality_rows(rows).withColumn("i", F.col("i").cast("int"))


@query("WITH n AS (SELECT conv_id, count(*) AS b, count(*) FILTER (turn % 7 <> 3) AS a FROM conversations GROUP BY conv_id) SELECT 'CARDINALITY_MISMATCH' AS code, 's' || conv_id AS item_ref FROM n WHERE a > 0 AND a <> b")
def line_count_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select(F.concat(F.lit("s"), "conv_id").alias("file_name"), "turn")
    return inventories.line_count_differences(lines, lines.where("turn % 7 <> 3"))


@query("SELECT conv_id || ':' || turn AS utterance_id FROM conversations WHERE text IS NOT NULL AND regexp_matches(text, '\\S') AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 3)")
def analysed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances of the sessions that the later step has a file of."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_seq"), F.concat_ws(":", "conv_id", "turn").alias("utterance_id"), "text", "turn")
    return inventories.analysed_ids(rows, rows.where("turn = 3"))


@query("SELECT 'CARDINALITY_MISMATCH' AS code, (event_id // 10) || ':' || event_id % 10 AS item_ref FROM events WHERE event_id % 10 > 0 AND (event_id - 1) % 4 <> 0 AND event_id % 4 = 0 AND event_id - 1 IN (SELECT event_id FROM events)")
def index_not_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.expr("event_id div 10").alias("run_id"), (F.col("event_id") % 10).alias("step"), (F.col("event_id") % 4 != 0).alias("has_index"))
    return inventories.index_not_carried(e)


@query(f"SELECT conv_id AS session_seq, CAST(count(*) AS BIGINT) AS records, CAST(sum({sql_count_words('text')}) AS BIGINT) AS words FROM (SELECT conv_id, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id")
def step_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventories.assignments(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_seq"), F.coalesce("text", F.lit("")).alias("text")))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a and b' ELSE 'a, b, and c' END AS prose, doc_id % 3 || ' ' || CASE WHEN doc_id % 3 = 1 THEN 'message' ELSE 'messages' END AS counted,
CASE WHEN doc_id % 2 = 0 THEN 'SCHEMA_MISSING_FIELD' WHEN doc_id % 3 = 0 THEN 'SCHEMA_UNEXPECTED_FIELD' WHEN doc_id % 5 = 0 THEN 'SCHEMA_INVALID_VALUE' END AS missing_first, CASE WHEN doc_id % 3 = 0 THEN 'SCHEMA_UNEXPECTED_FIELD' WHEN doc_id % 2 = 0 THEN 'SCHEMA_MISSING_FIELD' WHEN doc_id % 5 = 0 THEN 'SCHEMA_INVALID_VALUE' END AS extra_first,
CASE WHEN doc_id % 2 = 0 THEN CAST(1420070400 + doc_id AS BIGINT) END AS task_epoch, n_chars / 9000.0 AS low_minutes, n_chars / 4000.0 AS high_minutes FROM documents""")
def report_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    low, high = inventories.minutes_by_tokens(F.col("n_chars").cast("double"), F.col("n_chars").cast("double"))
    code = lambda first: inventories.validation_code(k % 2 == 0, k % 3 == 0, k % 5 == 0, first)
    task = F.when(k % 2 == 0, ((k + 1_420_070_400) * 1000).cast("string")).otherwise("task-1")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.and_list(F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (k % 4).cast("int"))).alias("prose"), F.concat_ws(" ", (k % 3).cast("string"), text.plural(k % 3, "message")).alias("counted"), code(False).alias("missing_first"), code(True).alias("extra_first"),
        F.unix_seconds(sdk_sessions.task_time(task)).alias("task_epoch"), low.alias("low_minutes"), high.alias("high_minutes"),
    )


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a=2,b=1' ELSE 'a=2,c=9' END AS live, doc_id % 3 = 0 AS changed FROM documents WHERE doc_id % 4 <> 0")
def live_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded versions with today's where the adapter is still there, of steps that weren't invalidated."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(k % 3 == 0, F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1"))).otherwise(F.create_map(F.lit("a"), F.lit("2"), F.lit("c"), F.lit("9"))).alias("recorded"), F.when(k % 4 == 0, "invalidated").otherwise("promoted").alias("status"))
    live = inventories.reusable(rows).withColumn("now", inventories.live_versions(F.col("recorded"), {"a": "2", "b": "1", "x": "3"}))
    shown = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return live.select("doc_id", shown("now").alias("live"), (shown("now") != shown("recorded")).alias("changed"))


# --- Fingerprints and plans ---


@query("SELECT event_id, concat_ws(';', CASE WHEN event_id % 2 = 0 THEN 'input' ELSE 'chat' END, ['none', 'lf', 'crlf', 'mixed'][event_id % 4 + 1], CASE WHEN event_id % 3 > 0 THEN 'ts-parse-errors' END, CASE WHEN event_id % 5 = 0 THEN 'ts-degraded' END) AS fingerprint FROM events")
def history_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    ends = F.element_at(F.array(*map(F.lit, ("none", "lf", "crlf", "mixed"))), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", fingerprints.history(F.when(k % 2 == 0, "input").otherwise("chat"), ends, k % 3, k % 5 == 0).alias("fingerprint"))


@query("""WITH f AS (SELECT user_id AS instance, event_id % 7 <> 0 AS ok, CASE WHEN user_id % 3 = 0 THEN 'jsonl' WHEN event_id % 2 = 0 THEN 'json' ELSE 'jsonl' END AS g, event_id % 5 = 0 AS d, user_id % 4 = 0 AS n, false AS k, user_id % 2 = 0 AS s, event_id % 11 = 0 AS c FROM events)
SELECT instance, concat_ws('+', CASE count(DISTINCT g) FILTER (ok) WHEN 0 THEN 'empty' WHEN 1 THEN min(g) FILTER (ok) ELSE 'mixed' END, CASE WHEN bool_or(ok AND d) THEN 'display' END, CASE WHEN bool_or(ok AND n) THEN 'notices' END, CASE WHEN bool_or(ok AND k) THEN 'kind' END, CASE WHEN bool_or(s) THEN 'subagent-dirs' END, CASE WHEN bool_or(c) THEN 'checkpoints' END) AS fingerprint FROM f GROUP BY instance""")
def chat_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("event_id"), F.col("user_id")
    files = table(spark, sf_dir, "events").select(u.alias("instance"), (k % 7 != 0).alias("supported"), F.when(u % 3 == 0, "jsonl").when(k % 2 == 0, "json").otherwise("jsonl").alias("generation"), (k % 5 == 0).alias("display"), (u % 4 == 0).alias("notices"), F.lit(False).alias("kind"), (u % 2 == 0).alias("subagent_dirs"), (k % 11 == 0).alias("checkpoints"))
    return fingerprints.chats(files)


@query("SELECT 's' || conv_id % 3 AS path, 'g1+g4;composer_v=12;bubble_v=3' AS fingerprint FROM conversations GROUP BY 1")
def composer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audits import _composer_items

    scans = composers.store_scan(composers.facts(_composer_items(spark, sf_dir)))
    return fingerprints.composers(scans.withColumns({"g1": F.lit(True), "g2": F.lit(False), "g5": F.lit(False)}))


@query("SELECT 'db' || conv_id % 11 AS path, CASE conv_id % 11 % 3 WHEN 0 THEN 'history-2024/opt3of8/' || CASE WHEN conv_id % 11 = 3 THEN 'mig7' ELSE 'mig-none' END || '/extra1+1' WHEN 1 THEN 'unsupported:missing-required' ELSE 'unsupported:no-history' END AS fingerprint FROM conversations GROUP BY conv_id % 11")
def dictation_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structure of made stores: whole, without a required column, without a history."""
    rows = table(spark, sf_dir, "conversations").select(F.pmod("conv_id", F.lit(11)).alias("k")).distinct()
    shapes = {0: {"History": ("transcriptEntityId", "asrText", "timestamp", "status", "app", "numWords"), "Notes": ("a",), "secret": ("b",), "SequelizeMeta": ("name",)}, 1: {"History": ("transcriptEntityId",)}, 2: {"Other": ("a",)}}
    found = spark.createDataFrame([(k, t, c) for k, tables in shapes.items() for t, columns in tables.items() for c in columns], "shape long, tbl string, col string")
    steps = spark.createDataFrame([("db3", 7)], "path string, n long")
    return fingerprints.dictation(rows.join(F.broadcast(found), F.col("k") % 3 == F.col("shape")).select(F.concat(F.lit("db"), "k").alias("path"), "tbl", "col"), steps)  # the columns of three shapes


@query("SELECT doc_id, source AS run_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 5)")
def promoted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the runs of which no record is at fault."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("run_id"))
    return judgments.promoted_records(d, d.where("doc_id % 97 = 5")).select("doc_id", "run_id")


@query(f"SELECT conv_id AS session_seq, CAST(count(*) AS BIGINT) AS records, CAST(sum({sql_count_words('joined')}) AS BIGINT) AS words FROM (SELECT conv_id, concat_ws(' ', role, 'a rule', coalesce(text, '')) AS joined FROM conversations) GROUP BY conv_id")
def verification_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_seq"), F.col("role").alias("mistake"), F.lit("a rule").alias("rule"), F.coalesce("text", F.lit("")).alias("example"))
    return judgments.verification_weights(rows)


_LEGAL = ", ".join(f"('{a}', '{b}')" for a, t in fixed.STEP_TRANSITIONS.items() for b in t)


@query(f"SELECT r_regionkey AS step, a AS from_status, b AS to_status FROM region, (VALUES {_LEGAL}) v(a, b) WHERE NOT (r_regionkey % 2 = 1 AND a = 'verified_deterministic' AND b = 'promoted')")
def step_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("step"), (F.col("r_regionkey") % 2 == 1).alias("semantic"))
    return lifecycle.step_targets(lifecycle.legal_steps(spark), steps)
