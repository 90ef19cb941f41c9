"""Registered queries of the raw readers, collecting and verification: raw lines are made from the test tables, so that SQL knows the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collect, verification
from ..sources import histories, records, stores, tasks, transcripts
from .registry import WS, _lit, query, sql_count_words, sql_reason
from .tables import CONVERSATIONS, DOCUMENTS, START, conversation_utterances, document_utterances, table

_SEEN = f"regexp_matches(text, {_lit('[^' + WS[1:])})"


def _k() -> Column:
    return F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6))


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, {_lit('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


def _lines(rows: DataFrame, name: str, line: Column) -> DataFrame:
    return rows.select(F.concat(F.lit(name), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), F.lit(True).alias("closed"), F.col("turn").cast("int").alias("line_no"), line.alias("line"))


# --- Typed records ---


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn by turn: plain, in blocks, marked as meta, behind a reminder, a tool's result, an answer; every seventh file is damaged."""
    rows, k = _turns(spark, sf_dir), _k()
    stamp = F.date_format(F.timestamp_seconds(START + F.col("conv_id") * 3600 + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = [F.when(k == 5, "assistant").otherwise("user").alias("type"), F.concat_ws(":", "conv_id", "turn").alias("uuid"), stamp.alias("timestamp"), F.concat(F.lit("c"), "conv_id").alias("sessionId"), F.when(k == 2, True).alias("isMeta"), F.when(k == 4, "done").alias("toolUseResult")]
    plain = F.to_json(F.struct(*head, F.struct(F.lit("user").alias("role"), F.when(k == 3, F.concat(F.lit("<system-reminder>x</system-reminder>"), "text")).otherwise(F.col("text")).alias("content")).alias("message")))
    blocks = F.to_json(F.struct(*head, F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")).alias("message")))
    good = _lines(rows, "/x/c", F.when(k == 1, blocks).otherwise(plain))
    return good.union(_lines(rows.where("conv_id % 7 = 0").withColumn("turn", -1 - F.col("turn")), "/x/c", F.lit("{broken")))


@query(f"SELECT 'c' || conv_id AS session_id, conv_id || ':' || turn AS uuid, sha256({sql_strip('text')}) AS digest, {START} + conv_id * 3600 + turn * 60 AS epoch FROM conversations WHERE conv_id % 7 <> 0 AND (conv_id + turn) % 6 IN (0, 1, 3) AND {_SEEN}")
def typed_transcript_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transcripts.typed_utterances(_typed(spark, sf_dir))
    return out.select("session_id", "uuid", F.sha2("text", 256).alias("digest"), F.unix_seconds("ts").alias("epoch"))


@query("SELECT '/x/c' || conv_id || '.jsonl' AS path, CAST(CASE WHEN conv_id % 7 = 0 THEN 2 ELSE 1 END * count(*) AS BIGINT) AS non_empty_lines, CAST(CASE WHEN conv_id % 7 = 0 THEN count(*) ELSE 0 END AS BIGINT) AS malformed_lines, conv_id % 7 <> 0 AS supported FROM conversations GROUP BY conv_id")
def typed_transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.typed_files(transcripts.typed_records(_typed(spark, sf_dir))).select("path", "non_empty_lines", "malformed_lines", "supported")


# --- Rollouts ---


def _rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir)
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    heads = rows.select("conv_id").distinct().withColumn("turn", F.lit(-1))
    head = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("id"), "conv_id").alias("id"), F.when(F.col("conv_id") % 9 == 0, "other").alias("parent_thread_id")).alias("payload")))
    event = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("user_message").alias("type"), F.when(k == 2, F.concat(F.lit("<turn_context>"), "text")).otherwise(F.col("text")).alias("message"), F.when(k == 0, "plain").when(k == 3, "other").alias("kind")).alias("payload")))
    item = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), F.lit("user").alias("role"), F.array(F.struct(F.lit("input_text").alias("type"), F.col("text").alias("text"))).alias("content")).alias("payload")))
    return _lines(heads, "/x/r", head).union(_lines(rows, "/x/r", F.when(F.col("conv_id") % 4 == 0, item).otherwise(event)))


@query(f"""SELECT 'id' || conv_id AS session_id, CAST(turn AS INT) AS line_no, sha256(text) AS digest, CAST(CASE WHEN conv_id % 4 = 0 THEN 0.85 WHEN (conv_id + turn) % 5 = 0 THEN 0.95 ELSE 0.9 END AS DOUBLE) AS confidence FROM conversations
WHERE conv_id % 9 <> 0 AND {_SEEN} AND (conv_id % 4 = 0 OR (conv_id + turn) % 5 NOT IN (2, 3))""")
def rollout_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.rollout_utterances(_rollouts(spark, sf_dir)).select("session_id", "line_no", F.sha2("text", 256).alias("digest"), F.col("confidence").cast("double").alias("confidence"))


@query("""SELECT 'id' || conv_id AS session_id, 'supported' AS status, CASE WHEN conv_id % 4 = 0 THEN CASE WHEN sum(length(text)) > 0 THEN 'response-items' ELSE 'meta-only' END ELSE 'legacy-events' END AS generation, conv_id % 9 <> 0 AS eligible FROM conversations GROUP BY conv_id""")
def rollout_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.rollout_files(transcripts.rollout_lines(_rollouts(spark, sf_dir))).select("session_id", "status", "generation", "eligible")


# --- Chats ---


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each fifth turn the id is that of the turn before, which it so rewrites."""
    rows = _turns(spark, sf_dir)
    k = F.col("turn") % 4
    ident = F.concat(F.lit("m"), F.when(F.col("turn") % 5 == 4, F.col("turn") - 1).otherwise(F.col("turn")).cast("string"))
    heads = rows.select("conv_id").distinct().withColumn("turn", F.lit(-1))
    head = F.to_json(F.struct(F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.lit("p").alias("projectHash"), F.when(F.col("conv_id") % 6 == 0, "subagent").alias("kind")))
    plain = F.to_json(F.struct(ident.alias("id"), F.when(k == 3, "gemini").otherwise("user").alias("type"), F.concat(F.lit("w "), "text").alias("content")))
    listed = F.to_json(F.struct(ident.alias("id"), F.lit("user").alias("type"), F.array(F.struct(F.concat(F.lit("w "), "text").alias("text"), F.when(k == 2, F.struct(F.lit(1).alias("x"))).alias("functionCall"))).alias("content")))
    return _lines(heads, "/x/g", head).union(_lines(rows, "/x/g", F.when(k.isin(1, 2), listed).otherwise(plain)))


@query(f"""WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN turn - 1 ELSE turn END AS id, turn % 4 IN (0, 1) AS good, {sql_strip("'w ' || text")} AS text FROM conversations WHERE conv_id % 6 <> 0)
SELECT 's' || conv_id AS session_id, 'm' || id AS message_id, sha256(text) AS digest FROM m QUALIFY row_number() OVER (PARTITION BY conv_id, id ORDER BY turn DESC) = 1 AND good""")
def chat_log_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.chat_utterances(transcripts.chat_lines(_chats(spark, sf_dir))).select("session_id", "message_id", F.sha2("text", 256).alias("digest"))


# --- Histories ---


@query(f"""WITH e AS (SELECT conv_id, turn, {sql_strip('text')} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal FROM conversations)
SELECT '/x/h' || conv_id AS path, CAST(ordinal AS INT) AS ordinal, sha256(t) AS digest, CAST({START} + turn % 3600 AS BIGINT) AS epoch FROM e WHERE t <> '' AND NOT starts_with(t, '/') AND NOT starts_with(t, '!')""")
def input_history_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history file for each conversation: a time line and an entry for each turn."""
    block = F.concat(F.lit("\n# "), F.date_format(F.timestamp_seconds(START + F.col("turn") % 3600), "yyyy-MM-dd HH:mm:ss"), F.lit("\n+"), F.regexp_replace("text", "\n", "\n+"), F.lit("\n"))
    listed = F.array_sort(F.collect_list(F.struct("turn", block.alias("b"))))
    found = _turns(spark, sf_dir).groupBy(F.concat(F.lit("/x/h"), "conv_id").alias("path")).agg(F.array_join(F.transform(listed, lambda x: x["b"]), "").alias("value"))
    return histories.input_utterances(found).select("path", "ordinal", F.sha2("text", 256).alias("digest"), F.unix_seconds("ts").alias("epoch"))


# --- Stores ---


@query(f"SELECT CAST(conv_id AS VARCHAR) AS message_id, sha256(string_agg(t, chr(10) || chr(10) ORDER BY turn)) AS digest, CAST(count(*) AS BIGINT) AS parts FROM (SELECT conv_id, turn, {sql_strip('text')} AS t FROM conversations WHERE turn % 5 <> 0) WHERE t <> '' GROUP BY conv_id")
def parts_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir)
    data = F.to_json(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), (F.col("turn") % 5 == 0).alias("synthetic")))
    parts = rows.select(F.col("conv_id").cast("string").alias("message_id"), F.lpad(F.col("turn").cast("string"), 9, "0").alias("part_id"), F.parse_json(data).alias("v"))
    return stores.joined_parts(parts, ["message_id"]).select("message_id", F.sha2("text", 256).alias("digest"), F.size("part_ids").cast("long").alias("parts"))


@query(f"""WITH m AS (SELECT conv_id, turn, g, nullif({sql_strip('text')}, '') AS t FROM conversations, (VALUES ('sqlite'), ('json-j2')) v(g) WHERE g = 'sqlite' OR turn % 2 = 0)
SELECT 's' || conv_id AS session_id, 'm' || turn AS message_id, 'sqlite' AS generation FROM m WHERE t IS NOT NULL AND conv_id % 3 <> 0 GROUP BY conv_id, turn""")
def stores_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations of one store: the copy of the database wins; sessions with a parent go."""
    rows = _turns(spark, sf_dir).select(F.concat(F.lit("s"), "conv_id").alias("session_id"), F.concat(F.lit("m"), "turn").alias("message_id"), F.nullif(records.strip(F.col("text")), F.lit("")).alias("text"), "turn", F.when(F.col("conv_id") % 3 == 0, "p").alias("parent_id"), F.lit("user").alias("role"), F.lit(None).cast("timestamp").alias("ts"), F.lit("p").alias("project_key"), F.lit(None).cast("array<string>").alias("part_ids"))
    both = rows.select("*", F.lit("sqlite").alias("generation"), F.lit("a").alias("path")).union(rows.where("turn % 2 = 0").select("*", F.lit("json-j2").alias("generation"), F.lit("b").alias("path")))
    return stores.part_utterances(both).select("session_id", "message_id", "generation")


_DICTATION = "(SELECT user_id, CASE WHEN event_id % 211 = 0 THEN '' WHEN user_id % 3 = 0 THEN CAST(event_id // 2 AS VARCHAR) ELSE CAST(event_id AS VARCHAR) END AS id, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE event_type END AS t FROM events)"


@query(f"""WITH r AS (SELECT *, count(*) OVER (PARTITION BY user_id, id) AS n FROM {_DICTATION}), s AS (SELECT user_id, count(*) FILTER (trim(t) <> '') AS seen, count(*) FILTER (trim(t) <> '' AND (id = '' OR n > 1)) AS anomalies, count(*) FILTER (trim(t) = '') AS empty_rows FROM r GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS path, CAST(seen AS BIGINT) AS seen, CAST(anomalies AS BIGINT) AS pk_anomalies, CAST(empty_rows AS BIGINT) AS empty_rows, anomalies <= seen * 0.01 AS supported FROM s""")
def dictation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ident = F.when(F.col("event_id") % 211 == 0, "").when(F.col("user_id") % 3 == 0, F.expr("cast(event_id div 2 as string)")).otherwise(F.col("event_id").cast("string"))
    rows = e.select(F.col("user_id").cast("string").alias("path"), ident.alias("transcriptEntityId"), F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.col("event_type")).alias("asrText"), F.lit(None).cast("string").alias("status"))
    return stores.dictation_files(stores.mark_anomalies(rows)).select("path", "seen", "pk_anomalies", "empty_rows", "supported")


@query(f"SELECT CAST(conv_id AS VARCHAR) AS path, CAST(turn AS INT) AS record, sha256({sql_strip('text')}) AS digest FROM conversations WHERE turn % 4 IN (0, 3) AND {_SEEN} AND NOT regexp_matches(text, '<(file|url|folder)_content')")
def task_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 4
    body = F.concat(F.when(k == 2, "<environment_details>").otherwise(""), F.lit("<task>"), F.when(k == 3, "<explicit_instructions a='b'>x</explicit_instructions>").otherwise(""), "text", F.when(k == 1, "").otherwise("</task>"))
    doc = F.to_json(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), body.alias("text"))).alias("content")))
    rows = _turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("int").alias("record"), F.parse_json(doc).alias("v"))
    return tasks.spans(tasks.payloads(rows)).select("path", "record", F.sha2("text", 256).alias("digest"))


# --- Line scans ---


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, i, t = _k(), F.col("turn").alias("i"), F.col("text").alias("text")
    good, missing, extra, wrong = (F.to_json(F.struct(*c)) for c in ((i, t), (i,), (i, t, F.lit(1).alias("z")), (F.col("turn").cast("string").alias("i"), t)))
    return _lines(_turns(spark, sf_dir), "/x/a", F.when(k == 1, missing).when(k == 2, extra).when(k == 3, wrong).when(k == 4, "{").otherwise(good))


_CODES = "CASE (conv_id + turn) % 6 WHEN 1 THEN 'SCHEMA_MISSING_FIELD' WHEN 2 THEN 'SCHEMA_UNKNOWN_FIELD' WHEN 3 THEN 'SCHEMA_INVALID_VALUE' ELSE 'SCHEMA_INVALID_JSON' END"


@query(f"SELECT '/x/a' || conv_id || '.jsonl:' || (turn + 1) AS item_ref, {_CODES} AS code FROM conversations WHERE (conv_id + turn) % 6 IN (1, 2, 3, 4)")
def tolerant_scan_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.tolerant(_answers(spark, sf_dir), {"i": "long", "text": "string"})[1].select("item_ref", "code")


@query(f"SELECT '/x/a' || conv_id || '.jsonl:' || (arg_min(turn, turn) + 1) AS item_ref, arg_min({_CODES}, turn) AS code FROM conversations WHERE (conv_id + turn) % 6 IN (1, 2, 3, 4) GROUP BY conv_id")
def strict_scan_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.strict(_answers(spark, sf_dir), {"i": "long", "text": "string"})[1].select("item_ref", "code")


# --- Collecting ---

_A, _B, _CUT = START + 100, START + 300 * 3600, START + 200 * 3600


@query(f"SELECT source_adapter, CAST(count(*) AS BIGINT) AS kept FROM (SELECT source_adapter, epoch FROM {DOCUMENTS} UNION ALL SELECT 'conversations', epoch FROM {CONVERSATIONS}) WHERE epoch BETWEEN {_A} AND {_CUT} GROUP BY source_adapter")
def collected_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda x: F.timestamp_seconds(F.lit(x))
    return collect.per_source(collect.collected([document_utterances(spark, sf_dir), conversation_utterances(spark, sf_dir)], at(_A), at(_B), at(_CUT)))


@query(f"""WITH r AS (SELECT utterance_id || CASE WHEN conv_id % 5 = 1 AND turn <= 1 THEN '' ELSE ':' || turn END AS id, CASE WHEN conv_id % 7 = 2 THEN 'other' ELSE 'conversations' END AS a, text, epoch FROM {CONVERSATIONS})
SELECT 'SCHEMA_INVALID_VALUE' AS code, id AS item_ref FROM r WHERE a <> 'conversations' UNION ALL SELECT 'SCHEMA_INVALID_VALUE', id FROM r WHERE NOT regexp_matches(text, '\\S') UNION ALL SELECT 'CARDINALITY_MISMATCH', id FROM r GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'TIMESTAMP_IMPLAUSIBLE', id FROM r WHERE epoch > {START} + 50 * 3600 + 86400""")
def extract_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = conversation_utterances(spark, sf_dir)
    u = u.withColumn("utterance_id", F.concat("utterance_id", F.when((F.col("conv_id") % 5 == 1) & (F.col("turn") <= 1), "").otherwise(F.concat(F.lit(":"), "turn")))).withColumn("source_adapter", F.when(F.col("conv_id") % 7 == 2, "other").otherwise(F.col("source_adapter")))
    return collect.extract_diagnostics(u, "conversations", F.timestamp_seconds(F.lit(START + 50 * 3600)))


# --- Verification ---


@query(f"""WITH c AS (SELECT conv_id, count(*) AS n, CAST(sum(CASE WHEN {sql_reason('text')} = 'latin_script' THEN {sql_count_words('text')} ELSE 0 END) AS BIGINT) AS w FROM conversations GROUP BY conv_id)
SELECT CASE conv_id % 9 WHEN 1 THEN 'ARITHMETIC_INVARIANT_VIOLATION' ELSE 'CARDINALITY_MISMATCH' END AS code, CAST(conv_id AS VARCHAR) AS item_ref FROM c WHERE conv_id % 9 IN (1, 2, 3)""")
def corpus_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index with planted faults: other words, other counts, sessions that it doesn't list."""
    from ..functions import text as words

    c = conversation_utterances(spark, sf_dir).select(F.col("conv_id").alias("session_seq"), "utterance_id", "text")
    k = F.col("session_seq") % 9
    index = c.groupBy("session_seq").agg(F.count("*").alias("utterances"), F.sum(words.english_words(F.col("text"))).alias("words")).where(k != 3)
    index = index.withColumn("words", F.col("words") + F.when(k == 1, 1).otherwise(0)).withColumn("utterances", F.col("utterances") - F.when(k == 2, 1).otherwise(0))
    return verification.corpus_diagnostics(c, index)


@query("""SELECT CASE doc_id % 11 WHEN 1 THEN 'LINEAGE_MISSING_INPUT' WHEN 2 THEN 'CARDINALITY_MISMATCH' ELSE 'LINEAGE_HASH_MISMATCH' END AS code, 'f' || doc_id AS item_ref FROM documents WHERE doc_id % 11 IN (1, 2, 3)""")
def index_against_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), "doc_id").alias("file_name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    k = F.col("doc_id") % 11
    listed = d.where(k != 2).withColumn("sha256", F.when(k == 3, F.reverse("sha256")).otherwise(F.col("sha256")))
    return verification.file_diagnostics(d.where(k != 1), listed)


@query("SELECT CASE WHEN turn % 7 = 3 THEN 'CARDINALITY_MISMATCH' ELSE 'SCHEMA_INVALID_VALUE' END AS code, conv_id || ':' || turn AS item_ref FROM conversations WHERE turn % 7 IN (3, 5)")
def line_for_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = conversation_utterances(spark, sf_dir).select("conv_id", "turn", "role", "modality")
    after = before.where("turn % 7 <> 3").withColumn("modality", F.when(F.col("turn") % 7 == 5, "unknown").otherwise(F.col("modality")))
    return verification.line_diagnostics(before, after, ["conv_id", "turn"], ["role", "modality"])


@query("SELECT CAST(doc_id // 10 AS BIGINT) AS run_id, min(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 10 END) AS next_step, max(CASE WHEN doc_id % 3 = 0 THEN doc_id % 10 END) AS last_promoted FROM documents GROUP BY 1")
def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("run_id"), (F.col("doc_id") % 10).alias("step"), F.when(F.col("doc_id") % 3 == 0, "promoted").otherwise("pending").alias("status"))
    return verification.next_step(d)


@query("SELECT doc_id // 10 AS run_id, doc_id % 10 AS step, CASE WHEN doc_id % 3 = 0 AND doc_id // 10 % 2 = 0 AND doc_id % 10 >= 4 THEN 'invalidated' WHEN doc_id % 3 = 0 THEN 'promoted' ELSE 'pending' END AS status FROM documents")
def invalidated_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 10").alias("run_id"), (F.col("doc_id") % 10).alias("step"), F.when(F.col("doc_id") % 3 == 0, "promoted").otherwise("pending").alias("status"))
    earliest = d.where("run_id % 2 = 0").select("run_id", F.lit(4).cast("long").alias("earliest_step")).distinct()
    return verification.invalidated(d, earliest).select("run_id", "step", "status")


@query("SELECT o_custkey AS run_id, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS done, CAST(count(*) AS BIGINT) AS total, CAST(100 * count(*) FILTER (o_orderstatus = 'F') // count(*) AS BIGINT) AS percent FROM orders GROUP BY 1")
def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.progress(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), (F.col("o_orderstatus") == "F").alias("done")))
