"""Registered queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import counts, dedup, judgments, sessions
from .tables import CONVERSATIONS, DOCUMENTS, START, conversation_utterances, document_utterances, spread, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its own name, with its oracle if SQL can express it."""

    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


WS = fixed.white_space_class()


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {_lit(WS + '+')}), lambda t: t <> '')"


def sql_words(x: str) -> str:
    stripped = f"list_transform({sql_tokens(f'nfc_normalize({x})')}, lambda t: trim(t, {_lit(fixed.STRIP_CHARS)}))"
    kept = f"list_filter({stripped}, lambda t: t <> '' AND NOT regexp_matches(t, {_lit(fixed.EXCLUDED_TOKEN)}))"
    return f"flatten(list_transform({kept}, lambda t: regexp_extract_all(t, {_lit(fixed.WORD)})))"


def sql_count_words(x: str) -> str:
    return f"CAST(coalesce(len({sql_words(x)}), 0) AS BIGINT)"


LETTER, LATIN = _lit(r"\p{L}"), _lit(fixed.latin_class())


def _letters(x: str, kind: str = LETTER) -> str:
    return f"len(regexp_extract_all({x}, {kind}))"


def _foreign(x: str) -> str:
    return f"({_letters(x)} - {_letters(x, LATIN)})"


def sql_reason(x: str) -> str:
    letters, foreign = _letters(x), _foreign(x)
    tokens = sql_tokens(x)
    rest = f"array_to_string(list_filter({tokens}, lambda t: {_foreign('t')} = 0), ' ')"
    mixes = f"len(list_filter({tokens}, lambda t: {_foreign('t')} > 0 AND regexp_matches(t, {LATIN}))) > 0"
    return (
        f"CASE WHEN {letters} = 0 THEN 'no_letters' WHEN {foreign} = 0 AND NOT regexp_matches({x}, '[A-Za-z]') THEN 'no_ascii_letters' WHEN {foreign} = 0 THEN 'latin_script' "
        f"WHEN {foreign} * 100 > {letters} * {fixed.NON_LATIN_LETTER_PERCENT_LIMIT} THEN 'non_latin_share_exceeded' WHEN {mixes} THEN 'token_mixes_scripts' "
        f"WHEN {sql_count_words(rest)} < {fixed.MIN_REMAINDER_WORDS} THEN 'remainder_below_minimum' WHEN NOT regexp_matches({rest}, '[A-Za-z]') THEN 'no_ascii_letters' ELSE 'non_latin_tokens_stripped' END"
    )


def _long(x) -> object:
    return F.col(x).cast("long") if isinstance(x, str) else x.cast("long")


# --- Words and English ---


@query(f"SELECT modality, CAST(count(*) AS BIGINT) AS utterances, CAST(sum({sql_count_words('text')}) AS BIGINT) AS words FROM {CONVERSATIONS} GROUP BY modality")
def word_count_by_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_utterances(spark, sf_dir).groupBy("modality").agg(F.count("*").alias("utterances"), F.sum(text.count_words(F.col("text"))).alias("words"))


@query(f"SELECT lang, CAST(count(*) AS BIGINT) AS documents, CAST(sum({sql_count_words('text')}) AS BIGINT) AS words FROM documents GROUP BY lang")
def word_count_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("lang", "text")).groupBy("lang").agg(F.count("*").alias("documents"), F.sum(text.count_words(F.col("text"))).alias("words"))


_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшщыз"
_MIXED_SQL = f"CASE doc_id % 4 WHEN 1 THEN text || ' слово' WHEN 2 THEN text || ' ' || translate(lower(text), '{_LATIN}', '{_CYRILLIC}') WHEN 3 THEN 'да' || text ELSE text END"


def _mixed() -> object:
    """Derived texts of mixed scripts: a word of another script, as many letters of one, one within a word."""
    t, k = F.col("text"), F.col("doc_id") % 4
    return F.when(k == 1, F.concat(t, F.lit(" слово"))).when(k == 2, F.concat(t, F.lit(" "), F.translate(F.lower(t), _LATIN, _CYRILLIC))).when(k == 3, F.concat(F.lit("да"), t)).otherwise(t)


@query(f"SELECT doc_id, {sql_reason('x')} AS reason FROM (SELECT doc_id, {_MIXED_SQL} AS x FROM documents)")
def language_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", _mixed().alias("x")).select("doc_id", text.classify_english(F.col("x"))["reason"].alias("reason"))


@query(f"SELECT modality, CAST(sum(CASE WHEN {sql_reason('text')} = 'latin_script' THEN {sql_count_words('text')} ELSE 0 END) AS BIGINT) AS english FROM {CONVERSATIONS} GROUP BY modality")
def english_words_by_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(conversation_utterances(spark, sf_dir).select("modality", "text")).groupBy("modality").agg(F.sum(text.english_words(F.col("text"))).alias("english"))


@query(r"SELECT doc_id, CAST(length(x) - length(replace(x, chr(10), '')) + 1 AS BIGINT) AS n_lines FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '- ' || text WHEN doc_id % 3 = 1 THEN '## ' || text ELSE text END AS x FROM documents) WHERE length(x) - length(replace(x, chr(10), '')) + 1 BETWEEN 3 AND 149 AND regexp_matches(x, '(?m)^(#{1,6} |\s*[-*]\s|\s*\d+\.\s)')")
def pasted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    mark = F.when(F.col("doc_id") % 3 == 0, "- ").when(F.col("doc_id") % 3 == 1, "## ").otherwise("")
    d = d.select("doc_id", F.concat(mark, "text").alias("text"))
    return d.where(text.is_pasted_document(F.col("text"), 3, fixed.PASTED_MAX_LINES)).select("doc_id", (F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("n_lines"))


@query(f"SELECT item_id, CAST(len({sql_tokens('text')}) AS BIGINT) AS n_words, len({sql_tokens('text')}) > {fixed.MAX_EXAMPLE_WORDS} AS too_long FROM benchmark")
def long_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(text.split_words(F.col("text")))
    return table(spark, sf_dir, "benchmark").select("item_id", _long(n).alias("n_words"), (n > fixed.MAX_EXAMPLE_WORDS).alias("too_long"))


# --- Privacy ---

_RE2 = {
    "PRIVACY_EMAIL_PRESENT": r"(?:^|[^\p{L}\p{N}_])[\p{L}\p{N}_][\p{L}\p{N}_.+-]*@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]*[\p{L}\p{N}_]",
    "PRIVACY_CREDENTIAL_PATTERN": fixed.CREDENTIAL.removeprefix("(?U)"),
    "PRIVACY_SUSPICIOUS_NUMBER": fixed.NUMBER.removeprefix("(?U)"),
}


def _privacy(code: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
        return d.where(text.has_pattern(F.col("text"), code)).select("doc_id", F.lit(code).alias("code"))

    run.__name__ = code.lower()
    return run


for _code, _ in fixed.PRIVACY_CHECKS:
    query(f"SELECT doc_id, '{_code}' AS code FROM documents WHERE regexp_matches(text, {_lit(_RE2[_code])})" if _code in _RE2 else None)(_privacy(_code))


@query()
def privacy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All codes of each document, with the invisible-character check; look-around is beyond the oracle's regex engine."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(text.privacy_codes(F.col("text"))).alias("code"))


@query(f"SELECT doc_id, sha256(translate(text || 'Привет Αθηνα', {_lit(''.join(a for a, _ in fixed.LOOKALIKES))}, {_lit(''.join(b for _, b in fixed.LOOKALIKES))})) AS folded FROM documents")
def lookalike_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("text", F.lit("Привет Αθηνα"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.fold_lookalikes(t), 256).alias("folded"))


@query(r"""WITH d AS (SELECT doc_id, n_chars * 997 AS t, n_chars * 61 // 60 AS m, source || '/' || doc_id AS p FROM documents)
SELECT doc_id, CASE WHEN t >= 1000000000 THEN regexp_replace(printf('%.1f', t / 1e9), '\.0$', '') || 'B' WHEN t >= 1000000 THEN regexp_replace(printf('%.1f', t / 1e6), '\.0$', '') || 'M' WHEN t >= 1000 THEN CAST(round_even(t / 1000, 0) AS BIGINT) || 'K' ELSE CAST(t AS VARCHAR) END AS tokens,
CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || CASE WHEN m = 1 THEN ' minute ago' ELSE ' minutes ago' END WHEN m < 1440 THEN (m // 60) || CASE WHEN m // 60 = 1 THEN ' hour ago' ELSE ' hours ago' END ELSE (m // 1440) || CASE WHEN m // 1440 = 1 THEN ' day ago' ELSE ' days ago' END END AS age,
CASE WHEN regexp_matches(p, '^[A-Za-z0-9_.:-]{1,128}$') THEN p ELSE 'h' || substr(sha256(p), 1, 16) END AS id_part FROM d""")
def format_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.format_tokens(F.col("n_chars") * 997).alias("tokens"), text.describe_age(F.col("n_chars") * 61).alias("age"), text.safe_id_part(F.concat_ws("/", "source", "doc_id")).alias("id_part"))


# --- Deduplication ---

_KEYED = f"SELECT *, lower(trim(regexp_replace(text, {_lit(WS + '+')}, ' ', 'g'))) AS key FROM {DOCUMENTS}"
_EXACT = f"""WITH RECURSIVE rows AS MATERIALIZED ({_KEYED}),
edges AS MATERIALIZED (SELECT a.utterance_id AS a, b.utterance_id AS b FROM rows a JOIN rows b ON a.key = b.key AND a.source_adapter <> b.source_adapter AND abs(a.epoch - b.epoch) <= {fixed.PROXIMITY_SECONDS}),
reach(node, other) AS (SELECT utterance_id, utterance_id FROM rows UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
cluster AS MATERIALIZED (SELECT node, min(other) AS root FROM reach GROUP BY node),
best AS MATERIALIZED (SELECT root, arg_min(utterance_id, (text_status <> 'verbatim', epoch, utterance_id)) AS canonical FROM cluster JOIN rows ON node = utterance_id GROUP BY root)
"""


@query(_EXACT + "SELECT canonical AS utterance_id FROM best")
def exact_dedup_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(document_utterances(spark, sf_dir), fuzzy=False)[0]


@query(_EXACT + "SELECT node AS excluded_utterance_id, canonical AS canonical_utterance_id, 'exact' AS kind FROM cluster JOIN best USING (root) WHERE node <> canonical")
def exact_dedup_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(document_utterances(spark, sf_dir), fuzzy=False)[1]


@query()
def fuzzy_dedup_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and fuzzy copies; the similarity ratio is beyond SQL, brute force holds it in the tests."""
    return dedup.deduplicate(document_utterances(spark, sf_dir))[1]


@query("SELECT sha256(text) AS h, min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY 1")
def hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source, sha256(text) ORDER BY n_chars DESC, doc_id) = 1")
def fork_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("h"))
    return dedup.first_of(d, ["source", "h"], [-F.col("n_chars"), F.col("doc_id")]).select("doc_id", "source")


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS last_event, min(event_id) AS first_position FROM events GROUP BY user_id, event_type")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return dedup.last_write_wins(e, ["user_id", "event_type"], "event_id").select("user_id", "event_type", F.col("event_id").alias("last_event"), "first_position")


_GRAPH = "SELECT doc_id AS a, CASE WHEN doc_id % 7 = 0 THEN doc_id ELSE doc_id // 3 END AS b FROM documents"


@query(f"""WITH RECURSIVE e AS ({_GRAPH}), sides AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, other) AS (SELECT a, b FROM sides UNION SELECT r.node, x.b FROM reach r JOIN sides x ON x.a = r.other)
SELECT node, min(least(node, other)) AS root FROM reach GROUP BY node HAVING min(least(node, other)) < node""")
def transitive_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "documents").selectExpr("doc_id AS a", "CASE WHEN doc_id % 7 = 0 THEN doc_id ELSE doc_id div 3 END AS b")
    return dedup.components(e)


# --- Joins ---


@query("SELECT d.doc_id, l.quality, l.doc_id IS NULL AS excluded FROM documents d LEFT JOIN labels l USING (doc_id)")
def selected_with_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("found"))
    return d.join(lab, "doc_id", "left").select("doc_id", "quality", F.col("found").isNull().alias("excluded"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def survivors_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("SELECT source, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def removed_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", "doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("source", "doc_id")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right_only' ELSE 'left_only' END AS side FROM (SELECT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT CASE WHEN doc_id % 5 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def file_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = table(spark, sf_dir, "labels").selectExpr("CASE WHEN doc_id % 5 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id")
    return judgments.file_set_difference(table(spark, sf_dir, "documents"), other, "doc_id")


@query(f"SELECT a.event_id AS first_event, b.event_id AS second_event FROM events a JOIN events b ON a.event_type = b.event_type AND a.user_id = b.user_id AND a.event_id <> b.event_id AND (b.ts > a.ts OR (b.ts = a.ts AND b.event_id > a.event_id)) AND epoch_us(b.ts) - epoch_us(a.ts) <= {fixed.PROXIMITY_SECONDS * 1_000_000}")
def range_join_ten_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    after = (F.col("r.at") > F.col("l.at")) | (F.col("r.event_id") > F.col("l.event_id"))
    return dedup.bucketed_range_join(e, e, "at", fixed.PROXIMITY_SECONDS * 1_000_000, after & (F.col("l.event_id") != F.col("r.event_id")), ["user_id", "event_type"]).select(F.col("l.event_id").alias("first_event"), F.col("r.event_id").alias("second_event"))


@query("""WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, u.turn, coalesce(a.turn, u.turn) AS answered_at FROM u LEFT JOIN a USING (conv_id, n)""")
def positional_feedback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    u = c.where("role = 'user'").select("conv_id", "turn", n.alias("n"))
    a = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("a_turn"), n.alias("n"))
    return u.join(a, ["conv_id", "n"], "left").select("conv_id", "turn", F.coalesce("a_turn", "turn").alias("answered_at"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events")
def asof_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", sessions.carry_forward(e, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_id")).alias("last_purchase"))


@query("SELECT n_name, r_name, CAST(count(s_suppkey) AS BIGINT) AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def dimension_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, s = (table(spark, sf_dir, x) for x in ("nation", "region", "supplier"))
    per = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return n.join(r, n.n_regionkey == r.r_regionkey).join(per, "n_nationkey", "left").select("n_name", "r_name", F.coalesce("suppliers", F.lit(0)).cast("long").alias("suppliers"))


# --- Sessions and windows ---


@query(f"""WITH s AS (SELECT session_hash, min(epoch) AS first FROM {CONVERSATIONS} GROUP BY 1), f AS (SELECT c.session_hash, arg_min(utterance_id, (epoch, utterance_id)) AS id, first FROM {CONVERSATIONS} c JOIN s USING (session_hash) GROUP BY ALL),
n AS (SELECT session_hash, row_number() OVER (ORDER BY first, id) AS session_seq FROM f)
SELECT utterance_id, CAST(session_seq AS BIGINT) AS session_seq, CAST(row_number() OVER (PARTITION BY session_hash ORDER BY epoch, utterance_id) AS BIGINT) AS i, format('session-{{:04d}}.jsonl', session_seq) AS file_name FROM {CONVERSATIONS} JOIN n USING (session_hash)""")
def session_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_numbers(conversation_utterances(spark, sf_dir)).select("utterance_id", "session_seq", "i", sessions.session_file(F.col("session_seq")).alias("file_name"))


_GAPS = f"""SELECT user_id, event_id, ts, last_value(CASE WHEN new THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS first_id
FROM (SELECT *, lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > {sessions.GAP_SECONDS * 1_000_000} AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(f"SELECT event_id, 'burst|' || first_id AS session FROM ({_GAPS})")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return sessions.gap_sessions(e, "user_id", "ts", "event_id").select("event_id", "session")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, b, lag(e) OVER (PARTITION BY user_id ORDER BY b, e) AS p FROM (SELECT user_id, event_id, epoch_us(ts) AS b, epoch_us(ts) + CAST(value * 10000000 AS BIGINT) AS e FROM events)) WHERE p > b")
def overlap_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", at.alias("b"), (at + F.rint(F.col("value") * 10000000).cast("long")).alias("e"))
    return sessions.overlaps(e, "user_id", "b", "e").select("user_id", "event_id")


@query()
def span_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept of each turn, some out of order or altered: the code of the first that can't be found in order."""
    c = conversation_utterances(spark, sf_dir)
    lines = F.split("text", " ")
    part = lambda a, n: F.array_join(F.slice(lines, a, n), " ")
    kept = F.when(F.col("turn") % 4 == 0, F.concat_ws("\n", part(1, 2), part(4, 3))).when(F.col("turn") % 4 == 1, F.concat_ws("\n", part(4, 3), part(1, 2))).when(F.col("turn") % 4 == 2, F.concat(part(1, 3), F.lit("¤"))).otherwise("")
    return c.select("utterance_id", F.coalesce(sessions.span_code(kept, F.col("text")), F.lit("ok")).alias("code"))


@query(f"""WITH RECURSIVE w AS (SELECT conv_id, conv_id // 24 AS run, CAST(sum({sql_count_words('text')}) AS BIGINT) AS words, row_number() OVER (PARTITION BY conv_id // 24 ORDER BY conv_id) AS n FROM conversations GROUP BY conv_id),
f(run, n, conv_id, words, batch, k) AS (SELECT run, n, conv_id, words, CAST(0 AS BIGINT), 1 FROM w WHERE n = 1
UNION ALL SELECT w.run, w.n, w.conv_id, CASE WHEN f.words + w.words > 500 OR f.k >= {fixed.MAX_BATCH_SESSIONS} THEN w.words ELSE f.words + w.words END,
f.batch + CASE WHEN f.words + w.words > 500 OR f.k >= {fixed.MAX_BATCH_SESSIONS} THEN 1 ELSE 0 END, CASE WHEN f.words + w.words > 500 OR f.k >= {fixed.MAX_BATCH_SESSIONS} THEN 1 ELSE f.k + 1 END FROM f JOIN w ON w.run = f.run AND w.n = f.n + 1)
SELECT run, conv_id, batch FROM f""")
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations of a day are a run."""
    w = conversation_utterances(spark, sf_dir).groupBy("conv_id").agg(F.sum(text.count_words(F.col("text"))).alias("words")).withColumn("run", F.expr("conv_id div 24"))
    return sessions.pack_batches(w, "run", "conv_id", "words", 500).select("run", "conv_id", "batch")


@query(f"SELECT user_id, event_id, CAST(before AS BIGINT) AS found_before FROM (SELECT user_id, event_id, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 40 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events) WHERE before < {fixed.FOUND_TARGET}")
def stop_on_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", 40).otherwise(0).alias("found"))
    return sessions.stop_on_evidence(e, "user_id", F.col("event_id").desc(), "found").select("user_id", "event_id", "found_before")


@query("SELECT s_suppkey, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) || ' ' || row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal, s_suppkey) AS opaque_label FROM supplier JOIN (SELECT n_nationkey, split_part(n_name, ' ', 1) AS n_name FROM nation) ON s_nationkey = n_nationkey")
def opaque_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.split("n_name", " ")[0].alias("n_name"))
    rows = table(spark, sf_dir, "supplier").join(n, "s_nationkey")
    return sessions.opaque_labels(rows, "n_name", [F.col("s_acctbal"), F.col("s_suppkey")]).select("s_suppkey", "opaque_label")


# --- Counts, digests, estimates ---

_ENGLISH = f"CASE WHEN {sql_reason('text')} = 'latin_script' THEN {sql_count_words('text')} ELSE 0 END"
_COUNTS = f"""SELECT coalesce(modality, 'all') AS modality, CAST(sum(w) AS BIGINT) AS eligible_words, CAST(sum(CASE WHEN a THEN w ELSE 0 END) AS BIGINT) AS analyzed_words, CAST(count(*) AS BIGINT) AS eligible_utterances,
CAST(count(*) FILTER (a) AS BIGINT) AS analyzed_utterances FROM (SELECT modality, {_ENGLISH} AS w, conv_id % 3 <> 0 AS a FROM {CONVERSATIONS} WHERE role = 'user' AND trim(text) <> '') GROUP BY ROLLUP (modality)"""


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.modality_counts(conversation_utterances(spark, sf_dir).where("role = 'user'"), F.col("conv_id") % 3 != 0)


@query(_COUNTS)
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir)


@query("SELECT true AS parts_sum, true AS bounded")
def audit_reconciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.reconciles(_audit(spark, sf_dir))


@query(f"SELECT source AS adapter_id, CAST(count(*) AS BIGINT) AS messages, CAST(min({START} + doc_id) AS BIGINT) AS earliest, CAST(max({START} + doc_id) AS BIGINT) AS latest, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = document_utterances(spark, sf_dir)
    at = F.unix_seconds("ts")
    return d.groupBy(F.col("source_adapter").alias("adapter_id")).agg(F.count("*").alias("messages"), F.min(at).alias("earliest"), F.max(at).alias("latest"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


@query("""WITH v AS (SELECT o_orderpriority AS k, o_totalprice AS x FROM orders), c AS (SELECT k, median(x) AS m FROM v GROUP BY k), o AS (SELECT k, x, abs(x - m) AS d FROM v JOIN c USING (k)), s AS (SELECT k, median(d) AS mad FROM o GROUP BY k), f AS (SELECT k, x, d <= 3 * mad AS ok FROM o JOIN s USING (k))
SELECT k AS o_orderpriority, round(median(x) FILTER (ok), 4) AS p50, round(greatest(median(x) FILTER (ok), quantile_cont(x, 0.9) FILTER (ok)), 4) AS p90, CAST(count(*) FILTER (ok) AS BIGINT) AS records_used, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS records_discarded FROM f GROUP BY k""")
def robust_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counts.robust_center(table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice")
    return out.withColumn("p50", F.round("p50", 4)).withColumn("p90", F.round("p90", 4))


@query("SELECT conv_id, sha256(string_agg(turn || ':' || sha256(text), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def session_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return counts.digest(c, ["conv_id"], ["turn"], F.concat_ws(":", "turn", F.sha2("text", 256)))


@query("""SELECT p_brand, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS dearest, bool_and(p_size > 1) AS all_large FROM part GROUP BY p_brand""")
def argmax_and_all_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("dearest"), F.bool_and(F.col("p_size") > 1).alias("all_large"))


@query("SELECT p_brand, CAST(max(p_size * 1000 + p_partkey % 1000) // 1000 AS VARCHAR) || '.' || CAST(max(p_size * 1000 + p_partkey % 1000) % 1000 AS VARCHAR) AS highest_version FROM part GROUP BY p_brand")
def highest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", F.concat_ws(".", "p_size", F.col("p_partkey") % 1000).alias("v"))
    return counts.highest_version(p, ["p_brand"], "v")


_NOW = START + 400 * 86400
_PRESETS = ", ".join(f"('{n}', {k}, {'NULL' if d is None else d})" for k, (n, d) in enumerate(fixed.PRESETS))
_INSTANCES = f"(SELECT 'nation' || c_nationkey AS adapter_id, c_mktsegment AS instance_key, CASE WHEN min(c_custkey) % 11 = 0 THEN NULL ELSE {START} + min(c_custkey) * 86400 END AS first, {START} + (min(c_custkey) + count(*)) * 86400 AS last, CAST(count(*) * 137 AS BIGINT) AS candidate_words, CAST(count(*) AS BIGINT) AS candidate_messages FROM customer GROUP BY c_nationkey, c_mktsegment)"
_SHARES = f"""SELECT preset, ordinal, adapter_id, first IS NULL AS undated, CAST(round_even(candidate_words * coalesce(f, 1.0), 0) AS BIGINT) AS words, CAST(round_even(candidate_messages * coalesce(f, 1.0), 0) AS BIGINT) AS utterances FROM (
SELECT *, CASE WHEN first IS NULL THEN NULL WHEN first = last THEN CASE WHEN first BETWEEN s AND {_NOW} THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, least(1.0, (least(last, {_NOW}) - greatest(first, s)) / CAST(last - first AS DOUBLE))) END AS f FROM (
SELECT *, CASE WHEN days IS NULL THEN 0 ELSE {_NOW} - days * 86400 END AS s FROM {_INSTANCES}, (VALUES {_PRESETS}) p(preset, ordinal, days)))"""


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.min("c_custkey")
    rows = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("nation"), "c_nationkey").alias("adapter_id"), F.col("c_mktsegment").alias("instance_key")).agg(
        F.when(low % 11 != 0, START + low * 86400).alias("first"), (START + (low + F.count("*")) * 86400).alias("last"), (F.count("*") * 137).alias("candidate_words"), F.count("*").alias("candidate_messages")
    )
    presets = spark.createDataFrame([(n, k, d) for k, (n, d) in enumerate(fixed.PRESETS)], "preset string, ordinal int, days int")
    return counts.preset_counts(rows, presets, F.lit(_NOW))


@query(f"SELECT preset, CAST(sum(words) AS BIGINT) AS words, CAST(sum(utterances) AS BIGINT) AS utterances, CAST(count(*) FILTER (undated) AS BIGINT) AS undated_instances FROM ({_SHARES}) GROUP BY preset")
def preset_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contributions(spark, sf_dir).groupBy("preset").agg(F.sum("words").alias("words"), F.sum("utterances").alias("utterances"), F.count_if("undated").alias("undated_instances"))


@query(f"SELECT preset, adapter_id FROM ({_SHARES}) GROUP BY ALL HAVING NOT bool_or(words > 0 OR utterances > 0)")
def idle_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.idle_sources(_contributions(spark, sf_dir))


@query(f"WITH r AS (SELECT preset, ordinal, sum(words) AS words FROM ({_SHARES}) GROUP BY ALL HAVING sum(words) > 0) SELECT coalesce((SELECT preset FROM r WHERE words >= {2 * fixed.TARGET_WORDS} ORDER BY words, ordinal LIMIT 1), (SELECT preset FROM r ORDER BY words DESC, ordinal DESC LIMIT 1)) AS preset")
def recommended_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.recommend_preset(_contributions(spark, sf_dir).groupBy("preset", "ordinal").agg(F.sum("words").alias("words")))


_CELL = {"judge_authorship": (198, 45.2, 2.0, 22439.0, 26105.5, 1200), "find_mistakes": (250, 21.5, 2.5, 23611.4, 37397.7, 1500), "confirm_confidentiality": (31, 120.0, 1.5, 68090.0, 97244.0, 900)}


def _step_sql(words: str, units: str, cell: str, per_call: int) -> tuple[str, str]:
    """The p50 and p90 of one step as SQL."""
    _, average, per_word, p50, p90, fixed_cost = _CELL[cell]
    base = f"ceil({units} / {per_call}.0) * {fixed_cost}"
    low = f"greatest({base}, ceil({units} * {p50}::DOUBLE + {base} + ({words} - {units} * {average}::DOUBLE) * {per_word}::DOUBLE))"
    high = f"greatest({low}, ceil({units} * {p90}::DOUBLE + {base} + ({words} - {units} * {average}::DOUBLE) * {per_word}::DOUBLE))"
    return f"CASE WHEN {units} = 0 THEN 0 ELSE {low} END", f"CASE WHEN {units} = 0 THEN 0 ELSE {high} END"


_STEP_SQL = (_step_sql("words", "utterances", "judge_authorship", fixed.MESSAGES_PER_SESSION), _step_sql("kept", "analyzed", "find_mistakes", fixed.MESSAGES_PER_SESSION), _step_sql("confirmed", "sessions", "confirm_confidentiality", 1))


@query(f"""WITH p AS (SELECT preset, CAST(sum(words) AS BIGINT) AS words, CAST(sum(utterances) AS BIGINT) AS utterances FROM ({_SHARES}) GROUP BY preset),
u AS (SELECT *, ceil(utterances * {fixed.AUTHORED_UTTERANCE_RETENTION}::DOUBLE) AS analyzed, ceil(utterances / {fixed.MESSAGES_PER_SESSION}.0) AS sessions, round_even(words * {fixed.AUTHORED_WORD_RETENTION}::DOUBLE, 0) AS kept FROM p), s AS (SELECT *, round_even(sessions * {_CELL['confirm_confidentiality'][1]}::DOUBLE, 0) AS confirmed, utterances + analyzed + sessions AS total FROM u)
SELECT preset, words, utterances, CAST({' + '.join(a for a, _ in _STEP_SQL)} AS BIGINT) AS p50_tokens, CAST(ceil(({' + '.join(b for _, b in _STEP_SQL)}) * {fixed.LOW_CONFIDENCE_WIDENING}::DOUBLE) AS BIGINT) AS p90_tokens, 'low' AS confidence,
total * {fixed.SECONDS_PER_UNIT_LOW}::DOUBLE / 60 AS low_minutes, total * {fixed.SECONDS_PER_UNIT_HIGH}::DOUBLE / 60 * {fixed.LOW_CONFIDENCE_WIDENING}::DOUBLE AS high_minutes FROM s""")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and minutes of each preset from three profile cells."""
    per = _contributions(spark, sf_dir).groupBy("preset").agg(F.sum("words").alias("words"), F.sum("utterances").alias("utterances"))
    cell = "struct<messages_measured:bigint,average_words_per_message:double,input_tokens_per_word:double,p50_total_tokens_per_message:double,p90_total_tokens_per_message:double,fixed_input_tokens_per_batch:bigint>"
    cells = spark.createDataFrame([tuple(_CELL.values())], ", ".join(f"{k} {cell}" for k in _CELL))
    return counts.estimate(per, cells)


# --- Sets, lifecycle, checks ---


@query("SELECT n_name FROM ((SELECT n_name FROM nation WHERE n_regionkey = 1 UNION SELECT n_name FROM nation WHERE n_nationkey % 4 = 0) EXCEPT SELECT n_name FROM nation WHERE n_nationkey % 3 = 0)")
def selection_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    chosen = n.where("n_regionkey = 1").union(n.where("n_nationkey % 4 = 0")).select("n_name").distinct()
    return chosen.join(n.where("n_nationkey % 3 = 0"), "n_name", "left_anti")


_RUN_EDGES = ", ".join(f"('{a}', '{b}')" for a, t in fixed.RUN_TRANSITIONS.items() for b in t)
_STATES = "[" + ", ".join(f"'{s}'" for s in fixed.RUN_TRANSITIONS) + "]"


@query(f"SELECT event_id, from_status, to_status FROM (SELECT event_id, {_STATES}[event_id % 10 + 1] AS from_status, {_STATES}[event_id // 10 % 10 + 1] AS to_status FROM events) WHERE (from_status, to_status) NOT IN (VALUES {_RUN_EDGES})")
def transition_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*map(F.lit, fixed.RUN_TRANSITIONS))
    seen = table(spark, sf_dir, "events").select("event_id", states[(F.col("event_id") % 10).cast("int")].alias("from_status"), states[F.expr("cast(event_id div 10 % 10 as int)")].alias("to_status"))
    return counts.illegal_transitions(seen, counts.transitions(spark, fixed.RUN_TRANSITIONS)).select("event_id", "from_status", "to_status")


@query(f"""SELECT c_custkey AS run_id, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 60 > {fixed.RETENTION_DAYS} THEN 'expired' WHEN c_custkey % 7 = 0 THEN 'restart' WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN 'invalidate_downstream' ELSE 'continue' END AS decision,
CASE WHEN c_custkey % 5 = 0 OR c_custkey % 60 > {fixed.RETENTION_DAYS} OR c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'c' WHEN c_custkey % 4 = 0 THEN 'd' END AS earliest_step FROM customer""")
def resume_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    names = [*fixed.RESTART_FIELDS, *(n for n, _ in fixed.DOWNSTREAM_FIELDS)]
    changed = {"tokenizer_version": k % 7 == 0, "prompt_versions": k % 3 == 0, "client_version": k % 4 == 0}
    prints = F.create_map(*[x for n in names for x in (F.lit(n), F.when(changed.get(n, F.lit(False)), "2").otherwise("1"))])
    runs = table(spark, sf_dir, "customer").select(k.alias("run_id"), F.when(k % 5 == 0, "completed").otherwise("checkpointed").alias("status"), (_NOW - k % 60 * 86400).alias("last_checkpoint"), prints.alias("fingerprint"))
    return counts.resume_decision(runs, spark.range(1).select(F.create_map(*[x for n in names for x in (F.lit(n), F.lit("1"))]).alias("fingerprint")), F.lit(_NOW))


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = conversation_utterances(spark, sf_dir)
    source = c.select(F.col("conv_id").alias("session_seq"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("i"), "utterance_id", "source_adapter", "modality", "text")
    k = F.col("session_seq") % 6
    kept = F.when(k == 1, F.lit("")).otherwise(F.col("text"))
    answers = source.where(~((k == 2) & (F.col("i") == 1))).select("session_seq", F.when((k == 3) & (F.col("i") == 1), 999).otherwise(F.col("i")).cast("long").alias("i"), kept.alias("text"))
    return source, answers


@query("""WITH s AS (SELECT conv_id, conv_id % 6 AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
SELECT DISTINCT conv_id AS session_seq, CASE k WHEN 2 THEN 'CARDINALITY_MISMATCH' ELSE 'AUTHORSHIP_UNKNOWN_UTTERANCE' END AS code, CASE k WHEN 3 THEN '999' END AS item_ref FROM s WHERE k IN (2, 3) AND i = 1""")
def decision_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, answers = _judged(spark, sf_dir)
    return judgments.decision_diagnostics(source.select("session_seq", "i", "text"), answers)


@query(f"SELECT conv_id AS session_seq, CAST(count(*) AS BIGINT) AS utterances, CAST(sum(CASE WHEN conv_id % 6 = 1 THEN 0 ELSE {sql_count_words('text')} END) AS BIGINT) AS words FROM conversations WHERE conv_id % 6 NOT IN (2, 3) GROUP BY conv_id")
def corpus_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = judgments.apply_decisions(*_judged(spark, sf_dir))
    return kept.groupBy("session_seq").agg(F.count("*").alias("utterances"), F.sum(text.count_words(F.col("text"))).alias("words"))


def _drafts(source: DataFrame) -> DataFrame:
    n = F.length("text")
    return source.select("session_seq", "i", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.least(n, F.lit(6)).cast("long").alias("end")), F.struct(F.lit(5).cast("long").alias("start"), (F.lit(5) + F.col("i") * 40).cast("long").alias("end")))).alias("x"), F.lit("A comma is missing.").alias("mistake"), F.lit("Put a comma before a quotation.").alias("rule"), F.lit("She said, wait.").alias("example")).select("session_seq", "i", "x.start", "x.end", "mistake", "rule", "example")


@query("""WITH d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, concat_ws(':', 'conversations', conv_id, turn) AS id, text FROM conversations), r AS (SELECT conv_id, id, text, 0 AS b, least(length(text), 6) AS e FROM d UNION ALL SELECT conv_id, id, text, 5, 5 + i * 40 FROM d)
SELECT conv_id AS session_seq, 'SCHEMA_INVALID_VALUE' AS code, id || ':' || b || '-' || e AS item_ref FROM r WHERE e > length(text) OR (e <= length(text) AND NOT regexp_matches(substr(text, CAST(b + 1 AS BIGINT), CAST(e - b AS BIGINT)), '\\S'))
UNION ALL SELECT conv_id, 'CARDINALITY_MISMATCH', id || ':' || b || '-' || e FROM (SELECT *, lag(e) OVER (PARTITION BY id ORDER BY b, e) AS p FROM r) WHERE p > b""")
def record_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, _ = _judged(spark, sf_dir)
    return judgments.record_diagnostics(judgments.mistake_records(source, _drafts(source)), privacy=False)


_FIELDS = ("analyzed_utterances", "analyzed_words", "eligible_utterances", "eligible_words")
_CANONICAL = "'{' || " + " || ',' || ".join(f"'\"{c}\":' || {c}" for c in _FIELDS) + " || ',\"modality\":\"' || modality || '\"}'"


@query(f"SELECT modality, sha256({_CANONICAL}) AS payload_hash FROM ({_COUNTS})")
def package_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical JSON of the audit counts and its SHA-256."""
    row = _audit(spark, sf_dir)
    fields = {c: F.col(c) for c in row.columns}
    return row.select("modality", F.sha2(counts.canonical_json(fields), 256).alias("payload_hash"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit counts of the documents that survive deduplication, by modality and in total."""
    rows = document_utterances(spark, sf_dir)
    kept, _ = dedup.deduplicate(rows, fuzzy=False)
    return counts.modality_counts(rows.join(kept, "utterance_id", "left_semi"), F.lit(True))


def queries() -> dict[str, Query]:
    from . import audits, databases, inventories, raw  # noqa: F401  they register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import audits, databases, inventories, raw  # noqa: F401

    return dict(_SQL)
