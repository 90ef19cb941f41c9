"""Session transcripts in JSON lines: three formats, each as records with an outcome, files with a gate, and utterances.

No line raises: what a format doesn't know is counted, and a file with too much of it is unsupported and gives no utterance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators.dedup import first_of
from . import formats
from .records import VISIBLE, elements, has_key, is_array, is_object, is_true, kind, parsed, present, string, strip

_LEADING_TAG = r"^<([A-Za-z][A-Za-z0-9_-]*)>"


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def sorted_flags(*flags: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(*flags)))


# --- Format A: typed records, one session a file ---


def cleaned(payload: Column) -> Column:
    """struct(outcome, text, flag) of one text after the wrapper rules; outcome: kept, empty, wrapper or unbalanced."""
    rest = F.regexp_replace(payload, r"(?s)<system-reminder>.*?</system-reminder>", "")
    body = strip(rest)
    tag = F.regexp_extract(body, _LEADING_TAG, 1)
    marked = F.ltrim(payload).startswith("<command-name>")
    for m in formats.EXCLUDING_MARKERS:
        marked = marked | payload.contains(m)
    outcome = F.when(marked, "wrapper").when(rest.rlike("</?system-reminder>"), "unbalanced").when(body == "", "empty").when(tag.isin(*formats.WRAPPER_TAGS), "wrapper").otherwise("kept")
    return F.struct(outcome.alias("outcome"), body.alias("text"), F.when(tag != "", F.lit("unknown_wrapper")).alias("flag"))


def typed_records(lines: DataFrame) -> DataFrame:
    """A row for each visible line: outcome (malformed, tail, kept, excluded, unrecognized_user, unknown_type), text, flags and the fields used."""
    v = F.col("v")
    rows = parsed(lines)
    typed = string(v, "$.type")
    content = F.when(kind(v, "$.message.content") == "STRING", F.array(F.variant_get(v, "$.message.content", "string"))).otherwise(
        F.transform(F.filter(elements(v, "$.message.content"), lambda b: string(b, "$.type").eqNullSafe(F.lit("text")) & string(b, "$.text").isNotNull()), lambda b: F.variant_get(b, "$.text", "string"))
    )
    tool_result = F.exists(elements(v, "$.message.content"), lambda b: string(b, "$.type").eqNullSafe(F.lit("tool_result")))
    origin_kind, prompt = string(v, "$.origin.kind"), string(v, "$.promptSource")
    foreign = present(v, "$.origin") & ~origin_kind.eqNullSafe(F.lit("human"))
    client = prompt.isin(*formats.CLIENT_PROMPTS) & string(v, "$.entrypoint").isin(*formats.INTERACTIVE_ENTRYPOINTS)
    scripted = present(v, "$.promptSource") & ~F.coalesce(prompt.isin(*formats.HUMAN_PROMPTS) | client, F.lit(False))
    rows = rows.withColumn("type", typed).withColumn("parts", F.transform(content, cleaned)).withColumn("uuid", string(v, "$.uuid"))
    bad = F.filter("parts", lambda p: p["outcome"].isin("wrapper", "unbalanced"))
    kept = F.filter("parts", lambda p: p["outcome"] == "kept")
    user_ok = is_object(v, "$.message") & string(v, "$.message.role").isNotNull() & ((kind(v, "$.message.content") == "STRING") | is_array(v, "$.message.content")) & F.col("uuid").isNotNull()
    outcome = (
        F.when(F.col("tail"), "tail")
        .when(F.col("malformed") | F.col("type").isNull(), "malformed")
        .when((F.col("type") != "user") & F.col("type").isin(*formats.RECORD_TYPES), "excluded")
        .when(F.col("type") != "user", "unknown_type")
        .when(~F.coalesce(user_ok, F.lit(False)), "unrecognized_user")
        .when(string(v, "$.message.role") != "user", "excluded")
        .when(is_true(v, "$.isMeta") | is_true(v, "$.isSidechain") | is_true(v, "$.isCompactSummary"), "excluded")
        .when(present(v, "$.userType") & ~string(v, "$.userType").eqNullSafe(F.lit("external")), "excluded")
        .when(has_key(v, "$.toolUseResult") | foreign | scripted | tool_result, "excluded")
        .when((F.size(bad) > 0) | (F.size(kept) == 0), "excluded")
        .otherwise("kept")
    )
    whole = F.array_join(F.transform(kept, lambda p: p["text"]), "\n\n")
    rows = rows.withColumn("outcome", outcome).withColumn("text", F.when(outcome == "kept", whole))
    own_flags = sorted_flags(F.when(F.exists(kept, lambda p: p["flag"].isNotNull()), "unknown_wrapper"), F.when(F.length(whole) > fixed.LONG_PASTE_CHARS, "possible_paste"))
    known = F.col("outcome").isin("kept", "excluded")
    legacy = F.col("type").isin(*formats.LEGACY_TYPES) | (is_true(v, "$.isSidechain") & F.col("type").isin("user", "assistant"))
    return rows.select(
        "path", "line_no", "outcome", "text", "uuid",
        F.when(F.col("outcome") == "kept", own_flags).alias("flags"),
        F.coalesce(string(v, "$.sessionId"), string(v, "$.session_id")).alias("session_id"),
        text.iso_timestamp(string(v, "$.timestamp")).alias("ts"),
        string(v, "$.version").alias("app_version"),
        F.when(known & (F.col("type") == "user") & foreign, ~F.coalesce(origin_kind.isin(*formats.ORIGINS), F.lit(False))).when(known & (F.col("type") == "user") & scripted, ~prompt.eqNullSafe(F.lit("system"))).otherwise(False).alias("unknown_origin"),
        ((F.col("outcome") == "excluded") & F.coalesce(F.get(bad, 0)["outcome"] == "unbalanced", F.lit(False))).alias("warning"),
        F.coalesce(legacy, F.lit(False)).alias("legacy"),
        F.coalesce(F.col("type").isin(*formats.CURRENT_TYPES) | has_key(v, "$.origin"), F.lit(False)).alias("current"),
    )


def typed_files(records: DataFrame) -> DataFrame:
    """By file the counts, the storage generation, the last version named and whether it is supported."""
    of = lambda *o: F.count_if(F.col("outcome").isin(*o))
    out = records.groupBy("path").agg(
        F.count("*").alias("non_empty_lines"), of("malformed").alias("malformed_lines"), of("kept", "excluded").alias("known_shape_records"), of("unrecognized_user").alias("unrecognized_user_records"),
        of("kept", "excluded", "unrecognized_user", "unknown_type").alias("parsed_records"), F.bool_or(F.col("outcome") == "tail").alias("truncated_tail"), F.count_if("unknown_origin").alias("unknown_origin_records"),
        F.count_if("warning").alias("structural_warnings"), F.max_by("app_version", F.when(F.col("app_version").isNotNull(), F.col("line_no"))).alias("app_version"), F.bool_or("legacy").alias("legacy"), F.bool_or("current").alias("current"),
        F.min(F.when(F.col("outcome") == "kept", F.col("ts"))).alias("earliest"),
    )
    bad = (F.col("malformed_lines") * 10 > F.col("non_empty_lines")) | ((F.col("parsed_records") > 0) & ((F.col("known_shape_records") == 0) | (F.col("unrecognized_user_records") * 2 > F.col("parsed_records"))))
    generation = F.when(F.col("legacy") & F.col("current"), "mixed").when(F.col("current"), "v2").when(F.col("legacy"), "v1").otherwise("v2")
    return out.withColumn("supported", ~bad).withColumn("generation", F.when(F.col("parsed_records") == 0, "empty").otherwise(generation)).drop("legacy", "current")


def text_hash(x: Column) -> Column:
    """Equal for texts that are equal after canonical composition and without white space around them."""
    return F.sha2(text.nfc(strip(x)), 256)


def typed_utterances(lines: DataFrame) -> DataFrame:
    """Utterances of supported files: the first of a uuid in its file, then the first copy of (uuid, text) over all files."""
    records = typed_records(lines)
    gate = typed_files(records).where("supported").select("path", "truncated_tail", "earliest")
    kept = records.where("outcome = 'kept'").join(gate, "path").withColumn("text_sha256", text_hash(F.col("text")))
    once = first_of(kept, ["path", "uuid"], [F.col("line_no")])
    last = F.max("line_no").over(Window.partitionBy("path"))
    flags = F.concat("flags", F.array_compact(F.array(F.when(F.col("session_id") != stem(F.col("path")), F.lit("session_id_mismatch")), F.when(F.col("truncated_tail") & (F.col("line_no") == last), F.lit("truncated_tail_dropped")))))
    once = once.withColumn("flags", flags)
    return first_of(once, ["uuid", "text_sha256"], [F.col("earliest").isNull(), F.coalesce(F.col("earliest"), F.lit("9999-12-31").cast("timestamp")), F.col("path"), F.col("line_no")]).select("path", "line_no", "uuid", "text", "text_sha256", "ts", "flags", stem(F.col("path")).alias("session_id"))


# --- Format B: dated rollouts with a header and two channels ---


def injected(x: Column) -> Column:
    body = strip(x)
    found = F.substring(body, 1, 200).contains("<environment_context>") | (strip(F.regexp_extract(body, r"^[^\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]*", 0)) == "# AGENTS")
    for p in formats.INJECTION_PREFIXES:
        found = found | body.startswith(p)
    return found


def rollout_lines(lines: DataFrame) -> DataFrame:
    v = F.col("v")
    meta = string(v, "$.type").eqNullSafe(F.lit("session_meta")) & is_object(v, "$.payload")
    ptype = string(v, "$.payload.type")
    joined = F.array_join(F.transform(F.filter(elements(v, "$.payload.content"), lambda p: string(p, "$.type").eqNullSafe(F.lit("input_text")) & string(p, "$.text").isNotNull()), lambda p: F.variant_get(p, "$.text", "string")), "")
    a = is_object(v, "$.payload") & string(v, "$.type").eqNullSafe(F.lit("event_msg")) & ptype.eqNullSafe(F.lit("user_message"))
    b = string(v, "$.type").eqNullSafe(F.lit("response_item")) & ptype.eqNullSafe(F.lit("message")) & string(v, "$.payload.role").eqNullSafe(F.lit("user")) & (joined != "")
    deep = lambda p: F.to_json(F.variant_get(v, p, "variant")).rlike(r'(?<!\\)"subagent"\s*:') & (is_object(v, p) | is_array(v, p))
    delegated = present(v, "$.payload.parent_thread_id") | F.coalesce(deep("$.payload.source"), F.lit(False)) | F.coalesce(deep("$.payload.thread_source"), F.lit(False))
    for k in formats.SUBAGENT_KEYS:
        delegated = delegated | present(v, f"$.payload.{k}")
    rows = parsed(lines)
    return rows.select(
        "path", "line_no", "tail", "malformed", "v", meta.alias("meta"),
        is_object(v, "$").alias("object"),
        F.when(a, "A").when(b, "B").alias("channel"),
        F.when(a, string(v, "$.payload.message")).when(b, joined).alias("text"),
        string(v, "$.payload.kind").alias("kind"), present(v, "$.payload.kind").alias("has_kind"),
        text.iso_timestamp(string(v, "$.timestamp")).alias("ts"),
        (meta & delegated).alias("delegated"),
        (meta & present(v, "$.payload.history_mode") & ~F.coalesce(string(v, "$.payload.history_mode").isin(*formats.HISTORY_MODES), F.lit(False))).alias("odd_mode"),
        (meta & present(v, "$.payload.forked_from_id")).alias("forked"),
        F.when(meta, string(v, "$.payload.cli_version")).alias("version"),
    )


def rollout_files(rows: DataFrame) -> DataFrame:
    """By file: status, generation, session id, eligibility, channel. ``rows`` is of ``rollout_lines``."""
    v = F.col("first.v")
    out = rows.groupBy("path").agg(
        F.min_by(F.struct("v", "meta", "object"), "line_no").alias("first"), F.min_by("v", F.when(F.col("meta"), F.col("line_no"))).alias("head"), F.bool_or("malformed").alias("any_malformed"), F.bool_or("tail").alias("truncated_tail"),
        F.count("*").alias("n"), F.bool_or("odd_mode").alias("odd_mode"), F.bool_or("delegated").alias("delegated"), F.bool_or("forked").alias("forked"), F.count_if(F.col("channel") == "A").alias("n_a"), F.count_if(F.col("channel") == "B").alias("n_b"),
        F.array_sort(F.collect_set("version")).alias("cli_versions"),
    )
    named = F.regexp_extract("path", r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})\.jsonl$", 1)
    own, from_name = F.nullif(string(F.col("head"), "$.payload.id"), F.lit("")), F.nullif(named, F.lit(""))
    out = out.withColumn("session_id", F.coalesce(from_name, own)).withColumn("session_id_mismatch", F.coalesce(own != from_name, F.lit(False)))
    bare = has_key(v, "$.record_type") | (~has_key(v, "$.payload") & has_key(v, "$.id"))
    status = (
        F.when(v.isNull() & (F.col("n") == 1), "empty").when(v.isNull(), "malformed").when(~F.col("first.object"), "unsupported").when(F.col("any_malformed"), "malformed")
        .when(~F.col("first.meta") | F.col("odd_mode") | F.col("session_id").isNull(), "unsupported").otherwise("supported")
    )
    paginated = string(F.col("head"), "$.payload.history_mode").eqNullSafe(F.lit("paginated"))
    generation = (
        F.when(status == "empty", "empty").when(status == "malformed", "malformed").when(~F.col("first.object"), "unknown").when(~F.col("first.meta") & bare, "bare-items").when(~F.col("first.meta"), "unknown")
        .when(F.col("odd_mode"), "unknown-history-mode").when(F.col("session_id").isNull(), "missing-session-id").when(F.col("n_a") > 0, "legacy-events").when((F.col("n_b") > 0) & paginated, "paginated").when(F.col("n_b") > 0, "response-items").otherwise("meta-only")
    )
    channel = F.when(F.col("n_a") > 0, "A").when(F.col("n_b") > 0, "B")
    meta_ts = text.iso_timestamp(string(F.col("head"), "$.payload.timestamp"))
    return out.select("path", status.alias("status"), generation.alias("generation"), "session_id", "session_id_mismatch", (~F.col("delegated")).alias("eligible"), "forked", "truncated_tail", channel.alias("file_channel"), F.when(channel == "A", F.col("n_a")).otherwise(F.col("n_b")).alias("pre_filter_count"), "cli_versions", meta_ts.alias("meta_ts"))


def rollout_utterances(lines: DataFrame) -> DataFrame:
    """Utterances of the supported, eligible files, from channel A where a file has it, with the confidence of the channel."""
    rows = rollout_lines(lines)
    gate = rollout_files(rows).where("status = 'supported' and eligible").select("path", "session_id", "file_channel", "meta_ts", "forked")
    found = rows.drop("forked").join(gate, "path").where("channel = file_channel").where(F.col("text").isNotNull() & F.col("text").rlike(VISIBLE))
    found = found.where((F.col("channel") == "B") | ~F.col("has_kind") | F.col("kind").eqNullSafe(F.lit("plain"))).where(~injected(F.col("text")))
    confidence = F.when(F.col("channel") == "B", 0.85).when(F.col("has_kind"), 0.95).otherwise(0.9)
    return found.select("path", "line_no", "session_id", "channel", "text", F.coalesce("ts", "meta_ts").alias("ts"), confidence.alias("confidence"), "forked")


# --- Format C: chat logs with updates, or one document ---


def _parts(v: Column, path: str) -> Column:
    """A string, an object or a list of both, as a list of variants; null if it is anything else."""
    one = F.array(F.variant_get(v, path, "variant"))
    every = elements(v, path)
    plain = F.forall(every, lambda p: (kind(p, "$") == "STRING") | is_object(p, "$"))
    return F.when((kind(v, path) == "STRING") | is_object(v, path), one).when(is_array(v, path) & plain, every)


def _item(part: Column) -> Column:
    """The text of a part: null for media, thoughts and unknown parts."""
    thought = has_key(part, "$.thought") & ~F.to_json(F.variant_get(part, "$.thought", "variant")).isin("false", "null", "0", '""', "[]", "{}")
    return F.when(kind(part, "$") == "STRING", F.variant_get(part, "$", "string")).when(F.coalesce(thought, F.lit(False)), F.lit(None)).otherwise(string(part, "$.text"))


def _unknown_part(part: Column) -> Column:
    media = F.lit(False)
    for k in formats.MEDIA_KEYS:
        media = media | has_key(part, f"$.{k}")
    thought = has_key(part, "$.thought") & ~F.to_json(F.variant_get(part, "$.thought", "variant")).isin("false", "null", "0", '""', "[]", "{}")
    return is_object(part, "$") & ~F.coalesce(thought, F.lit(False)) & string(part, "$.text").isNull() & ~media


def _marker(item: Column) -> Column:
    """The number, from 1, of the first line that opens an expansion of references; 0 if there is none."""
    return F.array_position(F.transform(F.split(item, "\n", -1), lambda x: strip(x).rlike(r"(?i)^-{2,}.*(?:referenced files|content from)")), F.lit(True)).cast("int")


def starts_injected(x: Column) -> Column:
    tag = F.regexp_extract(x, _LEADING_TAG, 1)
    return x.startswith("/") | x.startswith("!") | x.startswith("<session_context>") | x.startswith(formats.ENVIRONMENT_SENTENCE) | tag.isin(*formats.CHAT_WRAPPER_TAGS)


def _holds(path: str):
    return lambda part: has_key(part, path)


def with_message(rows: DataFrame) -> DataFrame:
    """``rows`` with outcome, text and flags of the chat message ``v``; each step is a column of its own, so that it is computed once."""
    v, c = F.col("v"), F.col
    tool = F.lit(False)
    for path in [f"$.{k}" for k in formats.TOOL_KEYS]:
        tool = tool | F.exists("_content", _holds(path))
    rows = rows.withColumns({"_type": string(v, "$.type"), "_id": string(v, "$.id"), "_content": _parts(v, "$.content"), "_display": _parts(v, "$.displayContent"), "_displayed": has_key(v, "$.displayContent")})
    rows = rows.withColumns({"_tool": tool, "_shown": c("_display").isNotNull(), "_source": F.coalesce("_display", "_content")})
    rows = rows.withColumns({"_items": F.filter(F.transform("_source", _item), lambda x: x.isNotNull()), "_odd": F.exists("_source", _unknown_part)})
    rows = rows.withColumn("_markers", F.transform("_items", _marker))
    rows = rows.withColumn("_hit", F.array_position(F.transform("_markers", lambda x: x > 0), F.lit(True)).cast("int"))
    rows = rows.withColumns({"_trimmed": ~c("_shown") & (c("_hit") > 0), "_at": F.get("_markers", c("_hit") - 1)})
    head = F.array_join(F.slice(F.split(F.get("_items", c("_hit") - 1), "\n", -1), F.lit(1), F.greatest(c("_at") - 1, F.lit(0))), "\n")
    cut = F.concat(F.slice("_items", F.lit(1), F.greatest(c("_hit") - 1, F.lit(0))), F.when(c("_at") > 1, F.array(head)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_used", F.transform(F.when(c("_trimmed"), cut).otherwise(c("_items")), strip))
    rows = rows.withColumn("_body", F.coalesce(strip(F.array_join(F.filter("_used", lambda x: x != ""), "\n")), F.lit("")))
    rows = rows.withColumn("_tag", F.regexp_extract("_body", _LEADING_TAG, 1))
    body = c("_body")
    injected_start = body.startswith("/") | body.startswith("!") | body.startswith("<session_context>") | body.startswith(formats.ENVIRONMENT_SENTENCE) | c("_tag").isin(*formats.CHAT_WRAPPER_TAGS)
    outcome = (
        F.when(~F.coalesce(c("_type").isin(*formats.MESSAGE_TYPES), F.lit(False)), "unknown_type").when(c("_type") != "user", "excluded").when(c("_id").isNull() | c("_content").isNull(), "unrecognized_user")
        .when(c("_tool") | (body == "") | injected_start, "excluded").otherwise("kept")
    )
    flags = sorted_flags(
        F.when(c("_odd") | (c("_displayed") & ~c("_shown")), F.lit("unknown_part")), F.when(c("_shown"), F.lit("expanded_content_present")), F.when(c("_trimmed"), F.lit("reference_expansion_trimmed")),
        F.when(~c("_shown") & ~c("_trimmed") & (F.size("_items") > 1), F.lit("multipart_no_display")), F.when(c("_tag") != "", F.lit("unknown_wrapper")),
    )
    rows = rows.withColumn("outcome", outcome).withColumns({"text": F.when(c("outcome") == "kept", body), "flags": F.when(c("outcome") == "kept", flags), "message_id": c("_id")})
    return rows.drop(*[x for x in rows.columns if x.startswith("_")])


def chat_lines(lines: DataFrame) -> DataFrame:
    """Lines of a chat log with their kind: rewind, set_update, message, metadata or unknown, in this order of tests."""
    v = F.col("v")
    what = (
        F.when(v.isNull(), None).when(string(v, "$['$rewindTo']").isNotNull(), "rewind").when(is_object(v, "$['$set']"), "set_update").when(string(v, "$.id").isNotNull(), "message")
        .when(string(v, "$.sessionId").isNotNull() & string(v, "$.projectHash").isNotNull(), "metadata").otherwise("unknown")
    )
    return parsed(lines).withColumn("line_kind", what)


def chat_documents(found: DataFrame, most: int = formats.CHAT_DOCUMENT_BYTES) -> DataFrame:
    """Messages of chats that are one JSON document, in the shape of ``chat_lines``; documents over ``most`` bytes are left out."""
    v = F.col("v")
    rows = found.where(F.col("file_size") <= most).withColumn("v", F.try_parse_json("value")).where(string(v, "$.sessionId").isNotNull() & is_array(v, "$.messages"))
    head = F.array(F.struct(F.lit(-1).alias("line_no"), F.lit("metadata").alias("line_kind"), v.alias("v")))
    own = F.transform(elements(v, "$.messages"), lambda m, i: F.struct(i.alias("line_no"), F.when(is_object(m, "$"), "message").otherwise("unknown").alias("line_kind"), m.alias("v")))
    return rows.select("path", F.explode(F.concat(head, own)).alias("x")).select("path", "x.*", F.lit(False).alias("tail"), F.lit(False).alias("malformed"))


def chat_files(rows: DataFrame) -> DataFrame:
    """By file: identity, whether it is a sub-agent's, and the gate. ``rows`` is of ``chat_lines`` or ``chat_documents``."""
    v, k = F.col("v"), F.col("line_kind")
    typed = string(v, "$.type")
    named = lambda p: F.coalesce(string(v, p) == "subagent", F.lit(False))
    sub = ((k == "metadata") & named("$.kind")) | ((k == "set_update") & named("$['$set'].kind"))
    set_id = F.when(k == "set_update", string(v, "$['$set'].sessionId"))
    out = rows.groupBy("path").agg(
        F.count("*").alias("non_empty_lines"), F.count_if("malformed").alias("malformed_lines"), F.bool_or("tail").alias("truncated_tail"), F.count_if(k.isin("rewind", "set_update", "message", "metadata")).alias("known_kind_lines"), F.count_if(k == "unknown").alias("skipped_unknown_lines"),
        F.count_if(k == "message").alias("message_records"), F.count_if((k == "message") & ~F.coalesce(typed.isin(*formats.MESSAGE_TYPES), F.lit(False))).alias("unknown_message_types"), F.coalesce(F.bool_or(sub), F.lit(False)).alias("subagent"),
        F.max_by(set_id, F.when(set_id.isNotNull(), F.col("line_no"))).alias("set_id"), F.min_by(string(v, "$.sessionId"), F.when(k == "metadata", F.col("line_no"))).alias("meta_id"), F.min_by(text.iso_timestamp(string(v, "$.startTime")), F.when(k == "metadata", F.col("line_no"))).alias("start_time"),
        F.bool_or((k == "message") & has_key(v, "$.displayContent")).alias("has_display"),
    )
    bad = (F.col("malformed_lines") * 10 > F.col("non_empty_lines")) | ((F.col("skipped_unknown_lines") > 0) & (F.col("known_kind_lines") == 0)) | (F.col("unknown_message_types") * 2 > F.col("message_records"))
    return out.withColumn("supported", ~bad).withColumn("session_id", F.coalesce("set_id", "meta_id", F.when(F.col("message_records") > 0, stem(F.col("path"))))).drop("set_id", "meta_id")


def chat_utterances(rows: DataFrame) -> DataFrame:
    """Kept messages: of a repeated id the last one, of several files of a session one (logs of lines first, then by name)."""
    gate = chat_files(rows).where("supported and session_id is not null").select("path", "session_id", "subagent")
    chosen = first_of(gate, ["session_id"], [~F.endswith("path", F.lit(".jsonl")), F.col("path")]).where("not subagent")
    messages = with_message(rows.where("line_kind = 'message'").join(chosen, "path").select("path", "session_id", "line_no", "v")).withColumn("ts", text.iso_timestamp(string(F.col("v"), "$.timestamp")))
    # No filter above the columns: it would be pushed below them with all their expressions written out.
    known = F.when(F.col("outcome").isin("kept", "excluded"), F.col("line_no"))
    latest = messages.groupBy("path", "message_id").agg(F.max_by(F.struct("session_id", "ts", "outcome", "text", "flags"), known).alias("m"), F.min(known).alias("position"))
    return latest.select("path", "position", "message_id", "m.*").where("outcome = 'kept'").drop("outcome")
