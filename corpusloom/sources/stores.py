"""SQLite stores and JSON trees.

A store file is read by Spark as bytes and opened in memory inside a task, one file a task, read-only and by an allow-list of columns, so any
file system works and nothing is copied to a disk. A store that can't be read gives a diagnostic row instead of an exception.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.dedup import first_of
from . import formats, records
from .records import VISIBLE, elements, is_array, is_object, is_true, kind, present, string, strip

#: The most that one row of Spark's binary reader can hold.
MOST_STORE_BYTES = (1 << 31) - 1 - 1024
_KINDS = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}


def with_log(content: bytes, log: bytes) -> bytes:
    """A store's pages with the committed frames of its write-ahead log.

    Frames count while their salts are those of the log's header and the running checksum holds, up to the last one that ends a transaction.
    """
    if len(log) < 32 or int.from_bytes(log[:4]) & ~1 != 0x377F0682:
        return content
    order = ">u4" if log[3] & 1 else "<u4"
    size = int.from_bytes(log[8:12])
    if size < 512:
        return content

    def summed(data: bytes, a: int, b: int) -> tuple[int, int]:
        words = np.frombuffer(data, order).tolist()
        for x, y in zip(words[::2], words[1::2], strict=True):
            a = (a + x + b) & 0xFFFFFFFF
            b = (b + y + a) & 0xFFFFFFFF
        return a, b

    a, b = summed(log[:24], 0, 0)
    pages, pending, total = {}, {}, 0
    if (a, b) == (int.from_bytes(log[24:28]), int.from_bytes(log[28:32])):
        for at in range(32, len(log) - size - 23, size + 24):
            head, page = log[at : at + 24], log[at + 24 : at + 24 + size]
            a, b = summed(head[:8] + page, a, b)
            if head[8:16] != log[16:24] or (a, b) != (int.from_bytes(head[16:20]), int.from_bytes(head[20:24])):
                break
            pending[int.from_bytes(head[:4])] = page
            if committed := int.from_bytes(head[4:8]):
                pages |= pending
                pending, total = {}, committed
    if not pages:
        return content
    out = bytearray(content[: total * size].ljust(total * size, b"\0"))
    for number, page in pages.items():
        if number <= total:
            out[(number - 1) * size : number * size] = page
    return bytes(out)


def _open(content: bytes, log: bytes | None = None) -> sqlite3.Connection:
    """The store in memory, read-only. A store in write-ahead mode is opened with its log, as a store in the plain mode."""
    if log:
        content = with_log(content, log)
    if content[18:20] == b"\x02\x02":
        content = content[:18] + b"\x01\x01" + content[20:]
    con = sqlite3.connect(":memory:")
    con.deserialize(content)
    con.execute("PRAGMA query_only = ON")
    return con


def _each(batch: pa.RecordBatch) -> Iterator[tuple]:
    """path, content and log of each store of a batch; the bytes of one at a time."""
    for row in zip(*(batch.column(c) for c in ("path", "content", "log")), strict=True):
        yield tuple(x.as_py() for x in row)


def store_files(spark: SparkSession, path: str, pattern: str = "*.db", most: int = MOST_STORE_BYTES) -> DataFrame:
    """path, content, log: the stores, and the write-ahead logs beside those in that mode. Stores over ``most`` bytes are left out; ``oversize`` reports them."""
    read = lambda glob: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).where(F.col("length") <= most)
    found = read(pattern).select("path", "content")
    logs = read(f"{pattern}-wal").select(F.regexp_replace("path", "-wal$", "").alias("path"), F.col("content").alias("log"))
    ahead = F.substring("content", 19, 1) == F.lit(b"\x02")
    # Only stores in that mode meet the logs.
    return found.where(~F.coalesce(ahead, F.lit(False))).withColumn("log", F.lit(None).cast("binary")).unionByName(found.where(ahead).join(logs, "path", "left"))


def oversize(spark: SparkSession, path: str, pattern: str = "*.db", most: int = MOST_STORE_BYTES) -> DataFrame:
    """Diagnostics of the stores that ``store_files`` leaves out, and of those whose log it does."""
    return records.oversize(spark, path, pattern, most).unionByName(records.oversize(spark, path, f"{pattern}-wal", most))


def structure(stores: DataFrame) -> DataFrame:
    """(path, tbl, col) of every column of every table; a store that can't be read gives (path, null, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, log in _each(batch):
                try:
                    con = _open(content, log)
                    tables = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]
                    rows = [(path, t, r[1]) for t in tables for r in con.execute(f'PRAGMA table_info("{t.replace(chr(34), chr(34) * 2)}")')]
                except sqlite3.Error:
                    rows = [(path, None, None)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["path", "tbl", "col"])

    return stores.mapInArrow(run, "path string, tbl string, col string")


def unsupported(found: DataFrame, required: dict[str, tuple[str, ...]]) -> DataFrame:
    """Diagnostics (code, item_ref) of stores that can't be read or lack a required column. ``found`` is of ``structure``; names are compared in lower case."""
    have = found.groupBy("path").agg(F.collect_set(F.lower(F.concat_ws(".", "tbl", "col"))).alias("have"), F.bool_or(F.col("tbl").isNull()).alias("broken"))
    wanted = F.array(*[F.lit(f"{t}.{c}".lower()) for t, columns in required.items() for c in columns])
    code = F.when(F.col("broken"), "SOURCE_INACCESSIBLE").when(F.size(F.array_except(wanted, "have")) > 0, "SOURCE_UNSUPPORTED_SCHEMA")
    return have.select(code.alias("code"), F.col("path").alias("item_ref")).where("code is not null")


def read_table(stores: DataFrame, table: str, columns: dict[str, str], where: str = "") -> DataFrame:
    """Rows (path, columns...) of one table; ``columns``: name -> string, double or long, and a value of another type is null.

    Columns that a store lacks are null there; other columns are never read. ``where`` is a fixed condition of the caller's, such as a range of keys.
    """
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = {"string": lambda x: isinstance(x, str), "double": lambda x: isinstance(x, (int, float)), "long": lambda x: isinstance(x, int)}
        for batch in batches:
            for path, content, log in _each(batch):
                try:
                    con = _open(content, log)
                    own = {r[1].lower(): r[1] for r in con.execute(f'PRAGMA table_info("{table}")')}
                    if not own:
                        continue
                    picked = ", ".join(f'"{own[n.lower()]}"' if n.lower() in own else "NULL" for n in names)
                    cursor = con.execute(f'SELECT {picked} FROM "{table}"' + (f" WHERE {where}" if where else ""))
                    while rows := cursor.fetchmany(5000):
                        values = [[x.decode("utf-8", "replace") if columns[n] == "string" and isinstance(x, bytes) else x for x in c] for n, c in zip(names, zip(*rows, strict=True), strict=True)]
                        arrays = [pa.array([x if good[columns[n]](x) else None for x in c], _KINDS[columns[n]]) for n, c in zip(names, values, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *arrays], names=["path", *names])
                except sqlite3.Error:
                    continue  # `structure` reports it

    return stores.mapInArrow(run, "path string, " + ", ".join(f"{n} {t}" for n, t in columns.items()))


# --- Messages in parts: sessions, messages, parts ---

GENERATIONS = ("sqlite", "json-j2", "json-j1")
PART_STORE = {"session": ("id", "project_id", "parent_id", "time_created"), "message": ("id", "session_id", "time_created", "data"), "part": ("id", "message_id", "session_id", "data")}


def positive_ms(x: Column) -> Column:
    """A time from milliseconds; null at zero and below."""
    return F.when(x > 0, F.timestamp_micros((x * 1000).cast("long")))


def joined_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """By message the text of its own visible text parts, in the order of their ids, with a blank line between. ``parts``: keys, part_id, v."""
    v = F.col("v")
    own = parts.where(string(v, "$.type").eqNullSafe(F.lit("text")) & ~is_true(v, "$.synthetic") & ~is_true(v, "$.ignored")).withColumn("t", strip(string(v, "$.text"))).where("t <> ''")
    listed = F.array_sort(F.collect_list(F.struct("part_id", "t")))
    return own.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias("text"), F.transform(listed, lambda x: x["part_id"]).alias("part_ids"))


def part_store_messages(stores: DataFrame) -> DataFrame:
    """Messages of SQLite stores with session, project, parent, role, time and joined text."""
    odd = unsupported(structure(stores), PART_STORE).select(F.col("item_ref").alias("path"))
    sound = stores.join(odd, "path", "left_anti")
    sessions = read_table(sound, "session", {"id": "string", "project_id": "string", "parent_id": "string", "time_created": "double", "version": "string"}).where("id <> '' and project_id <> ''")
    messages = read_table(sound, "message", {"id": "string", "session_id": "string", "time_created": "double", "data": "string"}).where("id <> '' and session_id <> ''").withColumn("v", F.try_parse_json("data"))
    parts = read_table(sound, "part", {"id": "string", "message_id": "string", "data": "string"}).where("id <> '' and message_id <> ''").select("path", "message_id", F.col("id").alias("part_id"), F.try_parse_json("data").alias("v"))
    v = F.col("v")
    created = F.when(kind(v, "$.time.created").isin("BIGINT", "DOUBLE") | F.startswith(kind(v, "$.time.created"), F.lit("DECIMAL")), F.variant_get(v, "$.time.created", "double"))
    rows = messages.where(is_object(v, "$")).select("path", "session_id", F.col("id").alias("message_id"), F.nullif(string(v, "$.role"), F.lit("")).alias("role"), F.coalesce(positive_ms(created), positive_ms(F.col("time_created"))).alias("ts")).where("role is not null")
    named = sessions.select("path", F.col("id").alias("session_id"), F.col("project_id").alias("project_key"), F.nullif("parent_id", F.lit("")).alias("parent_id"), "version")
    return rows.join(named, ["path", "session_id"]).join(joined_parts(parts, ["path", "message_id"]), ["path", "message_id"], "left").withColumn("generation", F.lit("sqlite"))


def part_tree_messages(found: DataFrame) -> DataFrame:
    """The same from a tree of JSON documents ``session/<project>/<id>.json``, ``message/<session>/<id>.json``, ``part/<message>/<id>.json``."""
    v = F.col("v")
    docs = found.select(F.regexp_extract("path", r"/(session|message|part)/([^/]+)/([^/]+)\.json$", 1).alias("what"), F.regexp_extract("path", r"/(session|message|part)/([^/]+)/([^/]+)\.json$", 2).alias("owner"), F.regexp_extract("path", r"^(.*)/(?:session|message|part)/[^/]+/[^/]+\.json$", 1).alias("path"), F.try_parse_json("value").alias("v"))
    docs = docs.where(is_object(v, "$"))
    sessions = docs.where("what = 'session'").select("path", string(v, "$.id").alias("session_id"), F.coalesce(string(v, "$.projectID"), F.col("owner")).alias("project_key"), F.nullif(string(v, "$.parentID"), F.lit("")).alias("parent_id"), string(v, "$.version").alias("version"))
    created = F.try_variant_get(v, "$.time.created", "double")
    messages = docs.where("what = 'message'").select("path", F.coalesce(string(v, "$.sessionID"), F.col("owner")).alias("session_id"), string(v, "$.id").alias("message_id"), F.nullif(string(v, "$.role"), F.lit("")).alias("role"), positive_ms(created).alias("ts")).where("role is not null and message_id is not null")
    parts = docs.where("what = 'part'").select("path", F.coalesce(string(v, "$.messageID"), F.col("owner")).alias("message_id"), string(v, "$.id").alias("part_id"), "v")
    return messages.join(sessions, ["path", "session_id"]).join(joined_parts(parts, ["path", "message_id"]), ["path", "message_id"], "left").withColumn("generation", F.lit("json-j2"))


def part_project_messages(found: DataFrame) -> DataFrame:
    """The same from the oldest trees ``project/<slug>/storage/session/{info,message/<session>,part/<session>/<message>}/*.json``.

    A message's parts are its files of parts if it has any, else those inside it; a message with neither is left out.
    """
    v, at = F.col("v"), lambda i: F.regexp_extract("path", r"^(.*)/project/([^/]+)/storage/session/(info|message|part)/(.*)\.json$", i)
    docs = found.select(at(1).alias("root"), at(2).alias("slug"), at(3).alias("what"), F.split(at(4), "/").alias("names"), F.try_parse_json("value").alias("v")).where(is_object(v, "$"))
    name = F.element_at("names", -1)
    ident, role = F.nullif(string(v, "$.id"), F.lit("")), F.nullif(string(v, "$.role"), F.lit(""))
    created = positive_ms(F.try_variant_get(v, "$.time.created", "double"))
    sessions = docs.where((F.col("what") == "info") & name.startswith("ses_") & ident.startswith("ses_")).select("root", "slug", ident.alias("session_id"), F.nullif(string(v, "$.parentID"), F.lit("")).alias("parent_id"), string(v, "$.version").alias("version"))
    messages = docs.where((F.col("what") == "message") & name.startswith("msg_")).select("root", "slug", F.coalesce(F.nullif(string(v, "$.sessionID"), F.lit("")), F.col("names")[0]).alias("session_id"), ident.alias("message_id"), role.alias("role"), created.alias("ts"), "v").where("message_id is not null and role is not null")
    split = docs.where((F.col("what") == "part") & name.startswith("prt_")).select("root", "slug", F.col("names")[0].alias("session_id"), F.col("names")[1].alias("message_id"), F.coalesce(ident, name).alias("part_id"), "v")
    keys = ["root", "slug", "session_id", "message_id"]
    with_files = split.select(*keys).distinct().withColumn("split", F.lit(True))
    rows = messages.join(with_files, keys, "left").where(F.col("split") | is_array(v, "$.parts"))
    inline = rows.where("split is null").select(*keys, F.posexplode(elements(v, "$.parts")).alias("n", "v")).where(is_object(v, "$")).select(*keys, F.coalesce(F.nullif(string(v, "$.id"), F.lit("")), F.format_string("%s-inline-%03d", "message_id", "n")).alias("part_id"), "v")
    parts = joined_parts(split.unionByName(inline), keys)
    out = rows.drop("v", "split").join(sessions, ["root", "slug", "session_id"]).join(parts, keys, "left")
    return out.select(F.concat_ws("/project/", "root", "slug").alias("path"), "session_id", "message_id", "role", "ts", F.col("slug").alias("project_key"), "parent_id", "version", "text", "part_ids", F.lit("json-j1").alias("generation"))


def canonical_counts(messages: DataFrame) -> DataFrame:
    """By project over the canonical copies (``coalesced``): records of any role, the versions that wrote them, and their range."""
    out = coalesced(messages).where("project_key is not null").groupBy("project_key").agg(F.count("*").alias("records"), F.array_sort(F.collect_set("version")).alias("versions"))
    few = F.when(F.size("versions") == 1, F.col("versions")[0]).when(F.size("versions") > 1, F.concat_ws("-", F.col("versions")[0], F.element_at("versions", -1)))
    return out.withColumn("version_range", few)


def instance_key(root: Column, project: Column) -> Column:
    """One key for each root and project."""
    return F.sha2(F.concat(root, F.lit("\0"), project), 256)


def tree_gate(found: DataFrame) -> DataFrame:
    """Diagnostics of trees of which over a tenth of the files are no JSON objects."""
    root = F.regexp_extract("path", r"^(.*)/(?:session|message|part)/[^/]+/[^/]+\.json$", 1)
    per = found.withColumn("v", F.try_parse_json("value")).groupBy(root.alias("item_ref")).agg(F.count("*").alias("n"), F.count_if(~is_object(F.col("v"), "$")).alias("bad"))
    return per.where("bad * 10 > n").select(F.lit("SOURCE_UNSUPPORTED_SCHEMA").alias("code"), "item_ref")


def coalesced(messages: DataFrame) -> DataFrame:
    """One copy of each (session, message) over generations: SQLite before trees, newer trees before older ones; ``generation_text_mismatch`` if copies have other texts."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, GENERATIONS)), F.col("generation")), F.lit(0))
    best = first_of(messages, ["session_id", "message_id"], [F.coalesce("text", F.lit("")) == "", rank, F.col("path")])
    texts = messages.where("text is not null").groupBy("session_id", "message_id").agg((F.count_distinct("text") > 1).alias("generation_text_mismatch"))
    return best.join(texts, ["session_id", "message_id"], "left").withColumn("generation_text_mismatch", F.coalesce("generation_text_mismatch", F.lit(False)))


def part_utterances(messages: DataFrame) -> DataFrame:
    """The user's own messages of top-level sessions, without the vendor's templates."""
    return coalesced(messages).where((F.col("role") == "user") & F.col("parent_id").isNull() & F.col("text").isNotNull() & ~F.col("text").isin(*formats.TEMPLATE_TEXTS)).select("session_id", "message_id", "project_key", "text", "ts", "part_ids", "generation", "generation_text_mismatch")


# --- Dictation history ---


def dictation_rows(stores: DataFrame) -> DataFrame:
    """The History table by its allow-list, with ``anomaly``: an id that is blank or not unique in its store."""
    rows = read_table(stores, "History", {"transcriptEntityId": "string", "asrText": "string", "timestamp": "string", "app": "string", "conversationId": "string", "status": "string", "isArchived": "long", "appVersion": "string", "numWords": "long"})
    return mark_anomalies(rows)


def mark_anomalies(rows: DataFrame) -> DataFrame:
    counted = rows.groupBy("path", "transcriptEntityId").agg(F.count("*").alias("_n"))
    joined = rows.join(counted.withColumnRenamed("transcriptEntityId", "_id"), (rows.path == counted.path) & rows.transcriptEntityId.eqNullSafe(F.col("_id"))).drop(counted.path).drop("_id")
    return joined.withColumn("anomaly", F.coalesce(strip(F.col("transcriptEntityId")), F.lit("")).eqNullSafe(F.lit("")) | (F.col("_n") > 1)).drop("_n")


def dictation_files(rows: DataFrame) -> DataFrame:
    """By store: candidates, anomalies, and whether so few are anomalies that it may be used."""
    seen = F.col("asrText").rlike(VISIBLE)
    out = rows.groupBy("path").agg(F.count_if(seen).alias("seen"), F.count_if(seen & F.col("anomaly")).alias("pk_anomalies"), F.count_if(~F.coalesce(seen, F.lit(False))).alias("empty_rows"), F.count_if(F.col("status").isNotNull() & ~F.col("status").isin(*formats.STATUS_VALUES)).alias("unknown_status"))
    return out.withColumn("supported", F.col("pk_anomalies") <= F.col("seen") * formats.PK_ANOMALY_RATIO)


def empty_by_status(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce(F.col("asrText").rlike(VISIBLE), F.lit(False))).groupBy(F.coalesce("status", F.lit("<null>")).alias("status")).agg(F.count("*").alias("n"))


def dictation_utterances(rows: DataFrame, categories: dict[str, str] | None = None) -> DataFrame:
    """Utterances of supported stores; ``categories``: application id -> destination, other ids are ``other``."""
    gate = dictation_files(rows).where("supported").select("path")
    known = F.create_map(*[F.lit(x) for pair in (categories or {"": ""}).items() for x in pair])
    app = strip(F.coalesce("app", F.lit("")))
    status = F.create_map(*[F.lit(x) for pair in formats.STATUS_FLAGS.items() for x in pair])
    ts = text.iso_timestamp(F.regexp_replace("timestamp", r" ([+-]\d\d:\d\d)$", "$1"))
    uuid = strip(F.col("transcriptEntityId")).rlike(r"^[0-9a-fA-F]{8}-?(?:[0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$")
    flags = F.array_compact(F.array(F.when(F.coalesce(F.col("isArchived"), F.lit(0)) != 0, F.lit("archived")), status[F.col("status")], F.when(~uuid, F.lit("nonuuid_pk")), F.when(ts.isNull(), F.lit("undated"))))
    kept = rows.where(F.col("asrText").rlike(VISIBLE) & ~F.col("anomaly")).join(gate, "path")
    return kept.select("path", strip(F.col("transcriptEntityId")).alias("transcript_id"), F.col("asrText").alias("text"), ts.alias("ts"), F.nullif(strip(F.col("conversationId")), F.lit("")).alias("conversation_id"), F.when(app == "", None).otherwise(F.coalesce(known[app], F.lit("other"))).alias("destination"), F.col("appVersion").alias("app_version"), flags.alias("flags"))


# --- Key-value stores ---


def key_range(stores: DataFrame, prefix: str, table: str = "cursorDiskKV") -> DataFrame:
    """Rows (path, key, value) whose keys start with ``prefix``, as a range that the store's index serves."""
    quoted = prefix.replace("'", "''")
    return read_table(stores, table, {"key": "string", "value": "string"}, f"key >= '{quoted}' AND key < '{quoted[:-1]}{chr(ord(quoted[-1]) + 1)}'")


def key_value(stores: DataFrame, key: str, table: str = "ItemTable") -> DataFrame:
    quoted = key.replace("'", "''")
    return read_table(stores, table, {"key": "string", "value": "string"}, f"key = '{quoted}'")


def has_keys(stores: DataFrame, prefix: str) -> DataFrame:
    """(path, n): how many keys with the prefix a store has."""
    return key_range(stores, prefix).groupBy("path").agg(F.count("*").alias("n"))


def present_name(v: Column, *paths: str) -> Column:
    """The first string present at one of the paths."""
    return F.coalesce(*[F.when(present(v, p), string(v, p)) for p in paths])
