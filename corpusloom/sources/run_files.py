"""The files of a run as tables: sessions in the order of their numbers, the session index, drop lists, the event log, the usage profile, and the index of a workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import records
from .records import elements, has_key, is_array, is_object, string
from .split_lines import numbered_lines

SESSION_NAME = r"^session-([0-9]{4,})\.jsonl$"
EVENT_FIELDS = {"at": "string", "kind": "string"}
EVENT_OPTIONAL = {"step_id": "long", "artifact_id": "string", "artifact_hash": "string", "replaced_artifact_id": "string", "detail_code": "string"}


def session_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, session_seq, line_no, line of every session file; ``session_seq`` is the number in its name, so session 10000 follows 9999."""
    rows = numbered_lines(spark, path, "session-*.jsonl").where(F.col("file_name").rlike(SESSION_NAME))
    return rows.select("path", F.regexp_extract("file_name", SESSION_NAME, 1).cast("long").alias("session_seq"), F.col("line_no").cast("int").alias("line_no"), "closed", "line")


def sessions(spark: SparkSession, path: str, required: dict[str, str], optional: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(session_seq, i, fields...) of every session, and the diagnostics of broken lines; ``i`` counts a session's lines from 1."""
    rows = session_lines(spark, path)
    good, bad = records.tolerant(rows.select("path", "line_no", "line"), required, optional)
    seq = F.regexp_extract("path", "([0-9]+)\\.jsonl$", 1).cast("long")
    return good.select(seq.alias("session_seq"), (F.col("line_no") + 1).alias("i"), *required, *(optional or {})), bad


def session_index(found: DataFrame) -> DataFrame:
    """(path, file_name, session_hash) of index files; a file of another shape has none."""
    v = F.try_parse_json("value")
    rows = found.select("path", F.when(is_object(v, "$.sessions"), F.variant_get(v, "$.sessions", "map<string,variant>")).alias("m"))
    return rows.select("path", F.explode("m").alias("file_name", "h")).select("path", "file_name", F.coalesce(string(F.col("h"), "$"), F.to_json("h")).alias("session_hash"))


def drop_lists(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, drop) of the drop lists, one object with an array of whole numbers for each session; and the diagnostics of all other files."""
    v = F.col("v")
    numbers = F.transform(elements(v, "$.drop"), lambda x: F.when(F.schema_of_variant(x) == "BIGINT", F.try_variant_get(x, "$", "long")))
    rows = found.select("path", F.try_parse_json("value").alias("v"))
    code = F.when(v.isNull(), "SCHEMA_INVALID_JSON").when(~is_object(v, "$"), "SCHEMA_INVALID_VALUE").when(~has_key(v, "$.drop"), "SCHEMA_MISSING_FIELD").when(~is_array(v, "$.drop") | F.exists(numbers, lambda n: n.isNull() | (n < 1)), "SCHEMA_INVALID_VALUE")
    judged = rows.select("path", numbers.alias("drop"), code.alias("code"))
    return judged.where("code is null").select("path", "drop"), judged.where("code is not null").select("code", F.col("path").alias("item_ref"))


def event_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, line_no, at, kind, step_id, ...) of event logs, and the diagnostics of lines that aren't events. A time without a zone is none."""
    rows = numbered_lines(spark, path, "events.jsonl").select("path", F.col("line_no").cast("int").alias("line_no"), "line")
    good, bad = records.tolerant(rows, EVENT_FIELDS, EVENT_OPTIONAL)
    zoned = F.col("at").rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    at = F.when(zoned, F.col("at").try_cast("timestamp"))
    naive = good.where(at.isNull()).select("path", "line_no", F.lit("SCHEMA_INVALID_VALUE").alias("code"), F.concat_ws(":", "path", (F.col("line_no") + 1).cast("string")).alias("item_ref"))
    return good.withColumn("at", at).where("at is not null"), bad.unionByName(naive)


def profile_entries(found: DataFrame, fields: str) -> DataFrame:
    """The entries of usage profiles as columns; ``fields``: their DDL."""
    return found.select(F.explode(F.from_json("value", f"entries array<struct<{fields}>>")["entries"]).alias("e")).select("e.*")


def workspace_index(items: DataFrame) -> DataFrame:
    """(path, composer_id, inline) of a workspace's list of composers; ``inline`` marks entries that carry a conversation themselves."""
    v = F.col("e")
    rows = items.select("path", F.explode(elements(F.try_parse_json("value"), "$.allComposers")).alias("e")).where(is_object(v, "$"))
    held = is_array(v, "$.conversation") | is_array(v, "$.messages")
    return rows.select("path", string(v, "$.composerId").alias("composer_id"), F.coalesce(held, F.lit(False)).alias("inline"))


def json_schema(schema: T.StructType) -> dict:
    """A JSON Schema of rows with this schema: closed objects whose fields that may not be null are required."""
    plain = {T.StringType: "string", T.BooleanType: "boolean", T.DoubleType: "number", T.FloatType: "number", T.LongType: "integer", T.IntegerType: "integer", T.ShortType: "integer", T.ByteType: "integer"}

    def of(kind: T.DataType, null: bool) -> dict:
        if isinstance(kind, T.StructType):
            out = {"type": "object", "properties": {f.name: of(f.dataType, f.nullable) for f in kind}, "required": [f.name for f in kind if not f.nullable], "additionalProperties": False}
        elif isinstance(kind, T.ArrayType):
            out = {"type": "array", "items": of(kind.elementType, kind.containsNull)}
        elif isinstance(kind, T.MapType):
            out = {"type": "object", "additionalProperties": of(kind.valueType, kind.valueContainsNull)}
        elif isinstance(kind, (T.TimestampType, T.DateType)):
            out = {"type": "string", "format": "date-time" if isinstance(kind, T.TimestampType) else "date"}
        else:
            out = {"type": plain.get(type(kind), "string")}
        return out | {"type": [out["type"], "null"]} if null else out

    return {"$schema": "https://json-schema.org/draft/2020-12/schema"} | of(schema, False)
