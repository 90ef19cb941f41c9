"""Files, lines and JSON records.

A file is a row (path, value), a line a row (path, line_no, line), a parsed line has ``v``, a variant, null where the line is no
JSON. Files come by Spark's readers, so any file system works; a file over ``MOST_BYTES`` is left out and reported by ``oversize``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

MOST_BYTES = 256 * 1024 * 1024
_WS = fixed.white_space_class()
VISIBLE = "[^" + _WS[1:]


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{_WS}+|{_WS}+$", "")


def files(spark: SparkSession, path: str, pattern: str = "*", most: int = MOST_BYTES) -> DataFrame:
    """path, file_name, file_size, modified and the whole text of every file below ``path``; broken UTF-8 becomes U+FFFD."""
    meta = F.col("_metadata")
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    found = found.select(meta.getField("file_path").alias("path"), meta.getField("file_name").alias("file_name"), meta.getField("file_size").alias("file_size"), meta.getField("file_modification_time").alias("modified"), "value")
    return found.where(F.col("file_size") <= most).withColumn("value", F.make_valid_utf8("value"))


def oversize(spark: SparkSession, path: str, pattern: str = "*", most: int = MOST_BYTES) -> DataFrame:
    """Diagnostics for the files that ``files`` leaves out; their contents aren't read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")
    return listed.where(F.col("length") > most).select(F.lit("SOURCE_FILE_OVERSIZE").alias("code"), F.col("path").alias("item_ref"))


def lines(found: DataFrame) -> DataFrame:
    """path, line_no (from 0), line; and ``closed``: whether the file ends with a line feed."""
    return found.select("path", F.endswith("value", F.lit("\n")).alias("closed"), F.posexplode(F.split("value", "\n", -1)).alias("line_no", "line"))


def parsed(rows: DataFrame) -> DataFrame:
    """The visible lines with ``v``, and ``tail``: a broken last line (an append that was cut), or ``malformed``: any other broken one."""
    seen = rows.where(F.col("line").rlike(VISIBLE)).withColumn("v", F.try_parse_json("line"))
    # The last line of each file is an aggregation, so that no task gathers the lines of a large file.
    last = rows.where(F.col("line").rlike(VISIBLE)).groupBy("path").agg(F.max("line_no").alias("_last"))
    broken, at_end = F.col("v").isNull(), F.col("line_no") == F.col("_last")
    return seen.join(last, "path").withColumn("tail", broken & at_end).withColumn("malformed", broken & ~at_end).drop("_last")


def at(v: Column, path: str) -> Column:
    return F.variant_get(v, path, "variant")


def kind(v: Column, path: str) -> Column:
    """The type of what stands at the path, VOID for a JSON null; null if nothing stands there."""
    return F.schema_of_variant(at(v, path))


def present(v: Column, path: str) -> Column:
    """Something other than null stands at the path."""
    return F.coalesce(kind(v, path) != "VOID", F.lit(False))


def has_key(v: Column, path: str) -> Column:
    return kind(v, path).isNotNull()


def string(v: Column, path: str) -> Column:
    """The string at the path, null if it is of another type."""
    return F.when(kind(v, path) == "STRING", F.variant_get(v, path, "string"))


def is_object(v: Column, path: str) -> Column:
    return F.coalesce(F.startswith(kind(v, path), F.lit("OBJECT")), F.lit(False))


def is_array(v: Column, path: str) -> Column:
    return F.coalesce(F.startswith(kind(v, path), F.lit("ARRAY")), F.lit(False))


def is_true(v: Column, path: str) -> Column:
    return F.coalesce((kind(v, path) == "BOOLEAN") & F.variant_get(v, path, "string").eqNullSafe(F.lit("true")), F.lit(False))


def elements(v: Column, path: str) -> Column:
    """The elements of an array as variants, none if it is no array."""
    none = F.expr("filter(array(parse_json('null')), x -> false)")
    return F.coalesce(F.when(is_array(v, path), F.variant_get(v, path, "array<variant>")), none)


def tolerant(rows: DataFrame, required: dict[str, str], optional: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, diagnostics) of JSON lines that must be objects with just these keys.

    ``required`` and ``optional``: key -> SQL type of a scalar. Every bad line becomes one diagnostic (code, item_ref ``path:line``): no JSON,
    missing keys before extra keys before wrong values.
    """
    optional = optional or {}
    keys = F.expr("json_object_keys(line)")
    v, allowed = F.col("v"), F.array(*[F.lit(k) for k in (*required, *optional)])
    wanted = F.array(*[F.lit(k) for k in required])
    wrong = F.lit(False)
    kinds = {"string": "STRING", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for k, t in {**required, **optional}.items():
        own = kind(v, f"$.{k}")
        wrong = wrong | F.coalesce(own != kinds[t], F.lit(False))
    code = (
        F.when(v.isNull(), "SCHEMA_INVALID_JSON")
        .when(~is_object(v, "$"), "SCHEMA_INVALID_VALUE")
        .when(F.size(F.array_except(wanted, keys)) > 0, "SCHEMA_MISSING_FIELD")
        .when(F.size(F.array_except(keys, allowed)) > 0, "SCHEMA_UNKNOWN_FIELD")
        .when(wrong, "SCHEMA_INVALID_VALUE")
    )
    judged = rows.where(F.col("line").rlike(VISIBLE)).withColumn("v", F.try_parse_json("line")).withColumn("code", code)
    good = judged.where("code is null").select("path", "line_no", *[F.variant_get(v, f"$.{k}", t).alias(k) for k, t in {**required, **optional}.items()])
    bad = judged.where("code is not null").select("path", "line_no", "code", F.concat_ws(":", "path", (F.col("line_no") + 1).cast("string")).alias("item_ref"))
    return good, bad


def strict(rows: DataFrame, required: dict[str, str], optional: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``tolerant``, but the first bad line quarantines its file: no record of it stays, and it gives one diagnostic."""
    good, bad = tolerant(rows, required, optional)
    first = bad.groupBy("path").agg(F.min_by(F.struct("line_no", "code", "item_ref"), "line_no").alias("b")).select("path", "b.*")
    return good.join(first.select("path"), "path", "left_anti"), first
