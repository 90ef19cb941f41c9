"""One way to read every source: the formats by name, each with its files, its utterances and its diagnostics.

``extract`` reads one source through Spark's own readers; ``lines`` reads the line formats through the data source, which opens only the files that its filters leave.
Utterances have the same columns whatever the format: source_adapter, session_id, item_ref, text, ts, confidence, text_status, flags, generation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.collect import within_bounds
from . import composers, datasource, formats, histories, records, stores, task_trees, tasks, transcripts
from .split_lines import numbered_lines

COLUMNS = "source_adapter string, session_id string, item_ref string, text string, ts timestamp, confidence double, text_status string, flags array<string>, generation string"


@dataclass(frozen=True)
class Adapter:
    """A format: its file patterns, ``read(spark, path)`` for its utterances, and ``faults(spark, path)`` for what of it can't be read."""

    patterns: tuple[str, ...]
    read: Callable[[SparkSession, str], DataFrame]
    faults: Callable[[SparkSession, str], DataFrame]
    line_format: bool = False


def _uniform(rows: DataFrame, adapter: str, **columns: str | Column) -> DataFrame:
    """The common columns; what a format doesn't have is null."""
    have = {k: F.col(c) if isinstance(c, str) else c for k, c in columns.items()} | {"source_adapter": F.lit(adapter)}
    parts = [x.split(" ", 1) for x in COLUMNS.split(", ")]
    return rows.select(*[have.get(n, F.lit(None)).cast(t).alias(n) for n, t in parts])


def _oversize(pattern: str, most: int = records.MOST_BYTES) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: records.oversize(spark, path, pattern, most)


def _typed(rows: DataFrame) -> DataFrame:
    out = transcripts.typed_utterances(rows)
    return _uniform(out, "claude_code", session_id="session_id", item_ref="uuid", text="text", ts="ts", flags="flags")


def _rollouts(rows: DataFrame) -> DataFrame:
    out = transcripts.rollout_utterances(rows)
    return _uniform(out, "codex", session_id="session_id", item_ref=F.col("line_no").cast("string"), text="text", ts="ts", confidence="confidence", flags="flags" if "flags" in out.columns else F.lit(None))


def _chats(spark: SparkSession, path: str) -> DataFrame:
    lines = transcripts.chat_lines(numbered_lines(spark, path, "*.jsonl").select("path", "closed", F.col("line_no").cast("int").alias("line_no"), "line"))
    documents = transcripts.chat_documents(records.files(spark, path, "*.json"))
    columns = ["path", "line_no", "line_kind", "v", "tail", "malformed"]
    out = transcripts.chat_utterances(lines.select(*columns).unionByName(documents.select(*columns)))
    return _uniform(out, "gemini_cli", session_id="session_id", item_ref="message_id", text="text", ts="ts", flags="flags")


def _histories(spark: SparkSession, path: str) -> DataFrame:
    own = histories.input_utterances(records.files(spark, path, "*input.history*"))
    return _uniform(own, "aider", session_id="path", item_ref=F.col("ordinal").cast("string"), text="text", ts="ts")


def _parts(spark: SparkSession, path: str) -> DataFrame:
    both = stores.part_store_messages(stores.store_files(spark, path, "*.db")).unionByName(stores.part_tree_messages(records.files(spark, path, "*.json")), allowMissingColumns=True)
    return _uniform(stores.part_utterances(both), "opencode", session_id="session_id", item_ref="message_id", text="text", ts="ts", generation="generation", flags=F.when(F.col("generation_text_mismatch"), F.array(F.lit("generation_text_mismatch"))))


def _tasks(spark: SparkSession, path: str) -> DataFrame:
    rows = tasks.documents(records.files(spark, path, formats.API_HISTORY))
    ui = tasks.documents(records.files(spark, path, formats.TASK_UI)).withColumn("path", F.regexp_replace("path", f"{formats.TASK_UI}$", formats.API_HISTORY))
    own = tasks.own_tasks(tasks.spans(tasks.payloads(rows)), tasks.new_task_arguments(rows))
    out = tasks.timed(own, tasks.feedback_times(ui), F.lit(None).cast("timestamp"))
    return _uniform(out, "cline", session_id=F.regexp_extract("path", "([^/]+)/[^/]+$", 1), item_ref=F.concat_ws(".", "record", "block", "part", "span"), text="text", ts="ts", text_status="text_status", flags="flags")


def _task_trees(spark: SparkSession, path: str) -> DataFrame:
    out = task_trees.utterances(records.files(spark, path, "*.json", most=1 << 62))
    return _uniform(out, "roo_code", session_id="task", item_ref=F.concat_ws(".", "record", "block", "span"), text="text", ts="ts", confidence="confidence", text_status="text_status", flags="flags")


def _composers(spark: SparkSession, path: str) -> DataFrame:
    found = stores.store_files(spark, path, "*.vscdb")
    items = stores.key_range(found, formats.COMPOSER).unionByName(stores.key_range(found, formats.BUBBLE))
    return _uniform(composers.utterances(items), "cursor", session_id="composer_id", item_ref="bubble_id", text="text", ts="ts", flags="flags", generation="gate")


def _dictations(spark: SparkSession, path: str) -> DataFrame:
    out = stores.dictation_utterances(stores.dictation_rows(stores.store_files(spark, path, "*.sqlite")))
    return _uniform(out, "wispr_flow", session_id="conversation_id", item_ref="transcript_id", text="text", ts="ts", flags="flags")


def _lines_of(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path, "*.jsonl").select("path", "closed", F.col("line_no").cast("int").alias("line_no"), "line")


def _store_faults(pattern: str, required: dict[str, tuple[str, ...]]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: stores.oversize(spark, path, pattern).unionByName(stores.unsupported(stores.structure(stores.store_files(spark, path, pattern)), required))


def _task_faults(spark: SparkSession, path: str) -> DataFrame:
    return records.oversize(spark, path, formats.API_HISTORY).unionByName(tasks.broken(records.files(spark, path, formats.API_HISTORY)))


def _nothing(spark: SparkSession, path: str) -> DataFrame:  # noqa: ARG001  files of any size are read
    return spark.createDataFrame([], "code string, item_ref string")


ADAPTERS = {
    "aider": Adapter(("*input.history*",), _histories, _oversize("*input.history*")),
    "claude_code": Adapter(("*.jsonl",), lambda spark, path: _typed(_lines_of(spark, path)), _nothing, line_format=True),
    "cline": Adapter((f"*/{formats.API_HISTORY}",), _tasks, _task_faults),
    "codex": Adapter(("*rollout-*.jsonl",), lambda spark, path: _rollouts(_lines_of(spark, path)), _nothing, line_format=True),
    "cursor": Adapter(("*.vscdb",), _composers, _store_faults("*.vscdb", {"cursorDiskKV": ("key", "value"), "ItemTable": ("key", "value")})),
    "gemini_cli": Adapter(("*.jsonl", "*.json"), _chats, _oversize("*.json", formats.CHAT_DOCUMENT_BYTES)),
    "opencode": Adapter(("*.db", "*.json"), _parts, _store_faults("*.db", stores.PART_STORE)),
    "roo_code": Adapter((f"*/{formats.API_HISTORY}", f"*/{formats.HISTORY_ITEM}", f"*/{formats.TASK_UI}"), _task_trees, _task_faults),
    "wispr_flow": Adapter(("*.sqlite",), _dictations, _store_faults("*.sqlite", {"History": formats.HISTORY_REQUIRED})),
}


def extract(spark: SparkSession, adapter: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(utterances, diagnostics) of one source."""
    found = ADAPTERS[adapter]
    return found.read(spark, path), found.faults(spark, path).withColumn("source_adapter", F.lit(adapter))


def extract_all(spark: SparkSession, sources: dict[str, str], start: Column, end: Column, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(utterances within the period, diagnostics) of many sources: adapter -> folder."""
    both = [extract(spark, adapter, path) for adapter, path in sorted(sources.items())]
    return reduce(DataFrame.unionByName, (u for u, _ in both)).where(within_bounds(F.col("ts"), start, end, cutoff)), reduce(DataFrame.unionByName, (d for _, d in both))


def lines(spark: SparkSession, path: str, split_bytes: int = datasource.SPLIT_BYTES) -> DataFrame:
    """The lines of all line formats below ``path`` through the data source; filters on adapter, path and time of change decide which files are opened."""
    spark.dataSource.register(datasource.FilesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(datasource.NAME).option("path", path).option("splitBytes", split_bytes)
    for name, adapter in ADAPTERS.items():
        if adapter.line_format:
            reader = reader.option(datasource.PREFIX + name, ",".join(adapter.patterns))
    return reader.load()


def source_types(others: tuple[str, ...] = ()) -> list[str]:
    """The public source types: the adapters and whatever else a corpus names."""
    return sorted({*ADAPTERS, *others})
