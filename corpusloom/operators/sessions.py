"""Session order, numbering and gaps; spans; carry-forward; early stop; batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .common import global_row_number

GAP_SECONDS = 1800


def session_numbers(utterances: DataFrame) -> DataFrame:
    """Adds ``session_seq`` (sessions by their earliest row) and ``i`` (rows within: dated first, by time and id), both from 1."""
    order = F.struct(F.col("ts").isNull().alias("undated"), F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("at"), F.col("utterance_id").alias("id"))
    rows = utterances.withColumn("_order", order)
    first = rows.groupBy("session_hash").agg(F.min("_order").alias("first"))
    numbered = global_row_number(first, ["first", "session_hash"], "session_seq").select("session_hash", "session_seq")
    within = Window.partitionBy("session_hash").orderBy("_order")
    return rows.withColumn("i", F.row_number().over(within).cast("long")).join(numbered, "session_hash").drop("_order")


def session_file(seq: Column) -> Column:
    return F.format_string("session-%04d.jsonl", seq)


def gap_sessions(rows: DataFrame, owner: str, at: str, key: str, conversation: str | None = None, gap: int = GAP_SECONDS) -> DataFrame:
    """Adds ``session``: bursts without a silence of more than ``gap`` seconds; a conversation id overrides, an undated row stands alone."""
    talk = F.col(conversation).cast("string") if conversation else F.lit(None).cast("string")
    rows = rows.withColumn("_talk", talk).withColumn("_kind", F.when(F.col("_talk").isNotNull(), "conversation").when(F.col(at).isNull(), "transcript").otherwise("burst"))
    order = Window.partitionBy(owner, "_kind").orderBy(at, key)
    silent = F.unix_micros(at) - F.unix_micros(F.lag(at).over(order)) > gap * 1_000_000
    opens = F.when(F.lag(key).over(order).isNull() | silent, F.col(key).cast("string"))
    burst = F.last(opens, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    basis = F.when(F.col("_kind") == "conversation", F.col("_talk")).when(F.col("_kind") == "transcript", F.col(key).cast("string")).otherwise(burst)
    return rows.withColumn("session", F.concat_ws("|", F.col("_kind"), basis)).drop("_talk", "_kind")


def overlaps(spans: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Spans that begin before the one before them (by start, then end) has ended."""
    order = Window.partitionBy(by).orderBy(start, end)
    return spans.withColumn("previous_end", F.lag(end).over(order)).where(F.col("previous_end") > F.col(start))


def span_code(kept: Column, source: Column) -> Column:
    """Whether each line of ``kept`` stands in ``source`` in order and without overlap: a code, or null."""
    state = F.struct(F.lit(0).alias("cursor"), F.lit(None).cast("string").alias("code"))

    def step(s: Column, line: Column) -> Column:
        at = F.when(F.length(line) == 0, s["cursor"] + 1).otherwise(F.call_function("locate", line, source, s["cursor"] + 1))
        found = F.struct((at - 1 + F.length(line)).alias("cursor"), F.lit(None).cast("string").alias("code"))
        lost = F.struct(s["cursor"].alias("cursor"), F.when(F.contains(source, line), "AUTHORSHIP_SPAN_ORDER_INVALID").otherwise("AUTHORSHIP_SPAN_NOT_VERBATIM").alias("code"))
        return F.when(s["code"].isNotNull(), s).when(at > 0, found).otherwise(lost)

    return F.aggregate(F.split(kept, "\n"), state, step)["code"]


def carry_forward(rows: DataFrame, by: str, order: list[str], mark: Column, value: Column) -> Column:
    """The value at the latest marked row up to this one; a marked null resets it."""
    window = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(mark, F.struct(value.alias("v"))), ignorenulls=True).over(window)["v"]


def stop_on_evidence(rows: DataFrame, by: str, order: Column, found: str, target: int = fixed.FOUND_TARGET) -> DataFrame:
    """Rows, in the given order, until what was found before them reaches the target."""
    before = F.sum(found).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("found_before", F.coalesce(before, F.lit(0)).cast("long")).where(F.col("found_before") < target)


def opaque_labels(rows: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """``Name n`` for each row of a name, numbered in the given order."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return rows.withColumn("opaque_label", F.concat(F.initcap(F.col(name)), F.lit(" "), n.cast("string")))


def pack_batches(items: DataFrame, by: str, seq: str, words: str, target: int, most: int = fixed.MAX_BATCH_SESSIONS) -> DataFrame:
    """Batches of consecutive items: a batch closes before an item that would take it over ``target`` words, and at ``most`` items.

    An order-bound fold: the items of a run stream through a task in order and only the open batch is held. ``by`` and ``seq`` are whole numbers.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, batch, n, load = None, 0, 0, 0
        for part in batches:
            numbers = []
            for b, w in zip(part.column(by).to_pylist(), part.column(words).to_pylist(), strict=True):
                if b != run:
                    run, batch, n, load = b, 0, 0, 0
                if n and (load + w > target or n >= most):
                    batch, n, load = batch + 1, 0, 0
                n, load = n + 1, load + w
                numbers.append(batch)
            yield pa.RecordBatch.from_arrays([part.column(by), part.column(seq), pa.array(numbers, pa.int64())], names=[by, seq, "batch"])

    rows = items.select(F.col(by).cast("long"), F.col(seq).cast("long"), F.coalesce(F.col(words), F.lit(0)).cast("long").alias(words))
    return rows.repartition(by).sortWithinPartitions(by, seq).mapInArrow(fold, f"{by} long, {seq} long, batch long")


def plan_batches(sizes: list[tuple[str, int]], step: str = "c", cap: int = fixed.DEFAULT_AGENT_CAP) -> dict:
    """Batches of a run's sessions (name, words) for the agents a step may use; works on the driver over one run's session sizes."""
    spendable = max(1, math.floor(cap * (1 - fixed.AGENT_RESERVE)))
    allowance = max(1, spendable // fixed.AGENT_STEPS)
    total = sum(w for _, w in sizes)

    def packed(target: int) -> list[list[str]]:
        out: list[list[str]] = []
        load = 0
        for name, w in sizes:
            if not out or load + w > target or len(out[-1]) >= fixed.MAX_BATCH_SESSIONS:
                out.append([])
                load = 0
            out[-1].append(name)
            load += w
        return out

    if len(sizes) <= allowance:
        batches, batched = [[name] for name, _ in sizes], False
    else:
        batched = True
        target = min(max(fixed.MIN_BATCH_WORDS, math.ceil(total / allowance)), fixed.MAX_BATCH_WORDS)
        batches = packed(target)
        while len(batches) > allowance and target < fixed.MAX_BATCH_WORDS:
            target = min(fixed.MAX_BATCH_WORDS, max(target + fixed.MIN_BATCH_WORDS, math.ceil(target * 1.2)))
            batches = packed(target)
    needed = len(batches) * fixed.AGENT_STEPS_REMAINING[step]
    return {"batches": batches, "batched": batched, "fits": needed <= cap, "sessions": len(sizes), "words": total, "per_step_allowance": allowance, "agents_required_all_steps": needed, "host_sessions_required": max(1, math.ceil(needed / cap))}
