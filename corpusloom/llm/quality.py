"""Quality rules: per-text counts and cross-document line frequency.

A line is normalised (ASCII and Unicode lower case, digits to ``0``, runs of white space to one space) and hashed to 64
bits. For each host (``source``) the number of *distinct documents* that hold a line is counted, whether or not they pass the
base rules; copies of a document are one document: it is known by a hash of its whole text, so a group of exact copies does not
turn its own lines into boilerplate, while documents that differ in one line only count as several. Lines above ``max_docs`` are
removed, and a document of which less than ``min_left`` of the words stays is depleted and rejected.

Defined results: a null or empty text has no words and fails the base rules (fewer than 10 words); a null host is a host
of its own; repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_batch, materialize, text_list

SYMBOLS = re.compile(r"[#*$%&|<>]")
DIGITS = re.compile(r"[0-9]+")
MAX_DOCS, MIN_LEFT = 50, 0.2

BASE_SCHEMA = "row_no long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, line_hash array<long>, line_words array<int>, identity long"


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found at least twice in the text, the first one included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = (mixed ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    at: dict[tuple, list[int]] = {}
    whole = ids.tolist()
    for i in np.flatnonzero(maybe).tolist():
        at.setdefault(tuple(whole[i : i + size]), []).append(i)
    covered = np.zeros(len(words) + 1, np.int64)
    for places in at.values():
        if len(places) > 1:
            p = np.asarray(places)
            np.add.at(covered, p, 1)
            np.add.at(covered, p + size, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def normalised_line(line: str) -> str:
    return DIGITS.sub("0", " ".join(line.lower().split()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_hash(line: str) -> int:
    return _signed(xxhash.xxh64_intdigest(normalised_line(line).encode(), 7))


def base_counts(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, hashes of distinct lines, their words, identity)."""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    kinds: dict[int, int] = {}
    for line, times in Counter(lines).items():
        h = line_hash(line.decode())
        kinds[h] = kinds.get(h, 0) + times * len(line.split())
    return len(words), chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words), list(kinds), list(kinds.values()), _signed(xxhash.xxh64_intdigest(raw, 7))


def _base(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [base_counts(t) for t in text_list(batch.column("text"))]
    cols = list(zip(*rows, strict=True))
    failed = [n < 10 or 100 * rep > 20 * n for n, rep in zip(cols[0], cols[4], strict=True)]
    return pa.RecordBatch.from_arrays(
        [batch.column("row_no"), batch.column("doc_id"), batch.column("host"), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(failed), pa.array(cols[5], pa.list_(pa.int64())), pa.array(cols[6], pa.list_(pa.int32())), pa.array(cols[7], pa.int64())],
        names=[x.split()[0] for x in BASE_SCHEMA.split(", ")],
    )


def quality_table(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, with_lines: bool = False) -> DataFrame:
    """Base counts and verdict of each document: the columns of the contract plus ``left_words`` and ``row_no``; with ``gone_lines`` (hashes of its lines above the limit) if asked for."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id"), F.col(host).alias("host"), F.col("text").cast("string").alias("text"))
    base = materialize(rows.mapInArrow(each_batch(_base), BASE_SCHEMA.replace("doc_id long", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")), "quality")
    lines = base.select("row_no", F.coalesce("host", F.lit("")).alias("host"), "identity", F.inline(F.arrays_zip("line_hash", "line_words"))).withColumnsRenamed({"line_hash": "h", "line_words": "w"})
    # Two counting steps, each with a partial one before its shuffle: no line gathers its documents in one task.
    common = lines.groupBy("host", "h", "identity").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > max_docs)
    gone = lines.join(common.select("host", "h"), ["host", "h"]).groupBy("row_no").agg(F.sum("w").alias("gone"), *([F.collect_set("h").alias("gone_lines")] if with_lines else []))  # at most a text's own lines
    out = base.drop("line_hash", "line_words", "identity").join(gone, "row_no", "left").withColumn("total", F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    return out.withColumn("left_words", left).withColumn("kept", ~F.col("base_failed") & (left >= min_left * F.col("n_words"))).drop("gone", "total", "host")


def op9(docs: DataFrame) -> DataFrame:
    return quality_table(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "left_words")


def without_lines(text: str, gone: set[int]) -> str:
    """The text without the lines whose normalised form has one of these hashes; blank lines stay."""
    return "\n".join(line for line in text.split("\n") if not line.encode().strip() or line_hash(line) not in gone)


def cleaned(rows: DataFrame) -> DataFrame:
    """Rows (any columns, with text, n_chars and ``gone_lines``): those lines go from the texts, and ``n_chars`` follows where a text changed."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, sizes, gone = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), batch.column("gone_lines").to_pylist()
        for i, lines in enumerate(gone):
            if lines:
                texts[i] = without_lines(texts[i], set(lines))
                sizes[i] = len(texts[i])
        return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).set_column(batch.schema.get_field_index("n_chars"), "n_chars", pa.array(sizes, pa.int64()))

    return rows.withColumn("n_chars", F.col("n_chars").cast("long")).mapInArrow(each_batch(run), rows.withColumn("n_chars", F.col("n_chars").cast("long")).schema).drop("gone_lines")
