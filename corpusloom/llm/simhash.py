"""SimHash near duplicates: 64-bit fingerprints of word shingles, pigeonhole blocks, Hamming verification.

A fingerprint is cut into five blocks. Two that differ in at most three bits agree in at least two whole blocks, so each
fingerprint is keyed by all ten pairs of blocks and only fingerprints under one key are compared. Keys work on distinct
fingerprints, so copies cost nothing; a key with more than ``CHUNK`` of them is dealt out as pairs of chunks, and
within a task a group gives the edges of a spanning forest, not all its pairs.

Defined results: a text without words (null and empty ones too) has fingerprint zero and is linked like any other; with
fewer words than a shingle the whole sequence is the one shingle; repeated rows share their component; the least doc_id of
a component skips null ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import each_batch, materialize, utf8_list
from .components import components

SHINGLE, SEED, NEAR = 3, 42, 3
BLOCKS = (13, 13, 13, 13, 12)
CHUNK = 4096
#: Up to this size a group gives all its close pairs; larger ones a spanning forest.
SMALL = 32

#: Row v: the bits of byte v, lowest first.
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    parts = map(line.__getitem__, map(slice, starts[:n].tolist(), ends[size - 1 :].tolist()))
    return np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), np.uint64, n)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The SimHash: a bit is 1 if it is set in over half of the hashes. As a signed 64-bit number."""
    h = shingle_hashes(text, size)
    if not len(h):
        return 0
    each = h.view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int64) << 8)
    ones = np.bincount(each.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * ones > len(h)).ravel(), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (signed) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(t, size) for t in utf8_list(batch.column("text"))], pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(each_batch(run), "doc_id long, fp long")


def block_keys() -> list:
    """For each pair of blocks a column that holds its number and the bits of both."""
    parts, shift = [], 0
    for width in BLOCKS:
        parts.append((F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)), width))
        shift += width
    pairs = list(combinations(range(len(BLOCKS)), len(BLOCKS) - NEAR))
    return [F.shiftleft(parts[i][0], parts[j][1]).bitwiseOR(parts[j][0]).bitwiseOR(F.lit(k << 32)) for k, (i, j) in enumerate(pairs)]


def group_edges(fp: np.ndarray, near: int = NEAR) -> list[tuple[int, int]]:
    """Edges that connect what links of at most ``near`` bits connect: a breadth-first forest."""
    v, out = fp.view(np.uint64), []
    rest = np.arange(len(v))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            close = np.bitwise_count(v[rest] ^ v[i]) <= near
            if close.any():
                found = rest[close]
                rest = rest[~close]
                queue += found.tolist()
                out += [(int(fp[i]), int(fp[j])) for j in found.tolist()]
    return out


def batch_edges(group: np.ndarray, fp: np.ndarray, near: int = NEAR) -> list[tuple[int, int]]:
    """Edges of many groups; ``group`` has equal numbers side by side."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(group)]]))
    end = np.repeat(starts + sizes, sizes)
    small = np.repeat(sizes <= SMALL, sizes)
    v, at, out = fp.view(np.uint64), np.arange(len(fp)), []
    for d in range(1, SMALL):
        first = np.flatnonzero(small & (at + d < end))
        if not len(first):
            break
        x, y = fp[first], fp[first + d]
        close = (np.bitwise_count(v[first] ^ v[first + d]) <= near) & (x != y)
        out += zip(x[close].tolist(), y[close].tolist(), strict=True)
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        out += group_edges(fp[s : s + n], near)
    return out


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by (key, ci, cj); a group that goes on in the next batch waits for it."""

    def emit(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]) if len(key) else np.zeros(0, bool)
        pairs = batch_edges(np.cumsum(new), fp)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*set(pairs), strict=True)], names=["a", "b"]) if pairs else None

    key, fp = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.concatenate([key, np.stack([batch.column(c).to_numpy() for c in ("key", "ci", "cj")], axis=1)])
        fp = np.concatenate([fp, batch.column("fp").to_numpy()])
        cut = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key != key[-1]).any() else 0
        if cut and (out := emit(key[:cut], fp[:cut])) is not None:
            yield out
        key, fp = key[cut:], fp[cut:]
    if len(fp) and (out := emit(key, fp)) is not None:
        yield out


def links(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all those within three bits of each other."""
    keyed = distinct.select("fp", F.explode(F.array(*block_keys())).alias("key"))
    hot = keyed.groupBy("key").count().where(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = keyed.join(hot, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = dealt.select("key", F.least("own", "other").cast("long").alias("ci"), F.greatest("own", "other").cast("long").alias("cj"), "fp").withColumn("key", F.col("key").cast("long"))
    return rows.repartition("key", "ci", "cj").sortWithinPartitions("key", "ci", "cj").mapInArrow(_edges, "a long, b long")


def near_duplicates(docs: DataFrame, chunk: int = CHUNK, size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    own = materialize(fingerprints(docs, size), "simhash")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    star = components(links(classes.select("fp"), chunk), "simhash-star")
    # Only fingerprints with a link need the component's least doc_id; the others have their own.
    member = star.select(F.col("node").alias("fp"), "root").union(star.select(F.col("root").alias("fp"), "root").distinct())
    least = classes.join(member, "fp").groupBy("root").agg(F.min("first_id").alias("least_id"))
    found = member.join(least, "root").select("fp", "least_id")
    final = classes.join(found, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    return own.join(final, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
