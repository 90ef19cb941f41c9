"""Exact repeated-passage removal by column-wise construction over aligned fragments.

A text is a sequence of symbols: its bytes, or its words (``BY_WORDS``; white space between words then doesn't count). Every symbol that a
string of ``width`` symbols covers goes, if that string also starts anywhere else, in the same text or in another one. The order of
suffixes and their common prefixes come from a column-wise construction: one symbol of every document is inserted per round,
from the last column to the first, and the round updates the collection's order (a stable sort by the new symbol) and the
common prefixes of neighbours.

The collection is not the whole corpus but what may repeat. In each window of ``width`` symbols the leftmost k-mer of least
hash is its anchor, so equal windows have equal anchors at one place; an anchor that occurs once in the corpus can't lie in
a repeat. A fragment is what windows with that anchor can reach (``width - k`` symbols before it, ``width`` from it on),
and fragments of one anchor are aligned on it: equal windows stand in the same columns. Groups of fragments stream
through a task in order of their anchor, as sequential external files, and equal fragments are one row with a count.
No group of more than ``group_rows`` different fragments meets in one task: it is divided by steps of starting columns and by
the core that all windows of a step have, which equal windows share, and each part is constructed like a group. Only parts that
are still larger (one core in that many surroundings) are counted by a 128-bit hash of each window.

Texts that several rows share are one text with a count; whole copies of ``width`` symbols or more are removed wholly.

Defined results: a null or empty text, or one under ``width`` symbols, keeps all; matches never cross texts; strings are judged on the
input; a character that a cut between bytes leaves broken is left out of ``kept`` (not of the digest); by words, a removed run goes with
the white space behind it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, each_batch, materialize

WIDTH, KMER = 400, 64
#: Symbols: bytes, or 64-bit hashes of words.
BY_BYTES, BY_WORDS = 1, 8
GROUP_ROWS = 20_000
#: Fragments that a task holds at once, unless a single group has more.
BATCH_ROWS = 10_000
#: Fragments that a task passes on at once.
FRAGMENTS_OUT = 5_000
#: Windows of a large group that a task passes on at once.
WINDOWS_OUT = 20_000
#: Steps into which the starting columns of a large group are divided.
STEPS = 16

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BI = np.uint64(pow(int(_B), -1, 1 << 64))
_CODE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers[name]
    if len(have) < n:
        have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 2 * len(have)), base, np.uint64)]), dtype=np.uint64)
        if len(have) <= 1 << 19:
            _powers[name] = have
    return have[:n]


def symbols_of(raw: bytes, unit: int) -> np.ndarray:
    if unit == BY_BYTES:
        return np.frombuffer(raw, np.uint8)
    words = raw.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed rolling hash of each k-mer."""
    n = len(data)
    codes = _CODE[data] if data.dtype == np.uint8 else data
    total = np.concatenate([[np.uint64(0)], np.cumsum(codes * _power("down", _BI, n), dtype=np.uint64)])
    h = (total[k:] - total[:-k]) * _power("up", _B, n - k + 1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(30)
    return h


def anchors(data: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the k-mers that are the leftmost least one of some window."""
    if len(data) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = kmer_hashes(data, k)
    w = width - k + 1
    n = len(h) - w + 1
    # Sliding minimum of w values: minima from the left and from the right within blocks of w.
    size = -(-len(h) // w) * w
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, w)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(left[:n], right[w - 1 : w - 1 + n])
    # A k-mer is an anchor iff it is the least of a window and no equal one stands before it there: of the windows in
    # which its value is the least, the first starts at most w-1 before it and after the last equal value before it.
    runs = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.concatenate([runs[1:], [n]])
    places = []
    single = ends - runs
    for s, e in zip(runs[single > w].tolist(), ends[single > w].tolist(), strict=True):
        places.append(s + np.flatnonzero(h[s : e + w - 1] == least[s]))  # a run longer than a window has several equal k-mers
    short = runs[single <= w]
    last = ends[single <= w]
    # In a short run of windows s..e-1 the anchor of the first window is its leftmost least k-mer; others may follow.
    out = np.zeros(len(h), bool)
    for p in places:
        out[p] = True
    for s, e in zip(short.tolist(), last.tolist(), strict=True):
        v, at, stop = least[s], s, e
        while at < stop:
            p = at + int(np.argmax(h[at : at + w] == v))
            out[p] = True
            at = p + 1
    pos = np.flatnonzero(out)
    return pos, h[pos].view(np.int64)


def _packer(names: list[str], kinds: tuple):
    return lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _anchor_batch(width: int, k: int, unit: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, pos, hashes = [], [], []
        for i, raw in zip(batch.column("no").to_pylist(), batch.column("raw"), strict=True):
            p, h = anchors(symbols_of(raw.as_py(), unit), width, k)
            ids.append(np.full(len(p), i, np.int64))
            pos.append(p)
            hashes.append(h)
        if not sum(map(len, ids)):
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(pos).astype(np.int32)), pa.array(np.concatenate(hashes))], names=["no", "pos", "anchor"])

    return each_batch(run)


def _fragment_batch(width: int, k: int, unit: int):
    reach = width - k
    packed = _packer(["no", "pos", "anchor", "first", "fid", "part"], (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c) for c in ("no", "raw", "pos", "anchor")]
            for n in range(batch.num_rows):
                i, t, pos, found = (c[n].as_py() for c in columns)
                t = symbols_of(t, unit).tobytes()
                for p, a in zip(pos, found, strict=True):
                    head = min(p, reach)
                    part = t[(p - head) * unit : (p + width) * unit]
                    rows.append((i, p, a, reach - head, xxhash.xxh3_128_digest(part, seed=head), part))
                    if len(rows) == FRAGMENTS_OUT:
                        yield packed(rows)
                        rows = []
        if rows:
            yield packed(rows)

    return run


def repeated_windows(group: np.ndarray, parts: list[np.ndarray], first: np.ndarray, width: int, starts: int) -> np.ndarray:
    """rows x ``starts``: whether the row's window that starts in the column is equal to another row's of its group.

    ``group`` has equal numbers side by side; row r's symbols stand in the columns from ``first[r]`` on.
    """
    m, columns = len(parts), starts - 1 + width
    numbers, none, at = np.concatenate(parts), 256, 0
    if numbers.dtype != np.uint8:
        kinds, numbers = np.unique(numbers, return_inverse=True)
        none = len(kinds)
    symbols = np.full((m, columns), none, np.int16 if none < 1 << 15 else np.int32)
    for r, (p, h) in enumerate(zip(parts, first.tolist(), strict=True)):
        symbols[r, h : h + len(p)] = numbers[at : at + len(p)]
        at += len(p)
    symbols = np.ascontiguousarray(symbols.T)
    out = np.zeros((starts, m), bool)
    order = np.arange(m)  # rows by (group, suffix from the present column on)
    same_group = np.concatenate([[False], group[1:] == group[:-1]])
    base = group.astype(np.int64) << max(1, none.bit_length())
    prefix = np.zeros(m, np.int32)  # common prefix of a row in this order with the one before it
    places = np.arange(m)
    for t in range(columns - 1, -1, -1):
        s = symbols[t][order]
        key = base + s
        if (key[1:] >= key[:-1]).all():
            # The order stays; neighbours of one symbol share one more.
            same = same_group.copy()
            same[1:] &= (s[1:] == s[:-1]) & (s[1:] < none)
            prefix = np.where(same, prefix + 1, 0).astype(np.int32)
        else:
            moved = np.argsort(key, kind="stable")
            sm = s[moved]
            same = same_group.copy()
            same[1:] &= (sm[1:] == sm[:-1]) & (sm[1:] < none)
            # The common prefix of two rows is the least of all between them in the old order.
            new = np.zeros(m, np.int32)
            step = np.concatenate([[1], moved[1:] - moved[:-1]])
            near = same & (step == 1)
            new[near] = prefix[moved[near]] + 1
            far = np.flatnonzero(same & (step > 1))
            if len(far):
                bounds = np.stack([moved[far - 1] + 1, moved[far] + 1], axis=1).ravel()
                new[far] = np.minimum.reduceat(np.append(prefix, 0), bounds)[::2] + 1
            prefix, order = new, order[moved]
        if t < starts:
            hit = prefix >= width
            both = hit.copy()
            both[:-1] |= hit[1:]
            out[t, order[both[places]]] = True
    return out.T


def _spans(flags: np.ndarray, width: int) -> list[list[tuple[int, int]]]:
    """For each row the merged runs of columns (from, to) that its marked windows cover."""
    out = []
    for row in flags:
        starts = np.flatnonzero(row)
        if not len(starts):
            out.append([])
            continue
        cut = np.flatnonzero(starts[1:] - starts[:-1] > width) + 1
        out.append([(int(x[0]), int(x[-1]) + width) for x in np.split(starts, cut)])
    return out


def _construct(width: int, starts: int, batch_rows: int, unit: int):
    """Streams rows (grp, id, first, part, n) sorted by group, whole groups only, into runs (id, lo, hi) of columns."""
    kind, packed = np.uint8 if unit == BY_BYTES else np.uint64, _packer(["id", "lo", "hi"], (pa.binary(), pa.int32(), pa.int32()))

    def emit(grp: list, ids: list, first: list, part: list, n: list) -> pa.RecordBatch | None:
        change = [a != b for a, b in zip(grp[1:], grp[:-1], strict=True)]
        group, rows = np.cumsum([0, *change]), []
        size = np.bincount(group)[group]
        for i in np.flatnonzero(np.asarray(n) > 1).tolist():  # a fragment with a copy shares all its windows with it
            if len(part[i]) >= width * unit:
                rows.append((ids[i], first[i], first[i] + len(part[i]) // unit))
        several = np.flatnonzero(size > 1)
        if len(several):
            flags = repeated_windows(group[several], [np.frombuffer(part[i], kind) for i in several], np.asarray(first)[several], width, starts)
            rows += [(ids[i], a, b) for i, spans in zip(several.tolist(), _spans(flags, width), strict=True) if n[i] == 1 for a, b in spans]
        return packed(rows) if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        for batch in batches:
            for own, c in zip(held, ("grp", "id", "first", "part", "n"), strict=True):
                own += batch.column(c).to_pylist()
            if len(held[0]) >= batch_rows:
                last = held[0][-1]
                cut = len(held[0])
                while cut and held[0][cut - 1] == last:
                    cut -= 1
                if cut:
                    if (out := emit(*(c[:cut] for c in held))) is not None:
                        yield out
                    held = [c[cut:] for c in held]
        if held[0] and (out := emit(*held)) is not None:
            yield out

    return run


def _starts(first: int, size: int, j: int, step: int, width: int, reach: int) -> tuple[int, int]:
    """The first and last column, of step ``j``, in which a window of the fragment starts; last < first if none does."""
    return max(first, j * step), min(first + size - width, reach, (j + 1) * step - 1)


def _slices(width: int, k: int, step: int, unit: int):
    """Streams a row for each step of a fragment: hashes of all symbols of its windows, and of the core that each window of the step has."""
    reach, packed = width - k, _packer(["fid", "j", "slice", "core", "a", "b"], (pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c) for c in ("fid", "first", "part")]
            for i in range(batch.num_rows):
                f, first, part = (c[i].as_py() for c in columns)
                for j in range(reach // step + 1):
                    a, b = _starts(first, len(part) // unit, j, step, width, reach)
                    if a <= b:
                        core = part[(min((j + 1) * step - 1, reach) - first) * unit : (j * step + width - first) * unit]
                        rows.append((f, j, xxhash.xxh3_128_digest(part[(a - first) * unit : (b + width - first) * unit], seed=a), xxhash.xxh3_128_digest(core, seed=j), a, b))
                if len(rows) >= WINDOWS_OUT:
                    yield packed(rows)
                    rows = []
        if rows:
            yield packed(rows)

    return run


def _window_hashes(width: int, unit: int):
    """Streams a row for each window of a slice, in batches of bounded size; equal ``w`` means equal symbols in equal columns."""
    packed = _packer(["slice", "once", "lo", "w"], (pa.binary(), pa.bool_(), pa.int32(), pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c) for c in ("slice", "once", "a", "b", "part")]
            for i in range(batch.num_rows):
                x, once, a, b, part = (c[i].as_py() for c in columns)
                rows += [(x, once, c, xxhash.xxh3_128_digest(part[(c - a) * unit : (c - a + width) * unit], seed=c)) for c in range(a, b + 1)]
                if len(rows) >= WINDOWS_OUT:
                    yield packed(rows)
                    rows = []
        if rows:
            yield packed(rows)

    return run


def _divided(hot: DataFrame, width: int, k: int, step: int, unit: int, group_rows: int, batch_rows: int) -> DataFrame:
    """(fid, lo, hi) in columns, of the fragments of large groups (fid, first, part, n) with windows that another fragment has too.

    Starting columns are taken in steps. Fragments that agree in all symbols of a step share all its windows, and one whose core,
    the symbols that all windows of the step have, is its own shares none. Others meet by their core; only a core with over ``group_rows``
    different slices is counted window by window.
    """
    slices = materialize(hot.mapInArrow(_slices(width, k, step, unit), "fid binary, j int, slice binary, core binary, a int, b int"), "slices")
    per = materialize(slices.groupBy("slice").agg(F.first("core").alias("core"), F.min(F.struct("fid", "j", "a", "b")).alias("m"), (F.count("*") == 1).alias("once")).select("slice", "core", "once", "m.*"), "per-slice")
    cores = materialize(per.groupBy("core").count().where("count > 1"), "cores")
    cut = F.expr(f"substring(part, (a - first) * {unit} + 1, (b - a + {width}) * {unit})")
    some = per.join(cores, "core").join(hot.select("fid", "first", "part"), "fid").select("core", "slice", "once", "j", "a", "b", "count", cut.alias("part"))
    some = materialize(some, "some-slices")
    small = some.where(F.col("count") <= group_rows).select(F.col("core").alias("grp"), F.col("slice").alias("id"), (F.col("a") - F.col("j") * step).alias("first"), "part", F.when(F.col("once"), 1).otherwise(2).alias("n"))
    built = small.repartition("grp").sortWithinPartitions("grp", "id").mapInArrow(_construct(width, step, batch_rows, unit), "id binary, lo int, hi int")
    built = built.withColumnRenamed("id", "slice").join(per.select("slice", "j"), "slice").select("slice", (F.col("lo") + F.col("j") * step).alias("lo"), (F.col("hi") + F.col("j") * step).alias("hi"))
    windows = some.where(F.col("count") > group_rows).mapInArrow(_window_hashes(width, unit), "slice binary, once boolean, lo int, w binary")
    again = windows.groupBy("w").count().where("count > 1").select("w")
    counted = windows.where("once").select("slice", "lo", "w").join(again, "w").groupBy("slice").agg(F.min("lo").alias("lo"), (F.max("lo") + width).alias("hi"))
    shared = per.where("not once").select("slice", F.col("a").alias("lo"), (F.col("b") + width).alias("hi"))
    hits = materialize(shared.union(built).union(counted), "hits")
    # Windows of a fragment start less than ``width`` apart, so together they cover one run.
    out = materialize(slices.select("fid", "slice").join(hits, "slice").groupBy("fid").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "divided")
    for x in (slices, per, cores, some, hits):
        discard(x)
    return out


def byte_runs(raw: bytes, runs: list[list[int]]) -> list[list[int]]:
    """Runs of words as runs of bytes, each with the white space behind it."""
    starts = [m.start() for m in re.finditer(rb"\S+", raw)] + [len(raw)]
    return [[starts[a], starts[b]] for a, b in runs]


def _merge(with_text: bool, unit: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        tids, removed, spans, digest, kept_texts = [], [], [], [], []
        for tid, raw, los, his in zip(*(batch.column(c).to_pylist() for c in ("tid", "raw", "lo", "hi")), strict=True):
            runs: list[list[int]] = []
            for a, b in sorted(zip(los, his, strict=True)):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            kept, at = [], 0
            for a, b in runs if unit == BY_BYTES else byte_runs(raw, runs):
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            left = b"".join(kept)
            tids.append(tid)
            removed.append(len(raw) - len(left))
            spans.append(len(runs))
            digest.append(hashlib.sha256(left).hexdigest())
            if with_text:
                kept_texts.append(left.decode("utf-8", "ignore"))
        arrays = [pa.array(tids, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)]
        return pa.RecordBatch.from_arrays([*arrays, *([pa.array(kept_texts, pa.string())] if with_text else [])], names=["tid", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    return each_batch(run)


def text_id(raw: Column) -> Column:
    """The first 128 bits of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(raw, 256), 1, 32))


def repeated_passages(docs: DataFrame, width: int = WIDTH, k: int = KMER, group_rows: int = GROUP_ROWS, batch_rows: int = BATCH_ROWS, with_text: bool = False, unit: int = BY_BYTES) -> DataFrame:
    """A row for each *text* from which something goes: tid (``text_id``), n_removed (bytes), n_spans, kept_sha256 (and kept)."""
    reach = width - k
    raw = docs.select(F.col("text").cast("string").cast("binary").alias("raw")).where(F.octet_length("raw") >= (width if unit == BY_BYTES else 2 * width - 1)).withColumn("tid", text_id(F.col("raw")))
    texts = materialize(raw.groupBy("tid").agg(F.first("raw").alias("raw"), (F.count("*") > 1).alias("copied")).withColumn("no", F.monotonically_increasing_id()), "texts")
    found = materialize(texts.select("no", "raw").mapInArrow(_anchor_batch(width, k, unit), "no long, pos int, anchor long"), "anchors")
    # Written, so that both sides of the join are shuffled for it and a frequent anchor can be split.
    shared = materialize(found.groupBy("anchor").count().where("count > 1").select("anchor"), "shared")
    marked = materialize(found.join(shared, "anchor").groupBy("no").agg(F.collect_list("pos").alias("pos"), F.collect_list("anchor").alias("anchor")), "marked")
    discard(found)
    discard(shared)
    # Texts with a shared anchor; only these are cut into fragments and, unless they go wholly, spliced in the end.
    maybe = materialize(texts.select("no", "tid", "raw", "copied").join(marked, "no"), "maybe")
    discard(marked)
    fragments = materialize(maybe.select("no", "raw", "pos", "anchor").mapInArrow(_fragment_batch(width, k, unit), "no long, pos int, anchor long, first int, fid binary, part binary"), "fragments")
    kinds = materialize(fragments.groupBy("anchor", "fid").agg(F.first("first").alias("first"), F.first("part").alias("part"), F.count("*").alias("n")), "kinds")
    places = materialize(fragments.select("no", "pos", "fid"), "places")
    discard(fragments)
    large = materialize(kinds.groupBy("anchor").count().where(F.col("count") > group_rows).select("anchor"), "large")
    usual = kinds.join(large, "anchor", "left_anti").select(F.col("anchor").alias("grp"), F.col("fid").alias("id"), "first", "part", "n")
    built = usual.repartition("grp").sortWithinPartitions("grp", "id").mapInArrow(_construct(width, reach + 1, batch_rows, unit), "id binary, lo int, hi int").withColumnRenamed("id", "fid")
    if not large.isEmpty():
        hot = materialize(kinds.join(large, "anchor", "left_semi").select("fid", "first", "part", "n").repartition("fid"), "hot")
        copied = hot.where((F.col("n") > 1) & (F.octet_length("part") >= width * unit)).select("fid", F.col("first").alias("lo"), (F.octet_length("part") / unit + F.col("first")).cast("int").alias("hi"))
        built = built.union(_divided(hot, width, k, max(1, reach // STEPS), unit, group_rows, batch_rows)).union(copied)
    covered = materialize(built, "covered")
    discard(kinds)
    spans = places.join(covered, "fid").select("no", (F.col("pos") + F.col("lo") - reach).alias("lo"), (F.col("pos") + F.col("hi") - reach).alias("hi"))
    by_text = spans.groupBy("no").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    long_enough = F.lit(True) if unit == BY_BYTES else F.size(F.split(F.trim(F.col("raw").cast("string"), F.lit("\t\n\x0b\f\r ")), "[\t\n\x0b\f\r ]+")) >= width
    whole = F.col("copied") & long_enough
    some = maybe.where(~whole).select("no", "tid", "raw").join(by_text, "no")
    kept = [F.lit("").alias("kept")] if with_text else []
    gone = texts.where(whole).select("tid", F.octet_length("raw").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"), *kept)
    schema = "tid binary, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if with_text else "")
    return gone.union(some.select("tid", "raw", "lo", "hi").mapInArrow(_merge(with_text, unit), schema))


def op5(docs: DataFrame) -> DataFrame:
    cut = repeated_passages(docs)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw")).select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("sha"))
    keyed = rows.withColumn("tid", F.unhex(F.substring("sha", 1, 32)))
    return keyed.join(cut, "tid", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
