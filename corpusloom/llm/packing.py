"""Sequence packing by non-negative least squares over a length histogram.

Documents become token ids and are cut into pieces of at most ``window`` ids. From the histogram of piece lengths (at
most ``window`` numbers, whatever the corpus) the driver makes a plan: shallow combinations of lengths that fill a window
are enumerated, their repeat counts are the non-negative least-squares solution against the histogram, rounded down to
what the histogram can supply; what is left is packed greedily, longest first into the fullest window that still holds it. The
plan says for each length which ranks go to which window, so pieces find their place by a rank within their length and
nothing but the histogram and the plan passes through the driver.

Defined results: a null text is an empty one and has only the end id; repeated rows are packed once each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_batch, materialize, text_list

WINDOW = 2048
MEMO = 1_000_000
#: Rows that share one task when ranks are counted.
BUCKET_ROWS = 100_000
#: A blank between blanks, or a final one after a blank: there, words don't part at each blank.
UNEVEN = re.compile(r"\s (?:\s|\Z)")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordEncoder:
    """Ids of a byte-level BPE tokenizer, with a bounded memo of words.

    Its pattern parts a text before each single blank that no white space surrounds, so a blank with the word behind it is
    encoded alone; texts with other runs of blanks, or with a special token's string, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        #: Bytes that an id stands for; this kind of vocabulary writes each byte as one character.
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)
        #: Ids by word: of a text's first, and of one behind a blank.
        self.first: dict[str, bytes] = {}
        self.memo: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Of words behind blanks: many in one call, parted again by the bytes that each id stands for."""
        out: list[bytes] = []
        for lo in range(0, len(words), 2000):
            own = [" " + w for w in words[lo : lo + 2000]]
            if UNEVEN.search(text := "".join(own)) or any(s in text for s in self.special):
                out += self._ids(own)
                continue
            ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(w.encode()) for w in own]), side="left") + 1
            coded = ids.tobytes()
            out += [coded[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return out

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id."""
        end = int(end_id).to_bytes(4, "little")
        out: list[bytes | None] = [None] * len(texts)
        whole, split, heads, tails = [], [], set(), set()
        for k, text in enumerate(texts):
            if UNEVEN.search(text) or any(s in text for s in self.special):
                whole.append(k)
                continue
            head, *words = text.split(" ")
            split.append((k, head, words))
            if head not in self.first:
                heads.add(head)
            tails |= set(words).difference(self.memo)
        new = ((self.first, list(heads), self._ids), (self.memo, list(tails), self._word_ids))
        for memo, found, ids in new:
            memo.update(zip(found, ids(found), strict=True))
        of = self.memo.__getitem__
        for k, head, words in split:
            out[k] = b"".join([self.first[head], *map(of, words), end])
        for memo, found, _ in new:
            if len(memo) > MEMO:  # full: the words of this call go again
                for w in found:
                    del memo[w]
        for k, coded in zip(whole, self._ids([texts[k] for k in whole]), strict=True):
            out[k] = coded + end
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """The pieces of each document, cut at multiples of ``window``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        ids, texts = batch.column("doc_id").to_pylist(), text_list(batch.column("text"))
        for lo in range(0, len(texts), 256):
            for doc, coded in zip(ids[lo : lo + 256], encoder(tokenizer_file).encode(texts[lo : lo + 256], end_id), strict=True):
                n = len(coded) // 4
                for at in range(0, n, window):
                    part = coded[4 * at : 4 * (at + window)]
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), n))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(each_batch(run), PIECES)


def shallow_combinations(present: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Combinations of up to three present lengths, repeats allowed, that fill the window: all pairs, and those triples
    whose two larger parts lie on a grid of a sixteenth of the window."""
    have = set(present.tolist())
    out: list[tuple[int, ...]] = [(n,) for n in have if n == window]
    out += [(n, window - n) for n in have if 2 * n >= window and window - n in have]
    step = max(1, window // 16)
    grid = [min((n for n in have if k <= n < k + step), default=0) for k in range(step, window, step)]
    for i, a in enumerate(grid):
        for b in grid[: i + 1]:
            c = window - a - b
            if a and b and 0 < c <= b and c in have:
                out.append((a, b, c))
    return sorted(set(out), reverse=True)


def nnls(columns: list[tuple[int, ...]], target: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Non-negative least squares by coordinate descent; a column counts how often it has each length."""
    x = np.zeros(len(columns))
    rest = target.astype(float).copy()
    parts = [np.unique(c, return_counts=True) for c in columns]
    norms = [float((n * n).sum()) for _, n in parts]
    scale = max(1.0, float(target.max(initial=0)))
    for _ in range(sweeps):
        most = 0.0
        for j, (at, n) in enumerate(parts):
            new = max(0.0, x[j] + float((n * rest[at]).sum()) / norms[j])
            if new != x[j]:
                rest[at] -= n * (new - x[j])
                most = max(most, abs(new - x[j]))
                x[j] = new
        if most < 1e-6 * scale:
            break
    return x


def greedy(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: each step places as many equal pieces as there are equal windows."""
    open_by: dict[int, list[list]] = {}
    for n in range(window, 0, -1):
        count = int(left[n])
        while count:
            room = next((r for r in range(n, window) if open_by.get(r)), None)
            if room is None:
                each = min(window // n, count)
                made = count // each
                kind, count = (n,) * each, count - made * each
            else:
                kind, made = open_by[room].pop()
                take = min(made, count)
                if made > take:
                    open_by[room].append([kind, made - take])
                kind, made, count = (*kind, n), take, count - take
            open_by.setdefault(window - sum(kind), []).append([kind, made])
    return [(tuple(kind), made) for kinds in open_by.values() for kind, made in kinds]


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, number of windows) that use every piece of the histogram exactly once."""
    left = histogram.astype(np.int64).copy()
    columns = shallow_combinations(np.flatnonzero(left), window)
    out = []
    if columns:
        x = nnls(columns, left)
        for j in np.argsort(-x, kind="stable"):
            need, n = np.unique(columns[j], return_counts=True)
            times = int(min(np.floor(x[j] + 1e-9), (left[need] // n).min()))
            if times > 0:
                left[need] -= n * times
                out.append((columns[j], times))
    return out + greedy(left, window)


def padded_length(filled: int, window: int) -> int:
    """A window's length after padding: none where the filled part is a power of two."""
    return filled if filled & (filled - 1) == 0 else window


def pack(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """Each piece with its sequence, its offset there and the sequence's padded length."""
    rows = materialize(pieces(docs, tokenizer_file, window, end_id), "pieces")
    histogram = np.zeros(window + 1, np.int64)
    total = 0
    for r in rows.groupBy("length").count().collect():  # at most `window` rows
        histogram[r["length"]] = r["count"]
        total += r["count"]
    made = plan(histogram, window)
    # A slot takes the ranks low..low+times-1 of its length; the k-th of them goes to the combination's k-th window.
    used = np.zeros(window + 1, np.int64)
    slots, base = [], 0
    for kind, times in made:
        at = 0
        for n in kind:
            slots.append((n, int(used[n]), base, at, padded_length(sum(kind), window)))
            used[n] += times
            at += n
        base += times
    slots.sort()
    by = np.array(slots, np.int64).reshape(-1, 5)
    keys = by[:, 0] << 44 | by[:, 1]

    # Ranks within a length: places in a bucket, after the rows of the buckets before it.
    buckets = max(1, -(-total // BUCKET_ROWS))
    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "bucket").count()
    before = sizes.select("length", "bucket", (F.expr("sum(count) over (partition by length order by bucket)") - F.col("count")).alias("before"))
    ranked = keyed.withColumn("own", F.expr("row_number() over (partition by length, bucket order by doc_id, start, ids_crc32)")).join(before, ["length", "bucket"]).withColumn("rank", F.col("own") - 1 + F.col("before"))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
        found = by[at]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(found[:, 2] + rank - found[:, 1]), pa.array(found[:, 3]), pa.array(found[:, 4])], names=[*PIECES.replace(" long", "").split(", "), "sequence_id", "offset", "padded_length"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("rank").cast("long")).mapInArrow(each_batch(place), PIECES + ", sequence_id long, offset long, padded_length long")
