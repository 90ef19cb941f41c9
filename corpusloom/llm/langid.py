"""Language identification: nearest centroid over normalised TF-IDF vectors of character n-grams.

Texts are lower-cased and each run of characters that aren't letters becomes one blank; n-grams of 1 to 3 characters are hashed into ``DIMS``
features, weighted 1 + ln(count) times the inverse document frequency, and normalised. Training uses a bounded sample: at most
about ``TRAIN_PER_LANG`` distinct texts a language, chosen by a hash of the id. Each language gets ``CENTROIDS`` centroids by spherical
k-means. A text has the language of the centroid with the largest cosine; its score is that cosine mapped to 0..1 against
the best centroid of another language; a text farther from its centroid than ``REJECT`` of the language's training texts is marked rejected.

Defined results: a null text or one without letters is ``und`` with score 0; so is every text if nothing could be learned; rows with a null lang don't
train; ties go to the language first in order; repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_batch, text_list

DIMS, CENTROIDS, TRAIN_PER_LANG, REJECT, ROUNDS = 4096, 4, 400, 0.01, 12
UND = "und"
LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def counts(text: str, dims: int = DIMS) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text."""
    c = np.frombuffer((" " + OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "replace"), np.uint32)
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    one = c * _MIX[0]
    out = np.bincount(one >> shift, minlength=dims)
    if len(c) > 1:
        two = (one[:-1] ^ (c[1:] + np.uint32(97))) * _MIX[1]
        two ^= two >> np.uint32(13)
        out += np.bincount((two * _MIX[2]) >> shift, minlength=dims)
        if len(c) > 2:
            three = (two[:-1] ^ (c[2:] + np.uint32(389))) * _MIX[2]
            three ^= three >> np.uint32(15)
            out += np.bincount((three * _MIX[0]) >> shift, minlength=dims)
    return out


def vectors(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF of rows of counts."""
    rows = rows.astype(np.float32)
    rows = np.where(rows > 0, 1 + np.log(np.maximum(rows, 1)), 0) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows, sorted by language
    owner: np.ndarray  # a centroid's language
    floor: np.ndarray  # by language: cosines under it are rejected

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [(UND, 0.0, True)] * len(texts)
        good = [i for i, t in enumerate(texts) if LETTER.search(t)] if self.languages else []
        for lo in range(0, len(good), 128):
            part = good[lo : lo + 128]
            cosines = vectors(np.stack([counts(texts[i], len(self.idf)) for i in part]), self.idf) @ self.centroids.T
            by = np.stack([cosines[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)
            best = by.argmax(axis=1)
            top = by[np.arange(len(part)), best]
            rest = by.copy()
            rest[np.arange(len(part)), best] = 0
            score = np.clip(0.5 + 0.5 * (top - rest.max(axis=1)) / np.maximum(top, 1e-9), 0, 1)
            for i, k, s, c in zip(part, best.tolist(), score.tolist(), top.tolist(), strict=True):
                out[i] = (self.languages[k], s, c < self.floor[k])
        return out


def clustered(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from rows far from each other."""
    k = min(k, len(rows))
    chosen = [int((rows @ rows.mean(axis=0)).argmax())]
    while len(chosen) < k:
        chosen.append(int((rows @ rows[chosen].T).max(axis=1).argmin()))
    centre = rows[chosen]
    for _ in range(ROUNDS):
        near = (rows @ centre.T).argmax(axis=1)
        centre = np.stack([rows[near == j].mean(axis=0) if (near == j).any() else centre[j] for j in range(k)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return centre


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, k: int = CENTROIDS, dims: int = DIMS) -> LanguageModel:
    usable = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return LanguageModel([], np.ones(dims, np.float32), np.zeros((0, dims), np.float32), np.zeros(0, int), np.zeros(0))
    ticket = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(10_000_000))
    enough = F.lit(False)
    for lang, n in sizes.items():
        enough = enough | ((F.col("lang") == lang) & (ticket < min(10_000_000, int(10_000_000 * per_lang / n) + 1)))

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [zlib.compress(counts(t, dims).astype("<u4").tobytes(), 1) for t in text_list(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(packed, pa.binary())], names=["lang", "packed"])

    # Whole texts become vectors on the executors; about per_lang of them a language come to the driver.
    chosen = usable.where(enough).where(F.col("text").rlike(r"\p{L}")).select("lang", "text")
    sample = chosen.mapInArrow(each_batch(counted), "lang string, packed binary").distinct().collect()
    sample.sort(key=lambda r: (r["lang"], r["packed"]))
    if not sample:
        return LanguageModel([], np.ones(dims, np.float32), np.zeros((0, dims), np.float32), np.zeros(0, int), np.zeros(0))
    raw = np.stack([np.frombuffer(zlib.decompress(r["packed"]), "<u4") for r in sample])
    of = np.array([r["lang"] for r in sample])
    idf = (np.log((1 + len(sample)) / (1 + (raw > 0).sum(axis=0))) + 1).astype(np.float32)
    languages = sorted({r["lang"] for r in sample})
    centroids, owner, floor = [], [], []
    for j, lang in enumerate(languages):
        rows = vectors(raw[of == lang], idf)
        centre = clustered(rows, k)
        centroids.append(centre)
        owner += [j] * len(centre)
        floor.append(float(np.quantile((rows @ centre.T).max(axis=1), REJECT)))
    return LanguageModel(languages, idf, np.concatenate(centroids).astype(np.float32), np.array(owner), np.array(floor))


def predict_table(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = model.predict(text_list(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found]), pa.array([float(x[1]) for x in found], pa.float64()), pa.array([bool(x[2]) for x in found])], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(each_batch(run), "doc_id long, lang_pred string, score double, rejected boolean")


def op10(docs: DataFrame) -> DataFrame:
    return predict_table(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
