"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

Training (a bounded sample of labelled rows, ``TRAIN_ROWS`` at most, chosen by a hash of the id): the toxic and the clean texts that hold a
token are counted, and its log-odds get an informative Dirichlet prior from the counts of both together; so are the beginnings
(``PREFIX`` letters) of longer tokens. Those whose log-odds stand ``Z`` deviations or more above zero form the lexicon, where a beginning
stands for tokens that aren't in it themselves; all others share one score, the log-odds of their pooled counts,
which is below zero. The extreme-value parameters follow from the clean texts: lambda solves
sum p(s) exp(lambda s) = 1 over their token scores, and K is fitted to their best segments.

Scoring: one linear scan finds all maximal scoring segments of a text; those whose expected number by chance is under
``EXPECT`` are passages, and their normalised scores (lambda S - ln K n) are summed. A logistic curve, fitted to the
training rows' sums in ``BINS`` bins up to ``BIN_TOP`` (larger sums count in the last one), turns the sum into a probability. Sums aren't cut
when texts are scored.

Defined results: a null or empty text has no segment and gets the base rate; rows with a null label don't train, and several
labels of one id count as toxic if one is; without both classes every score is 0; repeated rows score alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_batch, materialize, text_list

#: At most so many labelled rows are expected in the training sample.
TRAIN_ROWS = 20_000
MIN_DOCS, Z, EXPECT, THRESHOLD = 4, 3.0, 0.5, 0.3
#: Longer tokens count by their beginning too; a token outside of the lexicon has the score of its beginning.
PREFIX = 6
BINS, BIN_TOP = 400, 100.0

TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def beginning(token: str) -> str | None:
    return token[:PREFIX] + "*" if len(token) > PREFIX else None


def maximal_segments(at: list[int], gain: list[float], length: int, drift: float) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal scoring segments of a sequence of ``length`` scores.

    Only the scores at ``at`` (ascending) are given, in ``gain``; every other one is ``drift`` < 0. A linear scan that keeps the
    candidate segments with their left and right cumulative sums (Ruzzo and Tompa's algorithm). Each candidate knows the last one before it with a lower left sum, so
    that a search goes over none twice; when no candidate has a lower left sum, all of them are final.
    """
    final: list[tuple[int, int, float]] = []
    first, last, low, high, lower = [], [], [], [], []  # of the candidates; lower: the place of the last one with a lower left sum, or -1
    total, done = 0.0, 0
    for i, g in zip(at, gain, strict=True):
        before = total + drift * (i - done)
        total, done = before + g, i + 1
        if g <= 0:
            continue
        begin, left, j = i, before, len(low) - 1
        while True:
            while j >= 0 and low[j] >= left:
                j = lower[j]
            if j < 0:
                final += [(a, b, r - s) for a, b, s, r in zip(first, last, low, high, strict=True)]
                for column in (first, last, low, high, lower):
                    column.clear()
                break
            if high[j] >= total:
                break
            begin, left, cut, j = first[j], low[j], j, lower[j]
            for column in (first, last, low, high, lower):
                del column[cut:]
        for column, value in ((first, begin), (last, i), (low, left), (high, total), (lower, j)):
            column.append(value)
    return final + [(a, b, r - s) for a, b, s, r in zip(first, last, low, high, strict=True)]


@dataclass
class ToxicityModel:
    """What training learned; as small as the lexicon of the training sample."""

    score: dict[str, float]
    drift: float
    lam: float
    k: float
    offset: float
    slope: float
    trained: bool = True

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(first token, last token, score) of all maximal scoring segments."""
        get = self.score.get
        found = [(i, s) for i, w in enumerate(words) if (s := get(w) or (get(beginning(w)) if len(w) > PREFIX else None))]
        return maximal_segments(*zip(*found, strict=True), len(words), self.drift) if found else []

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """(first token, last token, normalised score) of the significant segments."""
        words = tokens(text)
        floor = math.log(max(self.k * len(words), 1e-9))
        return [(a, b, self.lam * s - floor) for a, b, s in self.segments(words) if floor - self.lam * s < math.log(EXPECT)]

    def evidence(self, text: str) -> float:
        return sum(s for _, _, s in self.passages(text))

    def probability(self, evidence: float) -> float:
        z = self.offset + self.slope * evidence
        return 0.0 if not self.trained else 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def extreme_value_lambda(scores: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1; needs a negative mean and a positive score."""
    p = weight / weight.sum()
    lo, hi = 0.0, 1.0
    while (p * np.exp(hi * scores)).sum() < 1 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * scores)).sum() < 1 else (lo, mid)
    return (lo + hi) / 2


def fit_logistic(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Offset and slope by Newton steps on binned counts; a step is halved until the penalised likelihood, which is concave, grows."""
    scale = max(1.0, float(np.abs(x).max(initial=1.0)))
    design = np.stack([np.ones_like(x), x / scale], axis=1)
    n = toxic + clean

    def gain(w: np.ndarray) -> float:
        z = design @ w
        return float((toxic * z - n * np.logaddexp(0, z)).sum() - ridge / 2 * (w * w).sum())

    w, now = np.zeros(2), gain(np.zeros(2))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        grad = design.T @ (toxic - n * p) - ridge * w
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), grad)
        while np.abs(step).max() > 1e-9 and gain(w + step) < now:
            step = step / 2
        if np.abs(step).max() <= 1e-9:
            break
        w = w + step
        now = gain(w)
    return float(w[0]), float(w[1] / scale)


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """Distinct (text, toxic) of the labelled rows that may train, by a hash of the id down to about ``most``."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = usable.count()
    share = min(1.0, most / max(n, 1))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by `most`
    return rows.where(F.length("text") > 0).groupBy(F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> ToxicityModel:
    rows = materialize(training_rows(docs, labels, most), "toxicity-train")

    def holders(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Texts of the batch that hold a token, by class."""
        seen = (Counter(), Counter())
        for text, toxic in zip(text_list(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
            own = set(tokens(text))
            seen[toxic != 1].update(own | ({beginning(w) for w in own} - {None}))
        names = list(seen[0] | seen[1])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in seen)], names=["token", "t", "c"])

    counted = rows.mapInArrow(each_batch(holders), "token string, t long, c long").groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counted = materialize(counted, "toxicity-tokens")
    n_t, n_c = counted.where("not endswith(token, '*')").agg(F.sum("t"), F.sum("c")).first()
    if not n_t or not n_c:
        return ToxicityModel({}, -1.0, 1.0, 1.0, 0.0, 0.0, trained=False)
    # The prior has the common distribution and weighs as much as the smaller class.
    mass = float(min(n_t, n_c))
    prior = (F.col("t") + F.col("c")) * (mass / (n_t + n_c))
    log_t = F.log((F.col("t") + prior) / (n_t + mass - F.col("t") - prior))
    log_c = F.log((F.col("c") + prior) / (n_c + mass - F.col("c") - prior))
    scored = counted.where(F.col("t") + F.col("c") >= MIN_DOCS).withColumn("s", log_t - log_c).withColumn("z", F.col("s") / F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior)))
    kept = scored.where(F.col("z") >= Z).orderBy(F.desc("z"), "token").collect()  # tokens of the training sample, which is bounded
    score = {r["token"]: float(r["s"]) for r in kept}
    whole = [r for r in kept if not r["token"].endswith("*")]
    in_t, in_c = sum(r["t"] for r in whole), sum(r["c"] for r in whole)
    drift = min(-1e-3, math.log(max(n_t - in_t, 1) / (n_t + 1)) - math.log(max(n_c - in_c, 1) / (n_c + 1)))
    # Chance segments, from the clean texts: tokens of the lexicon and all others.
    values = np.array([score[r["token"]] for r in kept] + [drift])
    weight = np.array([float(r["c"]) + 0.5 for r in kept] + [float(n_c - in_c)])
    if (values * weight).sum() >= 0:
        drift = -2 * (values[:-1] * weight[:-1]).sum() / weight[-1]
        values[-1] = drift
    lam = extreme_value_lambda(values, weight) if score else 1.0
    model = ToxicityModel(score, drift, lam, 1.0, 0.0, 0.0)

    def best(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in text_list(batch.column("text")):
            words = tokens(text)
            out.append((math.log(max(len(words), 1)), max((s for _, _, s in model.segments(words)), default=0.0)))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*out, strict=True)], names=["ln_n", "top"])

    # E[lambda M] = ln(K n) + Euler's constant over the clean texts that have a segment at all.
    mean = rows.where("toxic = 0").select("text").mapInArrow(each_batch(best), "ln_n double, top double").where("top > 0").agg(F.avg(F.col("top") * lam - F.col("ln_n"))).first()[0]
    model.k = math.exp(min(0.0, (mean if mean is not None else 0.0) - 0.5772156649))

    def binned(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [int(min(BINS - 1, model.evidence(t) * BINS / BIN_TOP)) for t in text_list(batch.column("text"))]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), batch.column("toxic")], names=["bin", "toxic"])

    counts = np.zeros((2, BINS))
    for r in rows.select("text", "toxic").mapInArrow(each_batch(binned), "bin int, toxic int").groupBy("bin", "toxic").count().collect():  # at most 2 x BINS rows
        counts[int(r["toxic"] == 1), r["bin"]] += r["count"]
    x = (np.arange(BINS) + 0.5) * BIN_TOP / BINS
    x[0] = 0.0
    model.offset, model.slope = fit_logistic(x, counts[1], counts[0])
    return model


def score_table(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted, n_passages, evidence of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, passages, sums = [], [], []
        for text in text_list(batch.column("text")):
            found = model.passages(text)
            e = sum(s for _, _, s in found)
            scores.append(model.probability(e))
            passages.append(len(found))
            sums.append(e)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(passages, pa.int32()), pa.array(sums, pa.float64())], names=["doc_id", "score", "predicted", "n_passages", "evidence"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(each_batch(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int, n_passages int, evidence double")


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_table(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages", "evidence")
