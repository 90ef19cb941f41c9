"""Exact search of the highest inner products by a pivot-distance index.

One more component, sqrt(M^2 - |x|^2) with M the greatest norm, gives all vectors one norm, so that the highest inner products of a query are the
least distances: d(q, x)^2 = |q|^2 + M^2 - 2 q.x. Each vector is keyed by its nearest pivot and the distance to it; sorted by that key,
the rows are cut into *annuli* (blocks of rows with one pivot and distances from ``lo`` to ``hi``), written as a table. By the triangle inequality no row
of an annulus is nearer to q than max(lo - d(q, pivot), d(q, pivot) - hi). A query's own annulus, its first step, gives a kth score to begin with;
annuli that the bound excludes for a whole group of queries never meet it, and the others are visited by rising bound until it
exceeds the kth distance of every query. The search is exact: bounds only skip what can't come in, and rounding has a margin.

The pivots are centres of ``SAMPLE`` rows chosen by a hash (k-means); they change the speed, not the result. Every row is indexed, and a hot pivot has more annuli.

Defined results: vectors that are null or hold null, infinite or undefined components take no part; a shorter vector counts as followed by zeros; repeated rows
are rows of their own, as queries and as candidates; of ties the smaller vec_id comes first, a null vec_id last and never as a query; an
empty table gives an empty result; other columns are ignored. Scores are exact up to 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .vectors import BLOCK_ROWS, CHUNK, GROUP_ROWS, Best, id_keys, id_or_null, integer_vectors, matrix, packed, ranked, searched, unpacked, without_own

SCALE, EVERY, TOP = 256, 50, 5
#: The index is fitted on so many rows at most, to so many pivots.
SAMPLE, PIVOTS, ROUNDS = 4096, 64, 8
#: Margin of rounding, as a share of M: far above the error of a distance, far below a difference that matters.
MARGIN = 4e-6

INDEX = "block long, pivot int, lo double, hi double, n int, ids binary, rows binary, x binary, own binary, kth binary"
FOUND = "query_row long, query_id long, vec_id long, row_no long, score double"


def centres(points: np.ndarray, k: int) -> np.ndarray:
    """k-means on the sample, begun at its farthest points."""
    at = [0]
    far = ((points - points[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        at.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[at[-1]]) ** 2).sum(axis=1))
    out = points[at].copy()
    for _ in range(ROUNDS):
        own = ((out**2).sum(axis=1) - 2 * points @ out.T).argmin(axis=1)
        for j in np.unique(own):
            out[j] = points[own == j].mean(axis=0)
    return out


class Space:
    """The vectors with their further component, and the pivots."""

    def __init__(self, pivots: np.ndarray, norm2: float, width: int) -> None:
        self.pivots, self.norm2, self.width = pivots, norm2, width
        self.margin = MARGIN * float(np.sqrt(norm2)) + 1e-9

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0.0))[:, None]])

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Of points with the further component (of a query it is 0) to all pivots."""
        square = (points * points).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(square, 0.0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return self.distances(np.hstack([q, np.zeros((len(q), 1))]))

    def radius(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """The distance of the kth score; infinite where there is none yet."""
        return np.sqrt(np.maximum((q * q).sum(axis=1) + self.norm2 - 2 * kth, 0.0)) + self.margin


def annuli(space: Space, every: int, top: int):
    """For sorted rows: cuts them where the pivot changes or a block is full; queries get the kth score within their own block."""

    def block(number: int, pivot: int, rows: list[tuple]) -> tuple:
        ids, own, x, r = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.lexsort((own, ids))
        ids, own, x = ids[order], own[order], x[order]
        at = np.flatnonzero((ids % every == 0) & (ids != np.iinfo(np.int64).max))
        best = Best(len(at), top)
        for i in range(0, len(at), CHUNK):
            part = at[i : i + CHUNK]
            best.add(np.arange(i, i + len(part)), without_own(x[part] @ x.T, own[part], own), ids, own)
        return number, pivot, float(r.min()), float(r.max()), len(ids), packed(ids, np.int64), packed(own, np.int64), packed(x), packed(at, np.int32), packed(best.least())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now, held, n = TaskContext.get().partitionId() << 32, None, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip((f.split()[0] for f in INDEX.split(", ")), block(number, now, held), strict=True))], schema=INDEX_ARROW)

        for batch in batches:
            pivot = batch.column("pivot").to_numpy()
            ids, own, x, r = id_keys(batch.column("vec_id")), batch.column("row_no").to_numpy(), matrix(batch.column("x"), space.width), batch.column("r").to_numpy()
            begin = 0
            while begin < len(pivot):
                if held and (pivot[begin] != now or n == BLOCK_ROWS):
                    yield out()
                    number, held, n = number + 1, [], 0
                now = int(pivot[begin])
                end = min(int(np.searchsorted(pivot, now, "right")), begin + BLOCK_ROWS - n)
                held.append((ids[begin:end], own[begin:end], x[begin:end], r[begin:end]))
                begin, n = end, n + end - begin
        if held:
            yield out()

    return run


INDEX_ARROW = pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("x", pa.binary()), ("own", pa.binary()), ("kth", pa.binary())])


def expand(space: Space, q: np.ndarray, own: np.ndarray, kth: np.ndarray, blocks: list[tuple], top: int) -> tuple[Best, int]:
    """The best of ``blocks`` (order, pivot, lo, hi, ids, rows, x) for each query, and how many blocks were compared at all."""
    best, d, square, seen = Best(len(q), top, kth), space.of_queries(q), (q * q).sum(axis=1), 0
    for order, pivot, lo, hi, ids, rows, x in sorted(blocks, key=lambda b: b[0]):
        least = best.least()
        radius = space.radius(q, least)
        if order > radius.max(initial=0.0):
            break  # this annulus and all further ones are too far for every query
        gap = np.maximum(np.maximum(lo - d[:, pivot], d[:, pivot] - hi), 0.0)
        at = np.flatnonzero(gap <= radius)
        seen += bool(len(at))
        for i in range(0, len(at), CHUNK):
            part = at[i : i + CHUNK]
            best.add(part, without_own(q[part] @ x.T, own[part], rows), ids, rows)
    return best, seen


def build(vectors: DataFrame, every: int = EVERY, top: int = TOP) -> tuple[DataFrame, Space] | None:
    """The index over all rows (row_no, vec_id, x) as a table of annuli, and its space; None for no rows."""
    square = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    n, width, norm2 = vectors.agg(F.count("*"), F.max(F.size("x")), F.max(square)).first()
    if not n:
        return None
    sample = vectors.select("x", F.xxhash64("vec_id", "row_no").alias("h")).orderBy("h").limit(SAMPLE).select("x").toArrow()
    space = Space(np.zeros((1, width + 1)), norm2, width)
    points = space.lifted(np.vstack([matrix(c, width) for c in sample.column("x").chunks]))
    space.pivots = centres(points, max(1, min(PIVOTS, len(points) // 16)))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = space.distances(space.lifted(matrix(batch.column("x"), width)))
                pivot = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("row_no"), batch.column("vec_id"), batch.column("x"), pa.array(pivot, pa.int32()), pa.array(d[np.arange(len(d)), pivot])], names=["row_no", "vec_id", "x", "pivot", "r"])

    keyed = vectors.select("row_no", "vec_id", "x").mapInArrow(key, "row_no long, vec_id long, x array<double>, pivot int, r double")
    order = ["pivot", "r", "row_no"]
    return materialize(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(annuli(space, every, top), INDEX), "annuli"), space


def top_k(embeddings: DataFrame, every: int = EVERY, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the ``top`` highest inner products of each query (rows whose vec_id is divisible by ``every``) with all other rows."""
    spark = embeddings.sparkSession
    vectors = materialize(integer_vectors(embeddings, scale), "vectors")
    built = build(vectors, every, top)
    discard(vectors)
    if built is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index, space = built
    width, pivots = space.width, len(space.pivots)
    last, n_queries = index.agg(F.max("block"), F.sum(F.octet_length("own") / 4)).first()
    ranges, groups = (last >> 32) + 1, max(1, -(-int(n_queries) // GROUP_ROWS))
    # Neighbouring blocks give their queries to one group; a range of more queries than a group should hold makes several.
    each = -(-groups // ranges)
    group = F.when(F.lit(groups >= ranges), F.shiftright("block", 32) * each + F.col("block") % each).otherwise(F.expr(f"shiftright(block, 32) * {groups} div {ranges}"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of each block, with the distances to all pivots and the radius they need."""
        for batch in batches:
            for b in batch.to_pylist():
                at = unpacked(b["own"], np.int32)
                q = unpacked(b["x"]).reshape(b["n"], width)[at]
                d, kth = space.of_queries(q), unpacked(b["kth"])
                yield pa.RecordBatch.from_pylist([{"group": b["group"], "q_ids": packed(unpacked(b["ids"], np.int64)[at], np.int64), "q_rows": packed(unpacked(b["rows"], np.int64)[at], np.int64), "q": packed(q), "q_kth": b["kth"], "near": d.min(axis=0).tolist(), "far": d.max(axis=0).tolist(), "radius": float(space.radius(q, kth).max())}], schema=PARTS_ARROW)

    with_queries = index.where(F.octet_length("own") > 0).select(group.cast("long").alias("group"), "n", "ids", "rows", "x", "own", "kth")
    queries = materialize(with_queries.mapInArrow(parts, PARTS), "queries")
    reach = queries.select("group", "radius", F.posexplode(F.arrays_zip("near", "far")).alias("pivot", "d")).groupBy("group", "pivot").agg(F.min("d.near").alias("near"), F.max("d.far").alias("far"), F.max("radius").alias("radius"))
    gap = F.greatest(F.col("lo") - F.col("far"), F.col("near") - F.col("hi"), F.lit(0.0))
    pairs = reach.join(index.select("block", "pivot", "lo", "hi", "n"), "pivot").select("group", "block", "n", gap.alias("order"), "radius").where("order <= radius").drop("radius")

    def search(group: pa.Table, blocks: pa.Table) -> pa.Table:
        held = group.to_pylist()
        q = np.concatenate([unpacked(p["q"]) for p in held]).reshape(-1, width)
        ids, own = (np.concatenate([unpacked(p[c], np.int64) for p in held]) for c in ("q_ids", "q_rows"))
        kth = np.concatenate([unpacked(p["q_kth"]) for p in held])
        near = [(b["order"], b["pivot"], b["lo"], b["hi"], unpacked(b["ids"], np.int64), unpacked(b["rows"], np.int64), unpacked(b["x"]).reshape(b["n"], width)) for b in blocks.to_pylist()]
        at, score, vec_id, row = expand(space, q, own, kth, near, top)[0].found()
        return pa.table({"query_row": own[at], "query_id": ids[at], "vec_id": vec_id, "row_no": row, "score": score})

    found = searched(pairs, index.select("block", "pivot", "lo", "hi", "n", "ids", "rows", "x"), queries.select("group", "q_ids", "q_rows", "q", "q_kth"), search, FOUND)
    return ranked(found, ["query_row"], "score", "vec_id", "row_no", top).select("query_id", F.col("rank").cast("int").alias("rank"), id_or_null("vec_id").alias("vec_id"), F.col("score").cast("long").alias("score"))


PARTS = "group long, q_ids binary, q_rows binary, q binary, q_kth binary, near array<double>, far array<double>, radius double"
PARTS_ARROW = pa.schema([("group", pa.int64()), ("q_ids", pa.binary()), ("q_rows", pa.binary()), ("q", pa.binary()), ("q_kth", pa.binary()), ("near", pa.list_(pa.float64())), ("far", pa.list_(pa.float64())), ("radius", pa.float64())])
