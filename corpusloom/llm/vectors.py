"""What the vector searches share: integer vectors, blocks of them, groups of queries, and the best rows of a query.

Vectors lie in *blocks* (a few thousand rows as one matrix in a binary column), and queries in *groups*. Which group meets which
block is planned on their descriptions only (``dealt``); a task then holds one group and a few blocks, nothing else. Neither the vectors nor
the queries pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a block; queries of a group; rows that one task compares with a group.
BLOCK_ROWS, GROUP_ROWS, SLICE_ROWS = 4096, 2048, 16_384
#: Queries whose scores are in memory at once.
CHUNK = 256
NO_ID = np.iinfo(np.int64).max
NONE = -np.inf


def usable(vector) -> object:
    """Neither null nor with a null, infinite or undefined component."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def integer_vectors(rows: DataFrame, scale: int, *keep: str) -> DataFrame:
    """row_no, vec_id, x (floor(scale * component), as doubles) and the columns ``keep`` of the rows whose vector is usable."""
    x = F.transform(F.col("embedding"), lambda c: F.floor(c.cast("double") * scale).cast("double"))
    return rows.where(usable(F.col("embedding"))).select(F.monotonically_increasing_id().alias("row_no"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), *keep)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows; a shorter one counts as followed by zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def id_keys(column: pa.Array) -> np.ndarray:
    """Ids to order by; a null one comes last."""
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def packed(a: np.ndarray, kind=np.float64) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def unpacked(b: bytes, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b, kind)


class Best:
    """The ``k`` best rows of each query so far: highest score first, ties by smaller id, then by row."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None) -> None:
        self.k = k
        self.score = np.full((queries, k), NONE)
        self.id = np.full((queries, k), NO_ID)
        self.row = np.full((queries, k), NO_ID)
        self.floor = np.full(queries, NONE) if floor is None else floor.astype(np.float64)

    def least(self) -> np.ndarray:
        """Scores strictly below these can't come in any more."""
        return np.maximum(self.floor, self.score[:, -1])

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Scores (queries ``at`` x candidates); the candidates ascend by (id, row), and those that are out are ``NONE``."""
        least = self.least()[at]
        hits = (scores >= least[:, None]) & (scores > NONE)
        for i in np.flatnonzero(hits.sum(axis=1) > 8 * self.k):
            cut = np.partition(scores[i], len(ids) - self.k)[len(ids) - self.k]
            hits[i] &= scores[i] >= cut
            tied = np.flatnonzero(hits[i] & (scores[i] == cut))
            hits[i, tied[self.k :]] = False  # of equal scores the first ones have the smaller ids
        q, c = np.nonzero(hits)
        if not len(q):
            return
        touched, own = np.unique(q, return_inverse=True)
        base = at[touched]
        pool_q = np.concatenate([own, np.repeat(np.arange(len(touched)), self.k)])
        pool = [np.concatenate([new, old[base].ravel()]) for new, old in ((scores[q, c], self.score), (ids[c], self.id), (rows[c], self.row))]
        order = np.lexsort((pool[2], pool[1], -pool[0], pool_q))
        sorted_q = pool_q[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q)
        chosen, place, sorted_q = order[place < self.k], place[place < self.k], sorted_q[place < self.k]
        for old, new in zip((self.score, self.id, self.row), pool, strict=True):
            old[base[sorted_q], place] = new[chosen]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id, row) of all that came in."""
        q, k = np.nonzero(self.score > NONE)
        return q, self.score[q, k], self.id[q, k], self.row[q, k]


def without_own(scores: np.ndarray, own: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A query isn't its own candidate."""
    _, q, c = np.intersect1d(own, rows, assume_unique=True, return_indices=True)
    scores[q, c] = NONE
    return scores


def dealt(pairs: DataFrame) -> DataFrame:
    """Adds ``slice`` to pairs (group, block, n, order): few rows for each task, every slice with its share of the promising blocks."""
    own = Window.partitionBy("group")
    slices = F.ceil(F.sum("n").over(own) / SLICE_ROWS)
    return pairs.withColumn("slice", (F.row_number().over(own.orderBy("order", "block")) % slices).cast("int"))


def searched(pairs: DataFrame, blocks: DataFrame, parts: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``search(parts of a group, its blocks of a slice)`` for every group and slice."""
    plan = materialize(dealt(pairs).select("group", "slice", "block", "order"), "plan")
    left = plan.select("group", "slice").distinct().join(parts, "group")
    right = plan.toDF("g", "s", "block", "order").join(blocks, "block")
    return left.groupBy("group", "slice").cogroup(right.groupBy("g", "s")).applyInArrow(search, schema)


def ranked(found: DataFrame, keys: list[str], score: str, id_col: str, row: str, k: int) -> DataFrame:
    """The first ``k`` rows of each key, with ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), id_col, row)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def id_or_null(name: str) -> object:
    return F.when(F.col(name) != int(NO_ID), F.col(name))
