"""Whitening of embeddings by merged moments.

Every partition computes the count, the mean and the centred scatter of its rows, batch by batch; two such summaries merge by Chan's
formula, pairwise in ``treeReduce``, so that no difference of large sums ever arises. The covariance (one matrix of the vectors' width) goes to the driver, where
``eigh`` gives the components. A second pass whitens all rows, merges the summaries of the results in the same way, and compares their covariance with
the identity; the last pass writes the rows.

Sums by dimension are summaries too, but of integers, and exact: ``n * x - S`` comes from them, and the projected value is that integer difference over n.

Defined results: vectors that are null or hold null, infinite or undefined components are no rows; vectors of another length than the most frequent
one (of ties the longest) aren't either, as a covariance needs one width; repeated rows count as often as they stand; a component without variance (its
eigenvalue is within rounding of zero, as with fewer rows than dimensions) has a null ``whitened`` and stays out of the identity's check; a
deviation that a long can't hold is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import matrix, usable

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Merges meet in a tree of this depth.
DEPTH = 3
#: A share of the greatest eigenvalue below which an eigenvalue is rounding.
RANK = 1e-12
#: Rows whose projections are in memory at once.
CHUNK = 4096

Moments = tuple[int, np.ndarray, np.ndarray]  # rows, mean, centred scatter
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def moments(x: np.ndarray) -> Moments:
    mean = x.mean(axis=0)
    centred = x - mean
    return len(x), mean, centred.T @ centred


def merged(a: Moments | None, b: Moments | None) -> Moments | None:
    """Chan's formula; None stands for no rows."""
    if a is None or b is None:
        return b if a is None else a
    n = a[0] + b[0]
    delta = b[1] - a[1]
    return n, a[1] + delta * (b[0] / n), a[2] + b[2] + np.outer(delta, delta) * (a[0] * b[0] / n)


def merged_sums(a: tuple | None, b: tuple | None) -> tuple | None:
    """Exact sums by dimension, as Python integers, and the largest absolute entry, beside the moments."""
    if a is None or b is None:
        return b if a is None else a
    return [p + q for p, q in zip(a[0], b[0], strict=True)], max(a[1], b[1]), merged(a[2], b[2])


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and x (longs) of the rows that take part."""
    x = F.transform(F.col("embedding"), lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return embeddings.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def summary(rows: DataFrame, batch_summary, merge):
    """The merged summary of all batches of a frame, by partition and then in a tree; None for no rows."""

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        found = None
        for batch in batches:
            if batch.num_rows:
                found = merge(found, batch_summary(batch))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["summary"])

    def opened(row):
        import pickle

        return pickle.loads(row[0])  # noqa: S301  what `of_partition` wrote

    own = rows.mapInArrow(of_partition, "summary binary").rdd.map(opened)
    nothing = rows.sparkSession.sparkContext.parallelize([None], 1)  # a frame may have no partition at all
    return own.union(nothing).treeReduce(merge, DEPTH)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component, as the contract of the module states."""
    spark = embeddings.sparkSession
    rows = vectors(embeddings)
    widths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if widths is None or widths["width"] == 0:
        return spark.createDataFrame([], OUT)
    width = widths["width"]
    rows = rows.where(F.size("x") == width)

    def integers(batch: pa.RecordBatch) -> np.ndarray:
        return matrix(batch.column("x"), width)

    def first(batch: pa.RecordBatch) -> tuple:
        x = integers(batch)
        most = int(np.abs(x).max())
        sums = x.sum(axis=0, dtype=np.int64).tolist() if most * len(x) < 1 << 62 else [sum(c) for c in x.T.tolist()]
        return sums, most, moments(x.astype(np.float64))

    sums, most, (n, _, scatter) = summary(rows, first, merged_sums)
    values, axes = np.linalg.eigh(scatter / n)
    order = np.argsort(-values, kind="stable")[:components]
    trace, value, axes = float(values.sum()), values[order], axes[:, order]
    sound = value > RANK * max(float(values.max()), 0.0)
    scale = np.where(sound, 1 / np.sqrt(np.where(sound, value, 1.0)), 0.0)
    total = np.array(sums, dtype=object)
    small = n * most < 1 << 61  # then n * x, S and their difference are longs

    def differences(x: np.ndarray) -> np.ndarray:
        return x * n - total.astype(np.int64) if small else x.astype(object) * n - total

    def projected(x: np.ndarray) -> np.ndarray:
        return (differences(x).astype(np.float64) / n) @ axes * scale

    def second(batch: pa.RecordBatch) -> Moments:
        found = None
        x = integers(batch)
        for i in range(0, len(x), CHUNK):
            found = merged(found, moments(projected(x[i : i + CHUNK])[:, sound]))
        return found

    check = summary(rows, second, merged)
    error = float(np.abs(check[2] / n - np.eye(int(sound.sum()))).max(initial=0.0))
    explained = np.where(sound, value, 0.0) / trace if trace > 0 else np.zeros(len(value))
    k = len(value)

    def deviations(x: np.ndarray) -> pa.Array:
        """The exact sums of squares: in longs where they surely fit, null where they surely don't, in Python's integers between."""
        d = differences(x)
        about = (d.astype(np.float64) ** 2).sum(axis=1)
        if small and (about < 2.0**62).all():
            return pa.array((d * d).sum(axis=1), pa.int64())
        exact = [sum(int(v) ** 2 for v in row) if a < 2.0**64 else None for a, row in zip(about.tolist(), d.tolist(), strict=True)]
        return pa.array([v if v is not None and v < 1 << 63 else None for v in exact], pa.int64())

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                x, m = integers(part), part.num_rows
                which = np.repeat(np.arange(m), k)
                white = pa.array(projected(x).ravel(), pa.float64(), mask=np.tile(~sound, m))
                columns = [part.column("vec_id").take(pa.array(which)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), deviations(x).take(pa.array(which)), white, pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUT.split(", ")])

    return rows.mapInArrow(last, OUT)
