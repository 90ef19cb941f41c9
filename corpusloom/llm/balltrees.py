"""Hard negatives by branch and bound over ball trees.

The rows, ordered by label and by the signs of ``SIGNS`` projections, are dealt out in ranges, and every block of a range becomes a ball tree: nodes
with a centre, a radius and the span of their labels, leaves of up to ``LEAF`` rows. For an anchor q a node bounds all its inner products on both sides,
q.c - |q| r and q.c + |q| r. Groups of anchors go down a tree together, as arrays. The first search finds the positives: nodes go
that lie below the kth score so far or hold no row of the anchor's label. The second finds the negatives of each (anchor, positive): nodes go whose bounds lie
outside of the score window [positive / 2, 0.95 positive], that hold the anchor's label only, or lie strictly beneath the kth score so far.
Trees whose root already says so for a whole group of anchors never meet that group. Both searches are exact; rounding has a margin.

Defined results: rows with a null label, or with a vector that is null or holds null, infinite or undefined components, take no part; a shorter vector counts as
followed by zeros; repeated rows are rows of their own, as anchors, positives and negatives; of ties the smaller vec_id comes first, a null
vec_id last and never as an anchor; an anchor without a positive, or a positive without a negative, gives no row; an empty table gives an
empty result; other columns are ignored. Scores are exact up to 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .vectors import BLOCK_ROWS, CHUNK, GROUP_ROWS, NO_ID, NONE, SLICE_ROWS, Best, id_keys, id_or_null, integer_vectors, matrix, packed, ranked, searched, unpacked, without_own

SCALE, EVERY, POSITIVES, NEGATIVES, RELABELLED = 256, 50, 5, 3, 7
LABELS = 10
LEAF, SIGNS = 128, 8
#: Margin of rounding of a bound, as a share of |q| (|c| + r).
MARGIN = 1e-9

TREE_ARROW = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("labels", pa.list_(pa.int64())), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("ids", pa.binary()), ("rows", pa.binary()), ("kinds", pa.binary()), ("x", pa.binary()), ("nodes", pa.binary()), ("spans", pa.binary()), ("own", pa.binary()), ("kth", pa.binary())])
TREE = "block long, n int, labels array<long>, centre array<double>, radius double, ids binary, rows binary, kinds binary, x binary, nodes binary, spans binary, own binary, kth binary"
POSITIVE = "anchor_row long, anchor_id long, anchor_label long, positive_id long, positive_row long, positive_score double"
NEGATIVE = "anchor_row long, anchor_id long, positive_id long, positive_row long, positive_score double, negative_id long, negative_row long, negative_score double"


class Tree:
    """A ball tree over the rows of one block.

    ``nodes``: centre, radius and norm of the centre of each node; ``spans``: begin, end, left, right (0: a leaf), least and greatest label. Rows of a leaf ascend by (id, row).
    """

    def __init__(self, ids, rows, kinds, x, nodes=None, spans=None) -> None:
        self.ids, self.rows, self.kinds, self.x, self.nodes, self.spans = ids, rows, kinds, x, nodes, spans

    @classmethod
    def built(cls, ids: np.ndarray, rows: np.ndarray, kinds: np.ndarray, x: np.ndarray) -> Tree:
        order, nodes, spans, todo = np.arange(len(ids)), [], [], [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            here = len(spans)
            if parent >= 0:
                spans[parent][side] = here
            own = order[a:b]
            points = x[own]
            centre = points.mean(axis=0)
            radius = float(np.sqrt(((points - centre) ** 2).sum(axis=1).max()))
            nodes.append([*centre, radius, float(np.sqrt((centre**2).sum()))])
            spans.append([a, b, 0, 0, int(kinds[own].min()), int(kinds[own].max())])
            spread = points.var(axis=0) if b - a > LEAF else np.zeros(1)
            if spread.max(initial=0.0) > 0:
                middle = (b - a) // 2
                order[a:b] = own[np.argpartition(points[:, spread.argmax()], middle)]
                todo += [(a, a + middle, here, 2), (a + middle, b, here, 3)]
            else:  # few rows, or all equal
                order[a:b] = own[np.lexsort((rows[own], ids[own]))]
        return cls(ids[order], rows[order], kinds[order], x[order], np.array(nodes), np.array(spans, np.int64))

    @classmethod
    def read(cls, b: dict, width: int) -> Tree:
        return cls(*(unpacked(b[c], np.int64) for c in ("ids", "rows", "kinds")), unpacked(b["x"]).reshape(b["n"], width), unpacked(b["nodes"]).reshape(-1, width + 2), unpacked(b["spans"], np.int64).reshape(-1, 6))

    def visit(self, q: np.ndarray, stays, promise, leaf) -> int:
        """Goes down with all queries: ``stays(at, low, high, least label, greatest label)`` says which go on, ``promise(at, scores of a centre)`` which
        child comes first, and ``leaf(at, begin, end)`` compares. Returns the comparisons made."""
        norms = np.sqrt((q * q).sum(axis=1))
        todo, made = [(0, np.arange(len(q)))], 0
        while todo:
            node, at = todo.pop()
            a, b, left, right, least, greatest = self.spans[node]
            centre, radius, norm = self.nodes[node, :-2], self.nodes[node, -2], self.nodes[node, -1]
            middle, reach = q[at] @ centre, norms[at] * (radius + MARGIN * (norm + radius))
            at = at[stays(at, middle - reach, middle + reach, least, greatest)]
            if not len(at):
                continue
            if left:
                todo += [(child, at) for child in sorted((left, right), key=lambda c: promise(at, q[at] @ self.nodes[c, :-2]))]  # the last one is next
                continue
            for i in range(0, len(at), CHUNK):
                leaf(at[i : i + CHUNK], a, b)
                made += len(at[i : i + CHUNK]) * int(b - a)
        return made

    def positives(self, best: Best, q: np.ndarray, own: np.ndarray, labels: np.ndarray) -> int:
        def stays(at, low, high, least, greatest):
            return (high >= best.least()[at]) & (labels[at] >= least) & (labels[at] <= greatest)

        def leaf(at, a, b):
            scores = without_own(q[at] @ self.x[a:b].T, own[at], self.rows[a:b])
            best.add(at, np.where(self.kinds[a:b] == labels[at][:, None], scores, NONE), self.ids[a:b], self.rows[a:b])

        return self.visit(q, stays, lambda at, scores: float(scores.mean()), leaf)

    def negatives(self, best: Best, q: np.ndarray, labels: np.ndarray, low_score: np.ndarray, high_score: np.ndarray) -> int:
        """``q`` holds the anchor of each window."""

        def stays(at, low, high, least, greatest):
            return (high >= np.maximum(low_score[at], best.least()[at])) & (low <= high_score[at]) & ~((labels[at] == least) & (labels[at] == greatest))

        def leaf(at, a, b):
            scores = q[at] @ self.x[a:b].T
            fits = (scores >= low_score[at][:, None]) & (scores <= high_score[at][:, None]) & (self.kinds[a:b] != labels[at][:, None])
            best.add(at, np.where(fits, scores, NONE), self.ids[a:b], self.rows[a:b])

        return self.visit(q, stays, lambda at, scores: -float(np.abs(scores - high_score[at]).mean()), leaf)


def windows(positive_score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest negative score: 50 p <= 100 s <= 95 p, in integers."""
    p = positive_score.astype(np.int64)
    return (-(-p // 2)).astype(np.float64), (95 * p // 100).astype(np.float64)


def grown(width: int, every: int, positives: int):
    """For rows sorted by label and signs: a tree for each full block, with its anchors and their first scores."""

    def tree(number: int, held: list[tuple]) -> dict:
        t = Tree.built(*(np.concatenate(c) for c in zip(*held, strict=True)))
        at = np.flatnonzero((t.ids % every == 0) & (t.ids != NO_ID))
        best = Best(len(at), positives)
        t.positives(best, t.x[at], t.rows[at], t.kinds[at])
        return {"block": number, "n": len(t.ids), "labels": np.unique(t.kinds).tolist(), "centre": t.nodes[0, :-2].tolist(), "radius": float(t.nodes[0, -2]), "ids": packed(t.ids, np.int64), "rows": packed(t.rows, np.int64), "kinds": packed(t.kinds, np.int64), "x": packed(t.x), "nodes": packed(t.nodes), "spans": packed(t.spans, np.int64), "own": packed(at, np.int32), "kth": packed(best.least())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            columns = id_keys(batch.column("vec_id")), batch.column("row_no").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("x"), width)
            begin = 0
            while begin < batch.num_rows:
                end = min(batch.num_rows, begin + BLOCK_ROWS - n)
                held.append(tuple(c[begin:end] for c in columns))
                begin, n = end, n + end - begin
                if n == BLOCK_ROWS:
                    yield pa.RecordBatch.from_pylist([tree(number, held)], schema=TREE_ARROW)
                    number, held, n = number + 1, [], 0
        if held:
            yield pa.RecordBatch.from_pylist([tree(number, held)], schema=TREE_ARROW)

    return run


def forest(vectors: DataFrame, width: int, every: int, positives: int) -> DataFrame:
    """The trees over all rows (row_no, vec_id, label, x), as a table."""
    planes = np.random.default_rng(12).standard_normal((width, SIGNS))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = (matrix(batch.column("x"), width) @ planes > 0) @ (1 << np.arange(SIGNS))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.int32())], names=[*batch.schema.names, "code"])

    order = ["label", "code", "row_no"]
    coded = vectors.select("row_no", "vec_id", "label", "x").mapInArrow(signed, "row_no long, vec_id long, label long, x array<double>, code int")
    return materialize(coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(grown(width, every, positives), TREE), "trees")


ANCHORS = "group long, a_ids binary, a_rows binary, a_labels binary, a binary, a_kth binary, labels array<long>, centre array<double>, radius double, norm double"
ANCHORS_ARROW = pa.schema([("group", pa.int64()), ("a_ids", pa.binary()), ("a_rows", pa.binary()), ("a_labels", pa.binary()), ("a", pa.binary()), ("a_kth", pa.binary()), ("labels", pa.list_(pa.int64())), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("norm", pa.float64())])


def mine(embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the first ``negatives`` of each anchor and positive."""
    spark = embeddings.sparkSession
    label = F.when(F.col("vec_id") % RELABELLED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("long")
    labelled = embeddings.where(F.col("label").isNotNull()).select("vec_id", "embedding", label.alias("kind"))
    vectors = materialize(integer_vectors(labelled, scale, "kind").withColumnRenamed("kind", "label"), "labelled")
    n, width = vectors.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    trees = forest(vectors, width, every, positives)
    discard(vectors)
    last, n_anchors = trees.agg(F.max("block"), F.sum(F.octet_length("own") / 4)).first()
    ranges, groups = (last >> 32) + 1, max(1, -(-int(n_anchors) // GROUP_ROWS))
    each = -(-groups // ranges)
    group = F.when(F.lit(groups >= ranges), F.shiftright("block", 32) * each + F.col("block") % each).otherwise(F.expr(f"shiftright(block, 32) * {groups} div {ranges}"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                t, at = Tree.read(b, width), unpacked(b["own"], np.int32)
                a = t.x[at]
                centre = a.mean(axis=0)
                yield pa.RecordBatch.from_pylist([{"group": b["group"], "a_ids": packed(t.ids[at], np.int64), "a_rows": packed(t.rows[at], np.int64), "a_labels": packed(t.kinds[at], np.int64), "a": packed(a), "a_kth": b["kth"], "labels": np.unique(t.kinds[at]).tolist(), "centre": centre.tolist(), "radius": float(np.sqrt(((a - centre) ** 2).sum(axis=1).max())), "norm": float(np.sqrt((a * a).sum(axis=1).max()))}], schema=ANCHORS_ARROW)

    anchors = materialize(trees.where(F.octet_length("own") > 0).select(group.cast("long").alias("group"), *trees.columns).drop("block", "labels", "centre", "radius").mapInArrow(parts, ANCHORS), "anchors")
    payload = trees.drop("labels", "centre", "radius", "own", "kth")
    # Positives: a group meets the trees that hold one of its labels.
    kinds = trees.select("block", "n", F.explode("labels").alias("label"))
    near = anchors.select("group", F.explode("labels").alias("label")).distinct().join(kinds, "label").select("group", "block", "n").distinct().withColumn("order", F.lit(0.0))

    def first(group: pa.Table, blocks: pa.Table) -> pa.Table:
        held = group.to_pylist()
        ids, own, labels = (np.concatenate([unpacked(p[c], np.int64) for p in held]) for c in ("a_ids", "a_rows", "a_labels"))
        a = np.concatenate([unpacked(p["a"]) for p in held]).reshape(-1, width)
        best = Best(len(a), positives, np.concatenate([unpacked(p["a_kth"]) for p in held]))
        for b in blocks.to_pylist():
            Tree.read(b, width).positives(best, a, own, labels)
        at, score, vec_id, row = best.found()
        return pa.table({"anchor_row": own[at], "anchor_id": ids[at], "anchor_label": labels[at], "positive_id": vec_id, "positive_row": row, "positive_score": score})

    found = searched(near, payload, anchors.select("group", "a_ids", "a_rows", "a_labels", "a", "a_kth"), first, POSITIVE)
    chosen = materialize(ranked(found, ["anchor_row"], "positive_score", "positive_id", "positive_row", positives).drop("rank"), "positives")

    # Negatives: the windows of a group's anchors meet the trees whose root allows them; trees are dealt to shards, and every group goes to each shard.
    def tall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                rows = unpacked(b["a_rows"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), b["group"])), pa.array(rows)], names=["group", "anchor_row"])

    of_group = chosen.join(anchors.select("group", "a_rows").mapInArrow(tall, "group long, anchor_row long"), "anchor_row")
    score = F.col("positive_score")
    spans = of_group.groupBy("group").agg(F.min(F.ceil(score / 2)).alias("least"), F.max(F.floor(score * 95 / 100)).alias("most"), F.collect_list(F.struct("anchor_row", "anchor_id", "positive_id", "positive_row", "positive_score")).alias("windows"))  # at most `positives` for each anchor of a bounded group
    spans = materialize(spans, "windows")
    shards = max(1, -(-n // SLICE_ROWS))
    roots = trees.select("block", "n", "labels", F.col("centre").alias("c"), F.col("radius").alias("r"), F.pmod(F.xxhash64("block"), F.lit(shards)).alias("shard"))
    balls = anchors.select("group", F.col("labels").alias("own_labels"), "centre", "radius", "norm").join(spans.select("group", "least", "most"), "group").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))
    inner = F.aggregate(F.zip_with("centre", "c", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, v: s + v * v))
    reach = F.col("radius") * length + F.col("norm") * F.col("r") + MARGIN * F.col("norm") * (length + F.col("r"))
    other = ~((F.size("labels") == 1) & (F.size("own_labels") == 1) & (F.col("labels") == F.col("own_labels")))
    meet = balls.join(roots, "shard").where(other & (inner + reach >= F.col("least")) & (inner - reach <= F.col("most"))).groupBy("group", "block", "n").agg(F.min(F.abs(inner - F.col("most"))).alias("order"))

    def second(group: pa.Table, blocks: pa.Table) -> pa.Table:
        side = group.to_pylist()[0]
        held, wanted = side["parts"], side["windows"]
        place = {r: i for i, r in enumerate(np.concatenate([unpacked(p["a_rows"], np.int64) for p in held]).tolist())}
        a = np.concatenate([unpacked(p["a"]) for p in held]).reshape(-1, width)
        labels = np.concatenate([unpacked(p["a_labels"], np.int64) for p in held])
        at = np.array([place[w["anchor_row"]] for w in wanted], np.int64)
        low, high = windows(np.array([w["positive_score"] for w in wanted]))
        best = Best(len(at), negatives)
        for b in sorted(blocks.to_pylist(), key=lambda b: b["order"]):
            Tree.read(b, width).negatives(best, a[at], labels[at], low, high)
        w, score, vec_id, row = best.found()
        columns = {c: pa.array([wanted[i][c] for i in w.tolist()], kind) for c, kind in (("anchor_row", pa.int64()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_row", pa.int64()), ("positive_score", pa.float64()))}
        return pa.table(columns | {"negative_id": vec_id, "negative_row": row, "negative_score": score})

    sides = anchors.groupBy("group").agg(F.collect_list(F.struct("a_rows", "a_labels", "a")).alias("parts")).join(spans.select("group", "windows"), "group")  # a group is bounded
    hard = searched(meet, payload, sides, second, NEGATIVE)
    out = ranked(hard, ["anchor_row", "positive_row"], "negative_score", "negative_id", "negative_row", negatives)
    return out.select("anchor_id", id_or_null("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), id_or_null("negative_id").alias("negative_id"), F.col("positive_score").cast("long").alias("positive_score"), F.col("negative_score").cast("long").alias("negative_score"))
