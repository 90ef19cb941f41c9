"""Exact top-k, hard negatives and whitening against brute force, with many small blocks, ties, hot groups and odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from corpusloom.llm import balltrees, pivots, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, row_no int, block int, pivot int, kind int, group int, r int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, 1, 1, 1, 1, 1) for i, v, lab in rows], SCHEMA)


def clustered(rng, n, width=8, clusters=6):
    """A third of the rows is one vector; the others lie in clusters."""
    heads = rng.standard_normal((clusters, width))
    out = []
    for i in range(n):
        v = heads[0] if i % 3 == 0 else heads[i % clusters] + 0.1 * rng.standard_normal(width)
        out.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), i % 3 if i % 3 else int(rng.integers(0, 4))))
    return out


def odd_rows():
    nan, inf = math.nan, math.inf
    return [(0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (50, [0.5, -0.5], 1), (1, None, 1), (2, [nan, 0.0], 1), (3, [inf, 0.0], 1), (4, [None, 1.0], 2), (5, [], 2), (100, [0.25], 2), (None, [0.5, 0.4], 1), (None, [0.5, 0.4], None), (7, [0.5, 0.4], 1), (8, [0.5, 0.3], 2), (9, [0.5, 0.3], 2), (-50, [0.1, 0.1], 3), (150, [0.3, 0.2], None)]


def integers(rows, labels=False):
    ok = [(i, v, lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v) and (not labels or lab is not None)]
    width = max((len(v) for _, v, _ in ok), default=0)
    x = np.zeros((len(ok), width))
    for k, (_, v, _) in enumerate(ok):
        x[k, : len(v)] = np.floor(256 * np.float32(v).astype(np.float64))
    return [i for i, _, _ in ok], x, [lab for *_, lab in ok]


def last(i):
    return (i is None, i or 0)


def brute_top(rows, top=5):
    ids, x, _ = integers(rows)
    out = []
    for q, i in enumerate(ids):
        if i is not None and i % 50 == 0:
            s = x @ x[q]
            best = sorted((k for k in range(len(ids)) if k != q), key=lambda k: (-s[k], last(ids[k])))[:top]
            out += [(i, n, ids[k], int(s[k])) for n, k in enumerate(best, 1)]
    return sorted(out, key=repr)


def brute_mine(rows):
    ids, x, labels = integers(rows, labels=True)
    labels = [(lab + 1) % 10 if i is not None and i % 7 == 0 else lab for i, lab in zip(ids, labels, strict=True)]
    out = []
    for q, i in enumerate(ids):
        if i is None or i % 50:
            continue
        s = (x @ x[q]).astype(int)
        order = sorted((k for k in range(len(ids)) if k != q), key=lambda k: (-s[k], last(ids[k])))
        for p in [k for k in order if labels[k] == labels[q]][:5]:
            hard = [k for k in order if labels[k] != labels[q] and 50 * s[p] <= 100 * s[k] <= 95 * s[p]][:3]
            out += [(i, ids[p], n, ids[k], int(s[p]), int(s[k])) for n, k in enumerate(hard, 1)]
    return sorted(out, key=repr)


@pytest.fixture
def small_blocks(monkeypatch):
    for module, name, value in ((pivots, "BLOCK_ROWS", 40), (balltrees, "BLOCK_ROWS", 60), (pivots, "GROUP_ROWS", 4), (balltrees, "GROUP_ROWS", 4), (vectors, "SLICE_ROWS", 100), (balltrees, "SLICE_ROWS", 100), (balltrees, "LEAF", 8)):
        monkeypatch.setattr(module, name, value)


@pytest.mark.parametrize("kind", ["clustered", "odd", "equal"])
def test_top_k(spark, small_blocks, kind):
    rows = {"clustered": lambda: clustered(np.random.default_rng(1), 900), "odd": odd_rows, "equal": lambda: [(i, [0.3, 0.1], 0) for i in range(120)]}[kind]()
    got = sorted((tuple(r) for r in pivots.top_k(frame(spark, rows)).collect()), key=repr)
    assert got == brute_top(rows)


@pytest.mark.parametrize("kind", ["clustered", "odd", "equal", "negative"])
def test_hard_negatives(spark, small_blocks, kind):
    rng = np.random.default_rng(2)
    rows = {"clustered": lambda: clustered(rng, 900), "odd": odd_rows, "equal": lambda: [(i, [0.3, 0.1 * (i % 4)], i % 3) for i in range(150)], "negative": lambda: [(i, (-np.abs(rng.standard_normal(3)) if i % 50 else np.abs(rng.standard_normal(3))).tolist(), i % 2) for i in range(150)]}[kind]()
    got = sorted((tuple(r) for r in balltrees.mine(frame(spark, rows)).collect()), key=repr)
    assert got == brute_mine(rows)
    assert bool(got) == (kind != "negative")


def test_annuli_are_skipped():
    """Bounds spare most annuli of clustered vectors, and the result stays that of the full comparison."""
    rng = np.random.default_rng(3)
    heads = rng.standard_normal((20, 16)) * 100
    x = np.floor(heads[rng.integers(0, 20, 4000)] + rng.standard_normal((4000, 16)) * 3)
    norm2 = float((x * x).sum(axis=1).max())
    space = pivots.Space(np.zeros((1, 17)), norm2, 16)
    space.pivots = pivots.centres(space.lifted(x[:1000]), 20)
    d = space.distances(space.lifted(x))
    own, r = d.argmin(axis=1), d.min(axis=1)
    q = x[:1]
    blocks = []
    for p in range(20):
        of = np.flatnonzero(own == p)
        of = of[np.argsort(r[of])]
        for part in np.array_split(of, max(1, len(of) // 50)):
            part = np.sort(part)
            gap = max(r[part].min() - space.of_queries(q)[0, p], space.of_queries(q)[0, p] - r[part].max(), 0.0)
            blocks.append((gap, p, r[part].min(), r[part].max(), part, part, x[part]))
    best, seen = pivots.expand(space, q, np.array([0]), np.array([-np.inf]), blocks, 5)
    s = x @ q[0]
    s[0] = -np.inf
    assert best.score[0].tolist() == np.sort(s)[::-1][:5].tolist()
    assert seen < len(blocks) / 4


def test_nodes_are_pruned(monkeypatch):
    """A tree compares few rows of clustered vectors: neither those outside of the window nor those beneath the kth score."""
    monkeypatch.setattr(balltrees, "LEAF", 50)
    rng = np.random.default_rng(4)
    heads = rng.standard_normal((40, 16))
    heads = heads / np.linalg.norm(heads, axis=1)[:, None] * 200
    kinds = rng.integers(0, 40, 4000)
    x = np.floor(heads[kinds] + rng.standard_normal((4000, 16)) * 2)
    tree = balltrees.Tree.built(np.arange(4000), np.arange(4000), kinds, x)
    for a, b, left, *_ in tree.spans:
        assert left or b - a <= balltrees.LEAF
    q, labels = tree.x[:1], tree.kinds[:1]
    best = vectors.Best(1, 5)
    assert tree.positives(best, q, tree.rows[:1], labels) < 2000
    s = tree.x @ q[0]
    s[0] = -np.inf
    assert best.score[0].tolist() == np.sort(np.where(tree.kinds == labels[0], s, -np.inf))[::-1][:5].tolist()
    low, high = balltrees.windows(best.score[0, :1])
    hard = vectors.Best(1, 3)
    assert tree.negatives(hard, q, labels, low, high) < 3000
    fits = np.sort(s[(tree.kinds != labels[0]) & (s >= low) & (s <= high)])[::-1][:3]
    assert hard.score[0, : len(fits)].tolist() == fits.tolist()


def test_best_keeps_ties_by_id():
    best = vectors.Best(2, 3)
    ids = np.arange(100)
    for a in range(0, 100, 25):
        best.add(np.array([0, 1]), np.array([[7.0] * 25, list(range(a, a + 25))]), ids[a : a + 25], ids[a : a + 25])
    assert best.id.tolist() == [[0, 1, 2], [99, 98, 97]]


def whitened_by_hand(x):
    x = np.asarray(x, np.float64)
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    order = np.argsort(-values)
    return centred @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(40) * np.linspace(1, 3, 40)).astype(np.float32).tolist(), None) for i in range(700)]
    rows += rows[:20] + [(1000, None, 1), (1001, [math.nan] * 40, 1), (1002, [None] * 40, 1), (1003, [1.0], 1), (None, rows[0][1], 1)]
    out = whitening.whiten(frame(spark, rows)).toPandas()
    used = [v for i, v, _ in rows if i not in (1000, 1001, 1002, 1003)]
    x = np.floor(64 * np.array(used, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n = len(x)
    white, share = whitened_by_hand(x)
    assert len(out) == n * 32 and set(out.n) == {n} and out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    exact = {sum(int(n * a - s) ** 2 for a, s in zip(row, x.sum(axis=0), strict=True)) for row in x.tolist()}
    assert set(out.deviation) == exact
    by = out[out.vec_id == 30].sort_values("component")
    for k in range(32):
        assert abs(abs(by.whitened.iloc[k]) - abs(white[30, k])) < 1e-7
        assert abs(by.explained.iloc[k] - share[k]) < 1e-9
    first = out[out.component == 1].set_index("vec_id").whitened
    signs = {float(np.sign(first.loc[i] * white[i, 0])) for i in range(20, 700)}
    assert len(signs) == 1


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_merged_moments_are_those_of_the_whole(parts):
    rng = np.random.default_rng(parts)
    x = rng.integers(-100, 100, (500, 7)) + 1e6
    total = None
    for part in np.array_split(x, parts):
        total = whitening.merged(total, whitening.moments(part))
    n, mean, scatter = total
    centred = x - x.mean(axis=0)
    assert n == 500 and np.allclose(mean, x.mean(axis=0), rtol=1e-14) and np.allclose(scatter, centred.T @ centred, rtol=1e-9, atol=1e-6)
    assert whitening.merged(None, None) is None


def test_deviations_beyond_a_long(spark):
    """Sums that a long can't hold are null, all others exact, also where the products are beyond a long."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(v)) for v in (rng.standard_normal(3) * (1e15 if i == 0 else 1e4))], 0) for i in range(200)]
    x = np.array([[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v, _ in rows], dtype=object)
    sums = x.sum(axis=0)
    want = {i: sum(int(200 * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for i, row in enumerate(x.tolist())}
    out = {r.vec_id: (r.deviation, r.identity_error) for r in whitening.whiten(frame(spark, rows)).collect()}
    assert {i: d for i, (d, _) in out.items()} == {i: w if w < 1 << 63 else None for i, w in want.items()}
    assert out[0][0] is None and max(e for _, e in out.values()) < 1e-4
    small = [(i, v, lab) for i, v, lab in rows if i]
    assert all(r.deviation is not None for r in whitening.whiten(frame(spark, small)).collect())


def test_whitening_without_variance(spark):
    out = whitening.whiten(frame(spark, [(1, [1.0, 2.0], 0), (2, [3.0, 2.0], 0)])).orderBy("vec_id", "component").collect()
    assert [(r.component, None if r.whitened is None else round(abs(r.whitened), 9), round(r.explained, 9), r.identity_error < 1e-9) for r in out] == [(1, 1.0, 1.0, True), (2, None, 0.0, True)] * 2
    same = whitening.whiten(frame(spark, [(1, [1.0], 0), (2, [1.0], 0)])).collect()
    assert [(r.whitened, r.deviation, r.explained) for r in same] == [(None, 0, 0.0)] * 2


@pytest.mark.parametrize("rows", [[], [(1, None, 1), (2, [math.nan], 2)]])
def test_no_vectors(spark, rows):
    d = frame(spark, rows)
    assert pivots.top_k(d).collect() == balltrees.mine(d).collect() == whitening.whiten(d).collect() == []
