"""Deduplication against brute force."""

from __future__ import annotations

import difflib
import random
from datetime import datetime, timedelta

from corpusloom.functions.similarity import ratio
from corpusloom.operators import components, dedup

SCHEMA = "utterance_id string, source_adapter string, source_path_hash string, ts timestamp, text string, text_status string, modality string"
T0 = datetime(2024, 1, 1)


def brute(rows):
    key = [" ".join(r[4].split()).casefold() for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][3] is None, rows[i][3] or T0, rows[i][0]))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if rows[i][1:3] == rows[j][1:3]:
                continue
            a, b = rows[i][3], rows[j][3]
            near = a is None or b is None or abs(b - a) <= timedelta(minutes=10)
            if near and (key[i] == key[j] or (a is not None and b is not None and difflib.SequenceMatcher(None, key[i], key[j], autojunk=False).ratio() >= 0.92)):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = {}
    for members in groups.values():
        best = min(members, key=lambda i: (rows[i][5] != "verbatim", rows[i][6] != "spoken_asr", rows[i][3] is None, rows[i][3] or T0, rows[i][0]))
        for i in members:
            if i != best:
                out[rows[i][0]] = (rows[best][0], "exact" if key[i] == key[best] else "fuzzy")
    return out


def run(spark, rows):
    kept, gone = dedup.deduplicate(spark.createDataFrame(rows, SCHEMA))
    out = {r.excluded_utterance_id: (r.canonical_utterance_id, r.kind) for r in gone.collect()}
    assert {r.utterance_id for r in kept.collect()} == {r[0] for r in rows} - set(out)
    return out


def test_against_brute_force(spark):
    rng = random.Random(11)
    base = ["the quick brown fox jumps over the lazy dog today", "please fix the failing test in this module", "Straße und Weg"]
    rows = []
    for i in range(150):
        t = rng.choice(base)
        if rng.random() < 0.4:
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice("xyz ") + t[k + 1 :]
        ts = None if rng.random() < 0.1 else T0 + timedelta(seconds=rng.randrange(20_000))
        rows.append((f"u{i:03d}", rng.choice("abc"), rng.choice("pq"), ts, t, rng.choice(["verbatim", "cleaned"]), rng.choice(["written", "spoken_asr"])))
    assert run(spark, rows) == brute(rows)


def test_boundaries(spark):
    row = lambda i, s, sec, t="same words here": (i, s, "p", None if sec is None else T0 + timedelta(seconds=sec), t, "verbatim", "written")
    assert run(spark, [row("a", "x", 0), row("b", "y", 600)]) == {"b": ("a", "exact")}
    assert run(spark, [row("a", "x", 0), row("b", "y", 600.000001)]) == {}
    assert run(spark, [row("a", "x", 0), row("b", "x", 1)]) == {}
    assert run(spark, [row("a", "x", 0), row("b", "y", None), row("c", "x", 90_000)]) == {"b": ("a", "exact"), "c": ("a", "exact")}
    edge = "a" * 23 + "bb", "a" * 23 + "cc"
    assert ratio(*edge) == 0.92
    assert run(spark, [row("a", "x", 0, edge[0]), row("b", "y", 5, edge[1])]) == {"b": ("a", "fuzzy")}


def test_hot_key_makes_few_edges(spark):
    rows = [(f"u{i:04d}", "ab"[i % 2], "p", T0 + timedelta(seconds=i // 10), "one common text", "verbatim", "written") for i in range(2000)]
    assert dedup.exact_edges(dedup.prepared(spark.createDataFrame(rows, SCHEMA))).count() <= 4 * len(rows)


def test_ratio_equals_the_definition():
    from corpusloom.functions import similarity

    rng, whole = random.Random(1), similarity.SHORT
    for similarity.SHORT in (3, whole):
        for _ in range(200):
            a = "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 150)))
            b = list(a)
            for _ in range(rng.randint(0, 6)):
                k = rng.randint(0, len(b))
                b[k : k + rng.randint(0, 3)] = rng.choice(["", "x", "ab"])
            b = "".join(b)
            want = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
            assert ratio(a, b) == want
            got = ratio(a, b, 0.92)
            assert got == want or (got == 0 and want < 0.92)


def test_dense_buckets_in_small_chunks(spark, monkeypatch):
    """Many rows of one time and length, dealt out as pairs of chunks, give what brute force gives."""
    monkeypatch.setattr(dedup, "CHUNK_ROWS", 9)
    rng = random.Random(21)
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel"]
    base = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(25)]
    rows = []
    for i in range(220):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3, 6])):
            k = rng.randrange(len(t))
            t[k : k + rng.randint(0, 2)] = rng.choice(["", "x", "yz"])
        rows.append((f"u{i:03d}", rng.choice("abc"), "p", T0 + timedelta(seconds=rng.randrange(900)), "".join(t), "verbatim", "written"))
    got = run(spark, rows)
    assert got == brute(rows) and {k for _, k in got.values()} == {"exact", "fuzzy"}


def test_components_by_stars_and_at_once(spark):
    rng = random.Random(5)
    edges = [(f"n{a:03d}", f"n{b:03d}") for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(230))] + [(f"m{i:03d}", f"m{i + 1:03d}") for i in range(200)]
    frame = spark.createDataFrame(edges, "a string, b string")
    stars, once = ({(r.node, r.root) for r in components.components(frame, small).collect()} for small in (0, 1000))
    assert stars == once and ("m200", "m000") in once


def _syllables(rng, n):
    return "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", ". ", ", ", " the ", " of "]) for _ in range(n))


def test_placed_runs_bound_is_sound():
    from corpusloom.functions.similarity import may_reach, placed_runs

    rng = random.Random(8)
    linked = 0
    for _ in range(300):
        a = _syllables(rng, rng.randint(0, 200))
        b = list(a)
        for _ in range(int(len(a) * rng.choice([0.02, 0.05, 0.07, 0.09]))):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 2)] = rng.choice(["", "x", "ab"])
        if rng.random() < 0.3:  # the edits side by side
            k = rng.randint(0, len(a))
            b = list(a[:k] + "zq" * int(len(a) * 0.04) + a[k:])
        b = "".join(b)
        for x, y in ((a, b), (b, a)):
            if difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.92:
                linked += 1
                assert may_reach(placed_runs(x), placed_runs(y), len(x), len(y), 0.92)
    assert linked > 200


def test_unlike_texts_of_common_syllables_are_not_compared(monkeypatch):
    """Texts that share most of their syllables, and so many runs of characters, are told apart without a search for blocks."""
    import pyarrow as pa

    rng, calls = random.Random(3), []
    monkeypatch.setattr(dedup, "compared", lambda a, b, least: calls.append(1) or ratio(a, b, least))
    texts = [_syllables(rng, 600) for _ in range(60)]
    texts += [t[:300] + "new" + t[300:] for t in texts[:5]]
    one = [{"side": s, "id": f"u{i:02d}", "source": f"s{i}", "at": i, "n": len(t), "key": t} for s in (0, 1) for i, t in enumerate(texts)]
    found = dedup._linked(0.92, 1000)(pa.Table.from_pylist(one))
    assert sorted(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)) == [(f"u{i:02d}", f"u{60 + i:02d}") for i in range(5)] and len(calls) <= 10
