"""Lifecycles, the event stream, digests, reviews and packages."""

from __future__ import annotations

import hashlib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.operators import digests, lifecycle, review
from corpusloom.sources import quotas
from corpusloom.streaming import events


def test_every_pair_of_states(spark):
    """Shortest walks against a search, and walks along the path against the transitions one by one."""
    table = fixed.STEP_TRANSITIONS

    def distance(a, b):
        seen, now, n = {a}, [a], 0
        while now:
            n += 1
            now = [t for s in now for t in table[s]]
            if b in now:
                return n
            now = [t for t in set(now) if t not in seen]
            seen |= set(now)
        return None

    found = {(r.from_status, r.to_status): r.steps for r in lifecycle.reachable(lifecycle.legal_steps(spark)).collect()}
    assert {p: found.get(p) for p in itertools.product(table, repeat=2)} == {(a, b): distance(a, b) for a, b in itertools.product(table, repeat=2)}
    assert lifecycle.illegal_steps() == []
    pairs = spark.createDataFrame(list(itertools.product(table, repeat=2)), "status string, target string")
    path = fixed.PROMOTION_PATH
    for r in lifecycle.advanced(pairs).collect():
        if r.status == r.target:
            want = ([], r.status, None)
        elif r.target not in path:
            want = ([], r.status, "SCHEMA_INVALID_VALUE")
        else:
            rest = path[path.index(r.status) + 1 :] if r.status in path else path
            walk = list(itertools.takewhile(lambda s: s != r.target, rest)) + [r.target] if r.target in rest else []
            ok = all(b in table[a] for a, b in itertools.pairwise([r.status, *walk]))
            want = (walk, walk[-1] if walk else r.status, None) if ok else ([], r.status, "STATE_INVALID_TRANSITION")
        assert (r.walk, r.new_status, r.code) == want, (r.status, r.target)


def test_promotion_guard(spark):
    rows = [(1, s, "promoted") for s in range(5)] + [(2, 0, "promoted"), (2, 1, "failed"), (2, 2, "promoted"), (2, 3, "pending"), (3, 0, "pending"), (3, 4, "pending")]
    found = {r.run_id: r for r in lifecycle.promotion_guard(spark.createDataFrame(rows, "run_id long, step long, status string"), F.lit(3)).collect()}
    assert (found[1].allowed, found[1].unfinished, found[1].promoted_through, found[1].message) == (True, [], 4, None)
    assert (found[2].allowed, found[2].unfinished, found[2].promoted_through, found[2].message) == (False, [1, 3], 0, "steps 1, 3 are not promoted")
    assert (found[3].unfinished, found[3].promoted_through, found[3].message) == ([0], None, "step 0 is not promoted")


@pytest.mark.parametrize("seed", [1, 2])
def test_micro_batches_in_any_split(spark, tmp_path, seed):
    """Late, repeated and unordered events, in any split into batches and over a restart, leave the states of the whole log."""
    rng = random.Random(seed)
    kinds = [*events.STATUS_OF, "checkpoint_written", "unknown"]
    log = [{"run_id": rng.randint(1, 4), "step_id": rng.choice([None, 0, 1, 2]), "event_id": i, "at": f"2024-01-01T00:{rng.randint(0, 9):02d}:00", "kind": rng.choice(kinds)} for i in range(80)]
    sent = log + rng.sample(log, 30)
    rng.shuffle(sent)
    inbox, kept, marks = (str(tmp_path / x) for x in ("in", "kept", "marks"))
    (tmp_path / "in").mkdir()

    def deliver(part, rows):
        for n in range(0, len(rows), 17):
            (tmp_path / "in" / f"{part}-{n}.json").write_text("".join(json.dumps(r) + "\n" for r in rows[n : n + 17]))

    stream = lambda: spark.readStream.schema(events.EVENT).option("maxFilesPerTrigger", 2).json(inbox)
    deliver("a", sent[:60])
    events.keep(spark, stream(), kept, marks)
    deliver("b", sent[60:])
    events.keep(spark, stream(), kept, marks)
    whole = spark.read.schema(events.EVENT).json(inbox)
    want = sorted(tuple(r) for r in events.settle(whole).collect())
    assert sorted(tuple(r) for r in events.kept(spark, kept).collect()) == want
    best = {}
    for e in log:
        if e["step_id"] is not None and e["kind"] in events.STATUS_OF:
            key = (e["run_id"], e["step_id"])
            best[key] = max(best.get(key, ("",)), (e["at"], e["event_id"], events.STATUS_OF[e["kind"]]))
    assert {(r, s): (i, k) for r, s, _, i, k in want} == {k: v[1:] for k, v in best.items()}
    done = {r.run_id: (r.promoted, r.percent) for r in events.progress(events.kept(spark, kept), 3).collect()}
    assert done == {r: (n := sum(v[2] == "promoted" for k, v in best.items() if k[0] == r), 100 * n // 3) for r in {k[0] for k in best}}


def test_a_stream_of_events_runs_without_python(spark, tmp_path):
    """The events of a micro-batch combine in an aggregation; none is handed to Python row by row."""
    (tmp_path / "in").mkdir()
    plan = events.updates(spark.readStream.schema(events.EVENT).json(str(tmp_path / "in")))._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Pandas" not in plan and "Python" not in plan


def by_hand(records, fan):
    level = [hashlib.sha256(json.dumps(r, separators=(",", ":"), sort_keys=True).encode()).hexdigest() for r in sorted(records, key=lambda r: r["record_id"])]
    n = len(level)
    while len(level) > 1:
        level = [hashlib.sha256("\n".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
    return hashlib.sha256(f"{n}:{level[0] if level else ''}".encode()).hexdigest()


def test_tree_digest(spark, monkeypatch):
    records = [{"record_id": f"co{i:05d}", "text": f"t{i}" if i % 3 else None} for i in range(700)]
    frame = lambda rows: spark.createDataFrame([(r["record_id"], r["text"]) for r in rows], "record_id string, text string").repartition(5)
    columns = ["record_id", "text"]
    for part in ([], records[:1], records[:7], records):
        for fan in (7, 256):
            nodes = digests.tree(frame(part), ["record_id"], columns, fan)
            assert digests.root(nodes).first().records_sha256 == by_hand(part, fan)
            # However alike the ids begin, no node has more children than the fan.
            assert all(r.n <= fan for r in nodes.where("level > 0").join(nodes.where("level >= 0").groupBy((F.col("level") + 1).alias("level"), F.col("parent").alias("place")).agg(F.count("*").alias("n")), ["level", "place"]).select("n").collect())
    a = digests.tree(frame(records), ["record_id"], columns, 7)
    one = [r | {"text": "other"} if r["record_id"] == "co00123" else r for r in records]
    assert [tuple(r) for r in digests.differences(a, digests.tree(frame(one), ["record_id"], columns, 7)).collect()] == [(123, "co00123", "co00123")]
    assert digests.differences(a, digests.tree(frame(records), ["record_id"], columns, 7)).count() == 0
    less = [r for r in records if r["record_id"] != "co00698"]
    assert sorted((r.place, r.left_ref, r.right_ref) for r in digests.differences(a, digests.tree(frame(less), ["record_id"], columns, 7)).collect()) == [(698, "co00698", "co00699"), (699, "co00699", None)]
    nothing = digests.tree(frame([]), ["record_id"], columns, 7)
    assert digests.differences(nothing, nothing).count() == 0 and digests.differences(a, nothing).count() == 700


def test_toggles_by_differences(spark, tmp_path):
    """After each of many random sets of changes the counts are those of a recount, and records without a change keep their files."""
    rng = random.Random(9)
    truth = {(r, f"m{r}.{i}"): (rng.random() < 0.5, -1) for r in range(3) for i in range(60)}
    records = spark.createDataFrame([(r, m, x) for (r, m), (x, _) in truth.items()], "run_id long, record_id string, included boolean")
    path = str(tmp_path / "review")
    review.new_review(path, records)
    counts = review.record_counts(records)
    for n in range(5):
        changes = [(r, m, rng.randint(0, 200), rng.random() < 0.5) for r, m in rng.choices(list(truth), k=rng.choice([1, 25]))] + [(1, "nobody", 5, True)]
        rows = spark.createDataFrame(list({(c[0], c[1], c[2]): c for c in changes}.values()), "run_id long, record_id string, seq long, included boolean")
        for r, m, seq, x in sorted((tuple(c) for c in rows.collect()), key=lambda c: c[2]):
            if (r, m) in truth and seq > truth[r, m][1]:
                truth[r, m] = (x, seq)
        counts = spark.createDataFrame(review.recounted(counts, review.kept_toggles(path, rows)).collect(), counts.schema)
        want = {r: (sum(x for k, (x, _) in truth.items() if k[0] == r), sum(not x for k, (x, _) in truth.items() if k[0] == r)) for r in range(3)}
        assert {c.run_id: (c.shared_mistakes, c.withheld_by_user) for c in counts.collect()} == want, n


def test_package_gate(spark):
    rows = [(f"r{i}", "Use the past tense.", "He go.", "He goes.", "codex", i % 5 != 0) for i in range(40)]
    frame = spark.createDataFrame(rows, "record_id string, rule string, mistake string, example string, source_type string, included boolean")
    content = [c for c in frame.columns if c != "included"]
    texts = {c: c for c in ("rule", "mistake", "example", "source_type")}
    own, head, _ = review.package(frame, {"client_version": F.lit("1.0"), "words": F.lit(12)})
    check = lambda r, h: sorted((d.code, d.item_ref) for d in review.package_diagnostics(r, h, texts, content).collect())
    assert check(own, head) == []
    assert check(own.withColumn("rule", F.when(F.col("record_id") == "r7", "Use it.").otherwise(F.col("rule"))), head) == [("SUBMISSION_HASH_MISMATCH", None)]
    assert check(own, head.withColumn("words", F.lit(13))) == [("SUBMISSION_HASH_MISMATCH", None)]
    none, empty, _ = review.package(frame.where("false"), {"client_version": F.lit("v1\n")})
    assert check(none, empty)[:2] == [("SUBMISSION_FORBIDDEN_FIELD", "client_version"), ("SUBMISSION_NO_RECORDS", None)]
    against = lambda reviewed, counts=None: sorted((d.code, d.item_ref) for d in review.package_against_review(own, head, reviewed, content, counts).collect())
    counts = lambda n: spark.createDataFrame([(n,)], "words int")
    assert against(frame, counts(12)) == [] and against(frame, counts(11)) == [("SUBMISSION_COUNT_MISMATCH", "counts")]
    assert against(frame.withColumn("mistake", F.when(F.col("record_id") == "r9", "x").otherwise(F.col("mistake")))) == [("SUBMISSION_COUNT_MISMATCH", "r9")]
    assert against(frame.withColumn("mistake", F.when(F.col("record_id") == "r5", "x").otherwise(F.col("mistake")))) == []  # not included


def test_quota_shapes(spark):
    def config(utilization, fetched=1000_000, **more):
        return json.dumps({"cachedUsageUtilization": {"fetchedAtMs": fetched, "utilization": utilization} | more})

    cases = {
        "good": config({"five_hour": {"utilization": 12.9, "resets_at": "2024-05-01T10:00:00+02:00"}, "seven_day": {"utilization": 40}, "extra_usage": {"is_enabled": False}}),
        "odd": config({"five_hour": {"utilization": True}, "seven_day": {"utilization": "5"}, "seven_day_other": {"utilization": 99}, "extra_usage": {"is_enabled": 1}}, fetched=False),
        "null": config({"five_hour": None, "seven_day": []}, fetched=None),
        "tie": config({"seven_day": {"utilization": 7, "resets_at": "soon"}, "five_hour": {"utilization": 7}}, fetched=99e9),
        "list": "[]", "text": "{", "none": None, "flat": json.dumps({"cachedUsageUtilization": 3}), "shape": config([1]),
    }
    rows = spark.createDataFrame(list(cases.items()), "path string, value string")
    assert sorted(tuple(r) for r in quotas.windows(rows).collect()) == [("good", "five_hour", 12, "2024-05-01T10:00:00+02:00"), ("good", "seven_day", 40, None), ("tie", "five_hour", 7, None), ("tie", "seven_day", 7, None)]
    found = {r.path: tuple(r)[1:] for r in quotas.allowance(rows, F.lit(5000)).collect()}
    assert found["good"] == (2, "seven_day", 40, None, False, 4000.0, True)
    assert found["tie"] == (2, "five_hour", 7, None, None, 0.0, False)
    assert found["odd"] == (0, None, None, None, None, None, False)
    assert {found[x][0] for x in ("null", "list", "text", "none", "flat", "shape")} == {0}
