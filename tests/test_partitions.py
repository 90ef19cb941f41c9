"""Writing that touches only what changed, and shows as a whole or not at all."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.operators import collect, partitions, verification

SCHEMA = "session_seq long, i long, utterance_id string, text string"
BODY = "i long, utterance_id string, text string"


def files_of(path):
    return {p: hashlib.sha256(p.read_bytes()).hexdigest() for p in path.rglob("part-*.json")}


def sessions(spark, wanted, tag="a"):
    rows = [(s, i, f"u{s}.{i}", f"{tag} {s} {i}") for s, n in wanted.items() for i in range(n)]
    random.Random(4).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def live(spark, path, version=None):
    return sorted(tuple(r) for r in partitions.read(spark, path, BODY, "session_seq", version).select("session_seq", "i", "text").collect())


def test_untouched_sessions_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    assert verification.write_sessions(sessions(spark, {1: 3, 2: 5, 3: 2}), path) == 1
    before = files_of(tmp_path)
    assert len(before) == 3
    assert verification.write_sessions(sessions(spark, {3: 4, 7: 1}, "b"), path) == 2
    after = files_of(tmp_path)
    assert before.items() <= after.items() and len(after) == 5
    assert live(spark, path) == [(1, i, f"a 1 {i}") for i in range(3)] + [(2, i, f"a 2 {i}") for i in range(5)] + [(3, i, f"b 3 {i}") for i in range(4)] + [(7, 0, "b 7 0")]
    assert [(s, n) for s, n in sorted((s, sum(x[0] == s for x in live(spark, path, 1))) for s in (1, 2, 3, 7))] == [(1, 3), (2, 5), (3, 2), (7, 0)]
    # Rows lie in their order in the files.
    for p in files_of(tmp_path):
        own = [int(line.split('"i":')[1].split(",")[0]) for line in p.read_text().splitlines()]
        assert own == sorted(own)
    assert partitions.vacuum(spark, path) == 1  # the former manifest; both generations are in force
    assert len(live(spark, path)) == 13
    verification.write_sessions(sessions(spark, {1: 1, 2: 1}, "c"), path)
    assert partitions.vacuum(spark, path) == 2 and len(live(spark, path)) == 7


def test_an_interrupted_change_leaves_the_old_state(spark, tmp_path):
    path = str(tmp_path / "t")
    verification.write_sessions(sessions(spark, {1: 3, 2: 2}), path)
    before = live(spark, path)
    broken = sessions(spark, {1: 2, 9: 1}).withColumn("text", F.when(F.col("session_seq") == 9, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(PySparkException):
        verification.write_sessions(broken, path)
    assert live(spark, path) == before
    # A manifest that wasn't completed doesn't count, and the next change goes past it.
    unfinished = tmp_path / "t" / "manifest" / "version=2"
    unfinished.mkdir()
    (unfinished / "part-0.parquet").write_bytes(b"half")
    assert live(spark, path) == before and partitions.current_version(spark, path) == 1
    assert verification.write_sessions(sessions(spark, {2: 1}, "b"), path) == 3
    assert live(spark, path) == [x for x in before if x[0] == 1] + [(2, 0, "b 2 0")]
    with pytest.raises(PySparkException):
        partitions.change(sessions(spark, {1: 1}).withColumn("session_seq", F.lit(None).cast("long")), path, "session_seq", ["i"])


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    assert live(spark, path) == [] and partitions.vacuum(spark, path) == 0
    assert verification.write_sessions(sessions(spark, {}), path) == 1 and live(spark, path) == []
    verification.write_sessions(sessions(spark, {1: 1}), path)
    gone = spark.createDataFrame([(1,), (5,)], "session_seq long")
    partitions.change(sessions(spark, {}), path, "session_seq", ["i"], removed=gone)
    assert live(spark, path) == []


def test_redistribution_writes_only_sessions_that_lose_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    whole = sessions(spark, {s: 4 for s in range(12)})
    verification.write_sessions(whole, path)
    before = files_of(tmp_path)
    survivors = whole.where("not (session_seq in (3, 5) and i = 1) and session_seq <> 8").select("utterance_id")
    version, affected = collect.redistribute(spark, path, BODY, survivors)
    assert version == 2 and {(r.session_seq, r.removed, r.kept) for r in affected.collect()} == {(3, 1, 3), (5, 1, 3), (8, 4, 0)}
    after = files_of(tmp_path)
    assert before.items() <= after.items() and len(after) == len(before) + 2
    assert {(s, i) for s, i, _ in live(spark, path)} == {(s, i) for s in range(12) for i in range(4) if not (s in (3, 5) and i == 1) and s != 8}
    assert collect.redistribute(spark, path, BODY, survivors)[0] is None
