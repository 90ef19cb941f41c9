"""Sessions, spans, batches, counts and judgments at their boundaries; every registered query against its SQL."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.operators import counts, judgments, sessions
from corpusloom.operators.common import global_row_number
from corpusloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"fuzzy_dedup_excluded"}


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query_equals_its_sql(spark, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = con.execute(sql)
        at = [d[0] for d in found.description]
        assert sorted(at) == names
        assert got == sorted((tuple(plain(r[at.index(c)]) for c in names) for r in found.fetchall()), key=repr)


def test_gap_is_inclusive(spark):
    t = datetime(2024, 1, 1)
    rows = [("o", 1, t, None), ("o", 2, t + timedelta(seconds=1800), None), ("o", 3, t + timedelta(seconds=3600.000001), None), ("o", 4, t + timedelta(seconds=60), "talk"), ("o", 5, None, None)]
    out = sessions.gap_sessions(spark.createDataFrame(rows, "owner string, id int, at timestamp, conv string"), "owner", "at", "id", "conv")
    assert {r.id: r.session for r in out.collect()} == {1: "burst|1", 2: "burst|1", 3: "burst|3", 4: "conversation|talk", 5: "transcript|5"}


def test_span_codes(spark):
    def want(kept, source):
        cursor = 0
        for span in kept.split("\n"):
            p = source.find(span, cursor)
            if p < 0:
                return "AUTHORSHIP_SPAN_ORDER_INVALID" if span in source else "AUTHORSHIP_SPAN_NOT_VERBATIM"
            cursor = p + len(span)
        return None

    rng = random.Random(9)
    pairs = []
    for _ in range(400):
        source = "".join(rng.choice("ab😀\n") for _ in range(rng.randint(0, 8)))
        pairs.append(("\n".join("".join(rng.choice("ab😀") for _ in range(rng.randint(0, 2))) for _ in range(rng.randint(1, 3))), source))
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, k string, s string")
    got = {r.i: r.c for r in rows.select("i", sessions.span_code(F.col("k"), F.col("s")).alias("c")).collect()}
    assert [got[i] for i in range(len(pairs))] == [want(*p) for p in pairs]


def test_batches(spark):
    assert sessions.plan_batches([(f"s{i}", 10) for i in range(43)])["batched"] is False
    plan = sessions.plan_batches([(f"s{i:03d}", 133) for i in range(395)])
    assert plan["batched"] and len(plan["batches"]) <= plan["per_step_allowance"] and plan["fits"]
    assert [n for b in plan["batches"] for n in b] == [f"s{i:03d}" for i in range(395)]
    assert sessions.plan_batches([])["agents_required_all_steps"] == 0
    big = sessions.plan_batches([(f"s{i}", 9000) for i in range(60)])
    assert all(len(b) == 1 for b in big["batches"])


def test_global_row_number(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    assert all(r.k + 1 == r.n for r in global_row_number(rows, ["k"], "n").collect())


def test_carry_forward_keeps_a_null_reset(spark):
    rows = spark.createDataFrame([("f", 1, True, 5), ("f", 2, False, None), ("f", 3, True, None), ("f", 4, False, 7)], "f string, n int, m boolean, v int")
    out = rows.select("n", sessions.carry_forward(rows, "f", ["n"], F.col("m"), F.col("v")).alias("c"))
    assert [r.c for r in out.orderBy("n").collect()] == [5, 5, None, None]


def test_window_fraction_and_half_even(spark):
    rows = spark.createDataFrame([(0, 100, 50, 150), (10, 10, 0, 20), (10, 10, 11, 20), (None, 5, 0, 9), (100, 0, 50, 150)], "a long, b long, s long, e long")
    assert [r.f for r in rows.select(counts.window_fraction(F.col("a"), F.col("b"), F.col("s"), F.col("e")).alias("f")).collect()] == [0.5, 1.0, 0.0, None, 0.5]
    assert spark.range(1).select(F.rint(F.lit(2.5)), F.rint(F.lit(3.5))).first()[:] == (2.0, 4.0)


def test_judgment_steps(spark):
    source = spark.createDataFrame([(1, 1, "u1", "a", "written", "I has a car."), (1, 2, "u2", "a", "spoken_asr", "ok"), (2, 1, "u3", "a", "written", "hello")], "session_seq long, i long, utterance_id string, source_adapter string, modality string, text string")
    decisions = spark.createDataFrame([(1, 1, "I has"), (1, 2, ""), (2, 1, "hullo")], "session_seq long, i long, text string")
    kept, faults = judgments.apply_decisions(source, decisions)
    assert {(r.session_seq, r.i): r.text for r in kept.collect()} == {(1, 1): "I has", (1, 2): ""}
    assert [(r.session_seq, r.code) for r in faults.collect()] == [(2, "AUTHORSHIP_SPAN_NOT_VERBATIM")]
    drafts = spark.createDataFrame([(1, 1, 2, 5, "m", "r", "e"), (1, 1, 4, 7, "m", "r", "e"), (1, 9, 0, 1, "m", "r", "e")], "session_seq long, i long, start long, end long, mistake string, rule string, example string")
    records = judgments.mistake_records(source, drafts)
    assert {r.code for r in judgments.record_diagnostics(records, privacy=False).collect()} == {"CARDINALITY_MISMATCH"}
    assert [r.code for r in judgments.unknown_drafts(source, drafts).collect()] == ["LINEAGE_MISSING_INPUT"]
    left = judgments.drop_records(records, spark.createDataFrame([(1, [2])], "session_seq long, drop array<int>"))
    assert [r.record_id for r in left.collect()] == ["u1:2-5"]


def test_canonical_json_and_digest(spark):
    row = spark.range(1).select(counts.canonical_json({"b": F.lit("é"), "a": F.lit(None).cast("int")}).alias("j"))
    assert row.first().j == '{"a":null,"b":"é"}'
    assert len(fixed.LOOKALIKES[0][0]) == len(fixed.LOOKALIKES[0][1])
