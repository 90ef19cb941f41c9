"""Registered queries against their SQL on made tables: conversations that begin alike, and more of them than a made store's file holds."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.plans import registry


def compared(spark, folder, name):
    """(rows of the query, rows of its SQL), sorted."""
    df = registry.queries()[name](spark, folder)
    names = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    at = [d[0] for d in found.description]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr), sorted((tuple(r[at.index(c)] for c in names) for r in found.fetchall()), key=repr)


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """Sixty conversations of six turns, all of which begin with the same one."""
    folder = str(tmp_path_factory.mktemp("alike"))
    rows = spark.range(360).select((F.col("id") / 6).cast("long").alias("conv_id"), (F.col("id") % 6).alias("turn"), F.lit("user").alias("role"))
    rows.withColumn("text", F.when(F.col("turn") == 0, "hello there").otherwise(F.concat_ws(" ", F.lit("turn"), "turn", F.lit("of"), "conv_id"))).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return folder


def test_a_handed_over_task_is_no_other_one_that_begins_alike(spark, alike):
    got, want = compared(spark, alike, "task_times")
    assert got == want and len(want) == 288


def test_files_of_made_stores_stay_small(spark, alike, monkeypatch):
    """Three times the conversations are in more files, not in larger ones, and the results are those of whole stores."""
    from corpusloom.plans import databases

    sizes, build = [], databases.made_stores
    monkeypatch.setattr(databases, "made_stores", lambda rows, tables: sizes.append(rows.groupBy("path").count().agg(F.max("count")).first()[0]) or build(rows, tables))
    monkeypatch.setattr(databases, "FILE_TURNS", 40)
    for name in FILED:
        got, want = compared(spark, alike, name)
        assert got == want and want, name
    assert len(sizes) >= len(FILED) and max(sizes) <= 180


FILED = ["composer_store_utterances", "stores_with_composers", "part_store_utterances", "store_schemas", "dictation_texts"]


def test_sessions_share_folders(spark, alike, monkeypatch):
    """The folders written are as many as the rows ask for, not one for each session; some lose every row."""
    from corpusloom.operators import partitions
    from corpusloom.plans import audits

    wrote, change = [], partitions.change
    monkeypatch.setattr(partitions, "change", lambda rows, path, key, *more, **named: wrote.append(rows.select(key).distinct().count()) or change(rows, path, key, *more, **named))
    for most, folders in ((90, 4), (10_000, 1)):
        wrote.clear()
        monkeypatch.setattr(audits, "FOLDER_ROWS", most)
        got, want = compared(spark, alike, "redistributed_sessions")
        assert got == want and len(want) == 301 and len(wrote) == 2 and max(wrote) <= folders
