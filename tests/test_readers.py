"""Large files, stores with a write-ahead log, task trees, and one way to read every source."""

from __future__ import annotations

import json
import os
import random
import shutil
import sqlite3
from datetime import UTC, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull

from corpusloom.sources import datasource, records, registry, split_lines, stores, task_trees, transcripts


def test_numbers_of_lines_over_blocks(spark, tmp_path):
    """Files of many blocks, with empty lines, long lines, carriage returns and no last line feed, get the numbers of a single pass."""
    rng = random.Random(3)
    texts = {f"f{n}.jsonl": [rng.choice(["", "x" * rng.randint(0, 40), "é\r", "long " * rng.randint(0, 400)]) for _ in range(4000)] for n in range(3)} | {"one.jsonl": ["only"], "none.jsonl": []}
    for name, own in texts.items():
        (tmp_path / name).write_text("\n".join(own) + ("" if name in ("f1.jsonl", "one.jsonl", "none.jsonl") else "\n"), newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = split_lines.numbered_lines(spark, str(tmp_path), "*.jsonl")
        assert split_lines.placed_lines(spark, str(tmp_path), "*.jsonl").select("path", "block").distinct().count() > 50
        got = {}
        for r in rows.collect():
            got.setdefault(r.file_name, {})[r.line_no] = r.line
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, own in texts.items():
        want = own[:-1] if name == "f1.jsonl" and own[-1] == "" else own
        assert [line for _, line in sorted(got.get(name, {}).items())] == want and sorted(got.get(name, {})) == list(range(len(want))), name


def test_cut_tail_of_a_file_of_many_blocks(spark, tmp_path):
    good = [{"type": "user", "uuid": f"u{i}", "sessionId": "s", "timestamp": "2024-05-01T10:00:00Z", "message": {"role": "user", "content": f"words {i}"}} for i in range(800)]
    lines = [json.dumps(x) for x in good]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + '\n{"type": "user", "uu')
    (tmp_path / "b.jsonl").write_text("\n".join(['{"broken'] + [x.replace('"uuid": "u', '"uuid": "v') for x in lines]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        rows = split_lines.numbered_lines(spark, str(tmp_path)).select("path", "closed", F.col("line_no").cast("int").alias("line_no"), "line")
        seen = {r.path.rsplit("/", 1)[1]: (r.t, r.m) for r in records.parsed(rows).groupBy("path").agg(F.count_if("tail").alias("t"), F.count_if("malformed").alias("m")).collect()}
        assert seen == {"a.jsonl": (1, 0), "b.jsonl": (0, 1)}
        whole = records.lines(records.files(spark, str(tmp_path)))
        pick = lambda d: sorted(tuple(r) for r in transcripts.typed_utterances(d).select("session_id", "uuid", "text").collect())
        assert pick(rows) == pick(whole) and len(pick(rows)) == 1600
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def write_ahead(path, rows, checkpointed):
    """A store in write-ahead mode whose last rows are in the log only; the files are copied while it is open."""
    live = path.with_suffix(".live")
    con = sqlite3.connect(live)
    con.execute("PRAGMA journal_mode = WAL")
    con.execute("PRAGMA wal_autocheckpoint = 0")
    con.execute("CREATE TABLE cursorDiskKV(key TEXT, value TEXT)")
    con.execute("CREATE TABLE ItemTable(key TEXT, value TEXT)")
    con.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", rows[:checkpointed])
    con.commit()
    con.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    for r in rows[checkpointed:]:
        con.execute("INSERT INTO cursorDiskKV VALUES (?, ?)", r)
        con.commit()
    con.execute("INSERT INTO cursorDiskKV VALUES ('bubbleId:x:uncommitted', 'no')")
    shutil.copy(live, path)
    shutil.copy(f"{live}-wal", f"{path}-wal")
    con.rollback()
    con.close()


def test_write_ahead_stores(spark, tmp_path):
    rows = [(f"bubbleId:c:{i:04d}", "v" * (i % 700)) for i in range(900)]
    write_ahead(tmp_path / "a.vscdb", rows, 400)
    shutil.copy(tmp_path / "a.vscdb", tmp_path / "nolog.vscdb")
    write_ahead(tmp_path / "torn.vscdb", rows, 400)
    log = (tmp_path / "torn.vscdb-wal").read_bytes()
    (tmp_path / "torn.vscdb-wal").write_bytes(log[: len(log) // 2] + b"\x07" + log[len(log) // 2 + 1 :])
    (tmp_path / "junk.vscdb").write_bytes(b"no store at all")
    found = stores.store_files(spark, str(tmp_path), "*.vscdb")
    got = {}
    for r in stores.key_range(found, "bubbleId:").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.key, r.value))
    assert sorted(got["a.vscdb"]) == rows and sorted(got["nolog.vscdb"]) == rows[:400]
    torn = sorted(got["torn.vscdb"])
    assert torn == rows[: len(torn)] and 400 <= len(torn) < 900  # up to the last transaction before the damage
    faults = registry.ADAPTERS["cursor"].faults(spark, str(tmp_path)).collect()
    assert [(f.code, f.item_ref.rsplit("/", 1)[1]) for f in faults] == [("SOURCE_INACCESSIBLE", "junk.vscdb")]
    over = stores.oversize(spark, str(tmp_path), "*.vscdb", most=10).collect()
    assert {f.code for f in over} == {"SOURCE_FILE_OVERSIZE"} and len(over) == 6
    assert stores.store_files(spark, str(tmp_path), "*.vscdb", most=10).count() == 0


def test_oversize_documents_are_reported(spark, tmp_path):
    (tmp_path / "chat.json").write_text(json.dumps({"sessionId": "s", "projectHash": "p", "messages": [], "pad": "x" * (8 << 20)}))
    rows, faults = registry.extract(spark, "gemini_cli", str(tmp_path))
    assert rows.count() == 0 and [(f.code, f.source_adapter) for f in faults.collect()] == [("SOURCE_FILE_OVERSIZE", "gemini_cli")]


def tree_of(tmp_path, tasks):
    for task, files in tasks.items():
        (tmp_path / "tasks" / task).mkdir(parents=True)
        for name, doc in files.items():
            (tmp_path / "tasks" / task / name).write_text(doc if isinstance(doc, str) else json.dumps(doc))


API, ITEM, UI = "api_conversation_history.json", "history_item.json", "ui_messages.json"


def say(text, **more):
    return {"role": "user", "content": [{"type": "text", "text": text}]} | more


def test_task_trees(spark, tmp_path):
    hand = {"role": "assistant", "content": [{"type": "tool_use", "name": "new_task", "input": {"message": " do the thing ", "context": "not this"}}]}
    spoken_by_user = hand | {"role": "user"}
    tree_of(tmp_path, {
        "plain": {API: [say("<task>first</task>", ts=1714557600000.5), say("<feedback>so</feedback> <answer>b <i>c</i></answer>"), say("<task>s</task>", isSummary=True), say("<task>m</task>", isTruncationMarker=True), say("<task>t</task>", type="reasoning"), hand, {"role": "user", "content": [{"type": "tool_result", "content": '{"status": "ok", "feedback": " good "}'}]}, say("<answer>open <answer>"), say("<task>x <environment_details></task>")], UI: [{"ts": 1714557700000, "type": "say", "say": "text"}, {"ts": 1714557650000, "type": "say", "say": "user_feedback", "text": " so "}]},
        "told": {API: [say("<task>do the thing</task>"), say("<feedback>more</feedback>")]},
        "context": {API: [say("<task>not this</task>")]},
        "own": {API: [say("<task>do the thing</task>")], ITEM: {"id": "own", "ts": 1714557000000}},
        "child": {API: [say("<task>c</task>")], ITEM: {"id": "child", "parentTaskId": "plain"}},
        "rooted": {API: [say("<task>r</task>")], ITEM: {"id": "rooted", "rootTaskId": "plain"}},
        "self": {API: [say("<task>self</task>")], ITEM: {"rootTaskId": "self"}},
        "unreadable": {API: [say("<task>u</task>")], ITEM: "{"},
        "few": {API: [say(f"<task>t{i}</task>") for i in range(9)] + [7]},
        "many": {API: [say(f"<task>t{i}</task>") for i in range(8)] + [7, {"role": "tool"}]},
        "bare": {API: [say("just words")]}, "silent": {API: [{"role": "assistant", "content": "x"}]}, "empty": {API: []}, "broken": {API: "{"}, "odd": {API: {"a": 1}}, "nothing": {"claude_messages.json": []},
        "user-hand": {API: [say("<task>asked by a user</task>"), spoken_by_user | {"content": [{"type": "tool_use", "name": "new_task", "input": {"message": "own words"}}]}]}, "kept": {API: [say("<task>own words</task>")]},
    })
    found = records.files(spark, str(tmp_path), "*.json")
    tasks, spans = task_trees.scans(found)
    status = {r.task: r.status for r in tasks.collect()}
    assert status == {"plain": "ok", "told": "excluded_subtask", "context": "ok", "own": "ok", "child": "excluded_subtask", "rooted": "excluded_subtask", "self": "ok", "unreadable": "ok", "few": "ok", "many": "unsupported", "bare": "unsupported", "silent": "ok", "empty": "empty", "broken": "malformed", "odd": "malformed", "nothing": "empty", "user-hand": "ok", "kept": "ok"}
    rows = {}
    for r in spans.orderBy("record", "block", "span").collect():
        rows.setdefault(r.task, []).append(r)
    assert [(r.text, r.carrier, r.confidence, r.flags) for r in rows["plain"]] == [("first", "wrapper", 0.6, ["possible_delegated_task"]), ("so", "wrapper", 0.9, []), ("b <i>c</i>", "wrapper", 0.9, ["unknown_wrapper"]), ("good", "json_feedback", 0.9, [])]
    at = [r.ts for r in rows["plain"]]
    assert at[0] == datetime(2024, 5, 1, 10, 0, 0, 500) and at[1] == at[3] == datetime(2024, 5, 1, 10, 0, 50)  # the UI's first time
    assert [(r.text, r.confidence, r.ts) for r in rows["own"]] == [("do the thing", 0.9, datetime(2024, 5, 1, 9, 50))]
    assert rows["unreadable"][0].confidence == 0.6 and rows["unreadable"][0].ts is not None
    info = {r.task: r for r in tasks.collect()}
    assert info["unreadable"].metadata_unreadable and info["nothing"].legacy and info["plain"].unbalanced == 1 and len(info["plain"].ui_feedback) == 1
    assert [r.fingerprint for r in task_trees.fingerprint(tasks).collect()] == ["mixed+meta+ts"]
    assert task_trees.scans(found, most=50)[0].where("status = 'oversized'").count() > 3


def test_ancestry(spark):
    chain = [("i", f"t{i:03d}", f"t{i - 1:03d}" if i else None) for i in range(300)]
    odd = [("i", "a", "b"), ("i", "b", "c"), ("i", "c", "a"), ("i", "d", "a"), ("i", "self", "self"), ("i", "orphan", "gone"), ("i", "under", "orphan"), ("j", "t001", None)]
    got = {(r.instance, r.own_id): (r.top, r.depth) for r in task_trees.ancestry(spark.createDataFrame(chain + odd, "instance string, own_id string, parent_id string")).collect()}
    assert all(got["i", f"t{i:03d}"] == ("t000", i) for i in range(300)) and got["j", "t001"] == ("t001", 0)
    assert {got["i", x] for x in ("a", "b", "c", "d", "self")} == {(None, None)}
    assert got["i", "orphan"] == ("gone", 1) and got["i", "under"] == ("gone", 2)


@pytest.fixture
def home(tmp_path):
    (tmp_path / "p").mkdir()
    for n in range(6):
        record = {"type": "user", "uuid": f"u{n}", "sessionId": f"s{n}", "timestamp": f"2024-05-0{n + 1}T10:00:00Z", "message": {"role": "user", "content": f"words {n}"}}
        (tmp_path / "p" / f"s{n}.jsonl").write_text(json.dumps(record) + "\n" + '{"type": "mode"}\n' * 200)
        os.utime(tmp_path / "p" / f"s{n}.jsonl", (1714557600 + n * 86400,) * 2)
    head = {"type": "session_meta", "payload": {"id": "r1"}}
    event = {"type": "event_msg", "timestamp": "2024-05-02T10:00:00Z", "payload": {"type": "user_message", "message": "rolled", "kind": "plain"}}
    (tmp_path / "rollout-1.jsonl").write_text(json.dumps(head) + "\n" + json.dumps(event) + "\n")
    return tmp_path


def test_data_source_opens_only_what_filters_leave(spark, home):
    options = {"path": str(home), "pattern.claude_code": "*/p/*.jsonl", "pattern.codex": "*rollout-*.jsonl", "splitbytes": "500"}
    opened = lambda *filters: (lambda r: (list(r.pushFilters(list(filters))), {p.path.rsplit("/", 1)[1] for p in r.partitions()}))(datasource.FilesReader(options))
    assert len(opened()[1]) == 7
    adapter, late, other = EqualTo(("adapter",), "codex"), GreaterThanOrEqual(("modified",), datetime(2024, 5, 4, tzinfo=UTC)), IsNotNull(("line",))
    assert opened(adapter) == ([], {"rollout-1.jsonl"})
    assert opened(late, In(("adapter",), ("claude_code",)), other) == ([other], {"s3.jsonl", "s4.jsonl", "s5.jsonl"})
    rows = registry.lines(spark, str(home), split_bytes=500)
    assert rows.rdd.getNumPartitions() > 20  # byte ranges of each file
    got = {}
    for r in rows.where("adapter = 'claude_code' and path like '%/p/%'").collect():
        got.setdefault(r.path, []).append((r["at"], r.line))
    for path, own in got.items():
        text = open(path).read()
        assert [line for _, line in sorted(own)] == text.splitlines() and all(text.encode()[at:].startswith(line.encode()) for at, line in own)
    only = rows.where((F.col("adapter") == "codex") & (F.col("modified") >= F.lit("2024-01-01").cast("timestamp")))
    assert only.rdd.getNumPartitions() == 1 and only.count() == 2


def test_every_source_has_one_shape(spark, home, tmp_path):
    start, end = F.lit("2024-05-02").cast("timestamp"), F.lit("2024-05-04 12:00:00").cast("timestamp")
    sources = {"claude_code": str(home / "p"), "codex": str(home)}
    (tmp_path / "db").mkdir()
    con = sqlite3.connect(tmp_path / "db" / "flow.sqlite")
    con.executescript("CREATE TABLE History(transcriptEntityId, asrText, timestamp, status, app, isArchived, conversationId, appVersion); INSERT INTO History VALUES ('0b0e7a52-1111-2222-3333-444455556666', 'spoken words', '2024-05-03 10:00:00.000 +00:00', 'formatted', 'x', 0, 'k', '1');")
    con.commit()
    con.close()
    rows, faults = registry.extract_all(spark, sources | {"wispr_flow": str(tmp_path / "db")}, start, end, end)
    assert [f"{n} {t}" for n, t in rows.dtypes] == [c.replace("long", "bigint") for c in registry.COLUMNS.split(", ")]
    assert sorted((r.source_adapter, r.text) for r in rows.collect()) == [("claude_code", "words 1"), ("claude_code", "words 2"), ("claude_code", "words 3"), ("codex", "rolled"), ("wispr_flow", "spoken words")]
    assert faults.count() == 0
    assert set(registry.source_types(("other",))) == {*registry.ADAPTERS, "other"} and len(registry.ADAPTERS) == 9


def test_changed_blocks_are_an_error(spark, tmp_path):
    """Blocks that change between the two reads fail the job instead of giving wrong numbers."""
    (tmp_path / "a.jsonl").write_text("some words\n" * 5000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = split_lines.numbered_lines(spark, str(tmp_path))
    assert rows.agg(F.max("line_no")).first()[0] == 4999
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
    try:
        with pytest.raises(PySparkException):
            rows.select("line_no", "line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_session_folders_of_the_third_generation(spark, tmp_path):
    def unit(name, doc, manifest=None, lead=True, others=()):
        folder = tmp_path / "sessions" / name
        folder.mkdir(parents=True)
        if lead:
            (folder / f"{name}.messages.json").write_text(doc if isinstance(doc, str) else json.dumps(doc))
        if manifest is not None:
            (folder / f"{name}.json").write_text(manifest if isinstance(manifest, str) else json.dumps(manifest))
        for other in others:
            (folder / f"{other}.messages.json").write_text(json.dumps({"version": 1, "messages": [said("another agent's")]}))

    def said(*texts, **more):
        return {"role": "user", "content": [{"type": "text", "text": t} if isinstance(t, str) else t for t in texts]} | more

    body = lambda *messages, **k: {"version": 1, "messages": list(messages)} | k
    result = {"type": "tool_result", "content": "x"}
    unit("a", body(said("<user_input mode='x'> one\ntwo </user_input>", id="m1", ts=1714557600000), said("<mode_notice>act</mode_notice> bare"), said(result), said(result, "mixed"), said("<user_command>x</user_command> no"), said("  <environment_details>x", "<user_input>kept</user_input>"), said("System-delivered teammate async run updates: x"), {"role": "user", "content": "a string"}, {"role": "assistant", "content": [{"type": "text", "text": "no"}]}, said(" "), said("p1", "p2")), {"started_at": "2024-05-01T09:00:00Z"}, others=["helper"])
    unit("old", body(said("x"), version=2))
    unit("alone", body(said("x")), {"interactive": False})
    unit("helper", body(said("x"), agent="helper"))
    unit("lead", body(said("fine"), agent="lead", sessionId="lead"), "{")
    unit("moved", body(said("x"), sessionId="other"))
    unit("broken", "{")
    unit("list", [])
    unit("nomessages", {"version": 1})
    unit("odd", body(*[said(f"x{i}") for i in range(8)], 7))
    unit("fewodd", body(*[said(f"y{i}") for i in range(9)], 7))
    unit("empty", body())
    unit("missing", None, {"interactive": True}, lead=False)
    unit("others", None, lead=False, others=["x"])
    found = records.files(spark, str(tmp_path), "*.json")
    from corpusloom.sources import sdk_sessions

    status = {r.unit: (r.status, r.other_files) for r in sdk_sessions.units(found).collect()}
    assert status == {"a": ("supported", 1), "old": ("unsupported", 0), "alone": ("excluded", 0), "helper": ("excluded", 0), "lead": ("supported", 0), "moved": ("excluded", 0), "broken": ("malformed", 0), "list": ("malformed", 0), "nomessages": ("malformed", 0), "odd": ("unsupported", 0), "fewodd": ("supported", 0), "empty": ("supported", 0), "missing": ("malformed", 0), "others": ("excluded", 1)}
    rows = {}
    for r in sdk_sessions.utterances(found).orderBy("record").collect():
        rows.setdefault(r.unit, []).append((r.ref, r.text, r.text_status, r.confidence, r.ts.strftime("%H:%M")))
    assert rows["a"] == [("m1", "one\ntwo", "verbatim", 0.9, "10:00"), ("m0002", "bare", "unknown", 0.7, "09:00"), ("m0006", "kept", "verbatim", 0.9, "09:00"), ("m0011", "p1\n\np2", "unknown", 0.7, "09:00")]
    assert [x[1] for x in rows["lead"]] == ["fine"] and len(rows["fewodd"]) == 9 and set(rows) == {"a", "lead", "fewodd"}


def test_oldest_trees(spark, tmp_path):
    base = tmp_path / "project" / "web" / "storage" / "session"
    docs = {
        "info/ses_1": {"id": "ses_1", "version": "0.1"}, "info/ses_2": {"id": "ses_2", "parentID": "ses_1"}, "info/ses_3": {"id": "other"},
        "message/ses_1/msg_1": {"id": "msg_1", "role": "user", "time": {"created": 1714557600000}, "parts": [{"type": "text", "text": "inline loses"}]},
        "part/ses_1/msg_1/prt_2": {"id": "prt_2", "type": "text", "text": " second "}, "part/ses_1/msg_1/prt_1": {"id": "prt_1", "type": "text", "text": "first"}, "part/ses_1/msg_1/prt_3": {"type": "text", "text": "no", "ignored": True},
        "message/ses_1/msg_2": {"id": "msg_2", "role": "user", "parts": [{"type": "text", "text": "b"}, {"type": "file"}, {"id": "a", "type": "text", "text": "a"}, 7]}, "message/ses_1/msg_3": {"id": "msg_3", "role": "user"}, "message/ses_1/msg_4": {"id": "msg_4", "parts": []},
        "message/ses_2/msg_5": {"id": "msg_5", "role": "user", "sessionID": "ses_2", "parts": [{"type": "text", "text": "child"}]}, "message/ses_3/msg_6": {"id": "msg_6", "role": "user", "parts": [{"type": "text", "text": "no session"}]},
    }
    for name, doc in docs.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / f"{name}.json").write_text(json.dumps(doc))
    rows = stores.part_project_messages(records.files(spark, str(tmp_path), "*.json"))
    got = {r.message_id: (r.session_id, r.text, r.parent_id, r.project_key, r.ts and r.ts.hour) for r in rows.collect()}
    assert got == {"msg_1": ("ses_1", "first\n\nsecond", None, "web", 10), "msg_2": ("ses_1", "a\n\nb", None, "web", None), "msg_5": ("ses_2", "child", "ses_1", "web", None)}
    assert [r.message_id for r in stores.part_utterances(rows).orderBy("message_id").collect()] == ["msg_1", "msg_2"]
    newer = rows.where("message_id = 'msg_1'").withColumn("generation", F.lit("json-j2")).withColumn("text", F.lit("newer"))
    both = {r.message_id: (r.text, r.generation_text_mismatch) for r in stores.coalesced(rows.unionByName(newer)).collect()}
    assert both["msg_1"] == ("newer", True) and both["msg_2"] == ("a\n\nb", False)
    assert [(r.project_key, r.records, r.version_range) for r in stores.canonical_counts(rows).collect()] == [("web", 3, "0.1")]


def test_files_of_a_run(spark, tmp_path):
    from corpusloom.sources import run_files

    for n in (1, 2, 9999, 10000):
        (tmp_path / f"session-{n:04d}.jsonl").write_text("".join(json.dumps({"text": f"{n}.{i}"}) + "\n" for i in range(3)) + ("{broken\n" if n == 2 else ""))
    (tmp_path / "session-7.jsonl").write_text('{"text": "no number of four digits"}\n')
    rows, bad = run_files.sessions(spark, str(tmp_path), {"text": "string"})
    assert [r.text for r in rows.orderBy("session_seq", "i").collect()] == [f"{n}.{i}" for n in (1, 2, 9999, 10000) for i in range(3)]
    assert [(r.code, r.item_ref.rsplit("/", 1)[1]) for r in bad.collect()] == [("SCHEMA_INVALID_JSON", "session-0002.jsonl:4")]
    docs = {"session-index.json": {"sessions": {"session-0001.jsonl": "h1", "session-0002.jsonl": 2}}, "a.drop.json": {"drop": [1, 3]}, "b.drop.json": {"drop": [0]}, "c.drop.json": {"other": 1}, "d.drop.json": [], "e.drop.json": "{", "f.drop.json": {"drop": ["x"]}, "profile.json": {"entries": [{"step": "c", "p50": 1.5}, {"step": "d", "p50": 2}]}}
    for name, doc in docs.items():
        (tmp_path / name).write_text(doc if isinstance(doc, str) else json.dumps(doc))
    files = lambda p: records.files(spark, str(tmp_path), p)
    assert {(r.file_name, r.session_hash) for r in run_files.session_index(files("session-index.json")).collect()} == {("session-0001.jsonl", "h1"), ("session-0002.jsonl", "2")}
    good, faults = run_files.drop_lists(files("*.drop.json"))
    assert [r["drop"] for r in good.collect()] == [[1, 3]]
    assert {(r.item_ref.rsplit("/", 1)[1][0], r.code) for r in faults.collect()} == {("b", "SCHEMA_INVALID_VALUE"), ("c", "SCHEMA_MISSING_FIELD"), ("d", "SCHEMA_INVALID_VALUE"), ("e", "SCHEMA_INVALID_JSON"), ("f", "SCHEMA_INVALID_VALUE")}
    assert {tuple(r) for r in run_files.profile_entries(files("profile.json"), "step: string, p50: double").collect()} == {("c", 1.5), ("d", 2.0)}
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "events.jsonl").write_text('{"at": "2024-01-01T10:00:00+02:00", "kind": "artifact_promoted", "step_id": 2}\n{"at": "2024-01-01T10:00:00", "kind": "x"}\n\n{"at": "2024-01-01T10:00:00Z"}\n{"at": "2024-01-01T10:00:00Z", "kind": "x", "text": "no"}\n')
    events, odd = run_files.event_log(spark, str(tmp_path))
    assert [(r.kind, r.step_id, r["at"].hour) for r in events.collect()] == [("artifact_promoted", 2, 8)]
    assert sorted((r.code, r.line_no) for r in odd.collect()) == [("SCHEMA_INVALID_VALUE", 1), ("SCHEMA_MISSING_FIELD", 3), ("SCHEMA_UNKNOWN_FIELD", 4)]
    items = spark.createDataFrame([("w", json.dumps({"allComposers": [{"composerId": "a"}, {"composerId": "b", "messages": []}, 7, {"composerId": 3}]})), ("x", "{"), ("y", "[]")], "path string, value string")
    assert sorted((r.composer_id or "", r.inline) for r in run_files.workspace_index(items).collect()) == [("", False), ("a", False), ("b", True)]
    schema = run_files.json_schema(spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, array(1.5D) AS c, named_struct('d', timestamp'2024-01-01') AS e").schema)
    assert schema["required"] == ["a", "c", "e"] and schema["properties"]["b"]["type"] == ["string", "null"] and schema["properties"]["e"]["properties"]["d"] == {"type": "string", "format": "date-time"} and not schema["additionalProperties"]
