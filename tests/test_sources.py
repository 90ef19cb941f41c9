"""Readers of raw formats on invented records: kept rows, exclusions, gates, broken lines."""

from __future__ import annotations

import functools
import json
import random
import sqlite3

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import states
from corpusloom.sources import composers, editor_states, formats, histories, records, stores, tasks, transcripts


def lines_of(spark, folder, files):
    for name, rows in files.items():
        p = folder / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return records.lines(records.files(spark, str(folder)))


def user(uuid, content, **more):
    return {"type": "user", "uuid": uuid, "sessionId": "s1", "timestamp": "2024-05-01T10:00:00Z", "message": {"role": "user", "content": content}} | more


def test_typed_records(spark, tmp_path):
    good = [
        user("u1", "plain words"), user("u2", [{"type": "text", "text": "one"}, {"type": "image"}, {"type": "text", "text": " two "}]), user("u3", "<system-reminder>x</system-reminder>kept", sessionId="other"),
        user("u4", "<odd-tag>hm"), user("u5", "x" * 2001), user("u6", "typed in a client", promptSource="sdk", entrypoint="sdk-cli"), user("u7", "human", origin={"kind": "human"}), user("u1", "plain words again"),
    ]
    bad = [
        user("b1", "<command-name>go"), user("b2", "a <bash-input>"), user("b3", "<system-reminder>open"), user("b4", "   "), user("b5", [{"type": "tool_result"}]), user("b6", "x", isMeta=True), user("b7", "x", isSidechain=True),
        user("b8", "x", toolUseResult=None), user("b9", "x", origin={"kind": "robot"}), user("c1", "x", promptSource="sdk"), user("c2", "x", userType="bot"), {"type": "assistant", "message": {"role": "assistant", "content": "no"}}, {"type": "mode"},
        user("c3", "x", promptSource="system"), user("c4", "x", isCompactSummary=True), {"type": "user", "uuid": "c5", "message": {"role": "assistant", "content": "x"}},
    ]
    odd = [{"type": "novel"}, {"type": "user", "message": "x"}]
    rows = lines_of(spark, tmp_path, {"s1.jsonl": [*good, *bad, *odd, '{"type": "user", "uuid'], "s2.jsonl": ["not json", *[{"type": "mode"}] * 8], "s3.jsonl": [{"type": "novel"}], "s4.jsonl": [user("u1", "plain words", timestamp="2024-05-02T10:00:00Z"), user("u1x", "more")]})
    seen = transcripts.typed_records(rows)
    by = {(r.path.rsplit("/", 1)[1], r.line_no): r.outcome for r in seen.collect()}
    assert [by["s1.jsonl", i] for i in range(len(good))] == ["kept"] * len(good)
    assert [by["s1.jsonl", i + len(good)] for i in range(len(bad))] == ["excluded"] * len(bad)
    assert [by["s1.jsonl", i + len(good) + len(bad)] for i in range(3)] == ["unknown_type", "unrecognized_user", "tail"]
    files = {r.path.rsplit("/", 1)[1]: r for r in transcripts.typed_files(seen).collect()}
    assert {k: f.supported for k, f in files.items()} == {"s1.jsonl": True, "s2.jsonl": False, "s3.jsonl": False, "s4.jsonl": True}
    assert (files["s1.jsonl"].unknown_origin_records, files["s1.jsonl"].structural_warnings, files["s1.jsonl"].generation, files["s1.jsonl"].truncated_tail) == (2, 1, "mixed", True)
    out = {(r.uuid, r.session_id): r for r in transcripts.typed_utterances(rows).collect()}
    assert {u for u, _ in out} == {"u1", "u2", "u3", "u4", "u5", "u6", "u7", "u1x"} and ("u1", "s4") not in out
    assert out["u2", "s1"].text == "one\n\ntwo" and out["u3", "s1"].text == "kept" and out["u3", "s1"].flags == ["session_id_mismatch"]
    assert out["u4", "s1"].flags == ["unknown_wrapper"] and out["u5", "s1"].flags == ["possible_paste"] and out["u7", "s1"].flags == ["truncated_tail_dropped"]


ID = "11111111-2222-3333-4444-555555555555"


def event(message, **more):
    return {"type": "event_msg", "timestamp": "2024-05-01T10:00:00Z", "payload": {"type": "user_message", "message": message} | more}


def item(text):
    return {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": text}, {"type": "other", "text": "-"}]}}


def test_rollouts(spark, tmp_path):
    head = lambda **p: {"type": "session_meta", "payload": {"id": ID, "timestamp": "2024-05-01T09:00:00Z"} | p}
    rows = lines_of(spark, tmp_path, {
        f"a-{ID}.jsonl": [head(cli_version="1.2"), event("hello"), event("plain one", kind="plain"), event("<environment_context>x"), event("not", kind="other"), event(" "), event("# AGENTS\nrest"), item("hello"), '{"cut'],
        f"b-{ID}.jsonl": [head(history_mode="paginated"), item("from b"), item("# AGENTS.md of")],
        "c.jsonl": [head(source={"x": [{"subagent": 1}]}), event("task")],
        "d.jsonl": [head(), "broken", event("x")],
        "e.jsonl": [{"record_type": "x"}],
        "f.jsonl": [head(history_mode="new"), event("x")],
        "g.jsonl": ['{"only'],
        "h.jsonl": ["[1]", "broken", "{}"],
        "i.jsonl": [{"type": "session_meta", "payload": {}}, event("x")],
        "j.jsonl": [head(note='a "subagent": word', source="subagent"), event("fine")],
    })
    found = transcripts.rollout_files(transcripts.rollout_lines(rows))
    files = {r.path.rsplit("/", 1)[1][0]: (r.status, r.generation) for r in found.collect()}
    assert files == {
        "a": ("supported", "legacy-events"), "b": ("supported", "paginated"), "c": ("supported", "legacy-events"), "d": ("malformed", "malformed"), "e": ("unsupported", "bare-items"), "f": ("unsupported", "unknown-history-mode"),
        "g": ("empty", "empty"), "h": ("unsupported", "unknown"), "i": ("unsupported", "missing-session-id"), "j": ("supported", "legacy-events"),
    }
    out = sorted((r.path.rsplit("/", 1)[1][0], r.text, float(r.confidence)) for r in transcripts.rollout_utterances(rows).collect())
    assert out == [("a", "hello", 0.9), ("a", "plain one", 0.95), ("b", "from b", 0.85), ("j", "fine", 0.9)]


def test_chats(spark, tmp_path):
    meta = {"sessionId": "x", "projectHash": "p", "startTime": "2024-05-01T09:00:00Z"}
    m = lambda i, c, **k: {"id": i, "type": "user", "timestamp": "2024-05-01T10:00:00Z", "content": c} | k
    chat = [
        meta, m("1", "first"), m("2", [{"text": "a"}, "b", {"thought": True, "text": "no"}, {"inlineData": {}}]), m("3", [{"functionCall": {}}]), m("4", "/help"), m("5", "expanded text", displayContent="shown"), m("6", "mine\n--- Content from referenced files ---\nrest"),
        m("7", [{"strange": 1}, "words"]), m("8", "<session_context>x"), m("9", "<tag>y"), {"$rewindTo": "1"}, {"$set": {"sessionId": "y"}}, m("1", "first, again"), {"id": "10", "type": "gemini", "content": "answer"}, {"id": "11", "type": "odd"}, {"zzz": 1},
    ]
    one = lines_of(spark, tmp_path / "a", {"c1.jsonl": chat, "c2.jsonl": [{"sessionId": "s", "projectHash": "p", "kind": "subagent"}, m("1", "hidden")], "c3.jsonl": ["bad", "bad", meta]})
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "d1.json").write_text(json.dumps({"sessionId": "doc", "messages": [m("1", "in a document"), 5]}))
    (tmp_path / "b" / "d2.json").write_text(json.dumps({"sessionId": "y", "messages": [m("1", "older copy of the session")]}))
    rows = transcripts.chat_lines(one).select("path", "line_no", "line_kind", "v", "tail", "malformed")
    docs = transcripts.chat_documents(records.files(spark, str(tmp_path / "b"))).select("path", "line_no", "line_kind", "v", "tail", "malformed")
    files = {r.path.rsplit("/", 1)[1]: r for r in transcripts.chat_files(rows.union(docs)).collect()}
    assert files["c1.jsonl"].supported and files["c1.jsonl"].session_id == "y" and files["c2.jsonl"].subagent and not files["c3.jsonl"].supported
    out = {r.message_id if r.session_id == "y" else r.session_id: r for r in transcripts.chat_utterances(rows.union(docs)).collect()}
    assert {k: r.text for k, r in out.items()} == {"1": "first, again", "2": "a\nb", "5": "shown", "6": "mine", "7": "words", "9": "<tag>y", "doc": "in a document"}
    assert out["2"].flags == ["multipart_no_display"] and out["5"].flags == ["expanded_content_present"] and out["6"].flags == ["reference_expansion_trimmed"] and out["7"].flags == ["unknown_part"] and out["9"].flags == ["unknown_wrapper"]


def test_tolerant_and_strict_lines(spark, tmp_path):
    rows = lines_of(spark, tmp_path, {"a": [{"i": 1, "text": "x"}, "no json", {"i": 2}, {"i": 3, "text": "y", "z": 1}, {"i": "4", "text": "y"}, [1], ""], "b": [{"i": 1, "text": "ok"}]})
    good, bad = records.tolerant(rows, {"i": "long", "text": "string"})
    assert sorted((r.path[-1], r.i, r.text) for r in good.collect()) == [("a", 1, "x"), ("b", 1, "ok")]
    assert [(r.item_ref.rsplit("/", 1)[1], r.code) for r in bad.orderBy("line_no").collect()] == [("a:2", "SCHEMA_INVALID_JSON"), ("a:3", "SCHEMA_MISSING_FIELD"), ("a:4", "SCHEMA_UNKNOWN_FIELD"), ("a:5", "SCHEMA_INVALID_VALUE"), ("a:6", "SCHEMA_INVALID_VALUE")]
    good, bad = records.strict(rows, {"i": "long", "text": "string"})
    assert [(r.path[-1], r.text) for r in good.collect()] == [("b", "ok")] and [r.code for r in bad.collect()] == ["SCHEMA_INVALID_JSON"]
    assert records.oversize(spark, str(tmp_path), most=30).count() == 1


def test_input_history(spark, tmp_path):
    (tmp_path / "a").write_text("\n# 2024-05-01 10:00:00.123456\n+first\n+ second line\n\n# not a time\n+undated\n# 2024-05-01 11:00:00\n+/help\n\n+{\n+x\n\n+kept\n\n+cut off")
    (tmp_path / "b").write_text("only\nprose\n")
    (tmp_path / "c").write_bytes(b"# 2024-05-01 11:00:00\n+ok \xff\xff\xff\n")
    found = records.files(spark, str(tmp_path))
    entries = histories.input_entries(found)
    files = {r.path[-1]: r for r in histories.input_files(found, entries).collect()}
    assert {k: f.supported for k, f in files.items()} == {"a": True, "b": False, "c": False} and files["a"].entry_count == 6 and files["a"].truncated_tail and files["a"].line_ending == "lf"
    out = [(r.ordinal, r.text, r.ts and r.ts.hour, r.flags) for r in histories.input_utterances(found).orderBy("ordinal").collect()]
    assert out == [(0, "first\n second line", 10, ["timezone_unknown"]), (1, "undated", None, ["undated"]), (4, "kept", 11, ["timezone_unknown", "truncated_tail_dropped"])]


def test_chat_markdown(spark, tmp_path):
    (tmp_path / "h").write_text("#### before\n# aider chat started at 2024-05-01 10:00:00\n\n#### one\n#### two\r\n\nanswer\n```\n#### in a fence\n```\n#### /add x\n#### after\n# aider chat started at never\n#### <blank>\n~~~\n#### x\n~~~\n#### last\n#### cut")
    out = [(r.banner, r.ordinal, r.text, r.flags[1]) for r in histories.chat_utterances(records.files(spark, str(tmp_path))).orderBy("banner", "ordinal").collect()]
    assert out == [(0, 0, "before", "undated"), (1, 0, "one\ntwo", "session_start_time_only"), (2, 1, "last", "undated")]


def database(path, script):
    con = sqlite3.connect(path)
    con.executescript(script)
    con.commit()
    con.close()


def test_part_stores(spark, tmp_path):
    part = lambda **k: json.dumps(k).replace("'", "''")
    database(tmp_path / "one.db", f"""CREATE TABLE session(id, project_id, parent_id, time_created, version); CREATE TABLE message(id, session_id, time_created, data); CREATE TABLE part(id, message_id, session_id, data);
    INSERT INTO session VALUES ('s1', 'p', NULL, 1, '1'), ('s2', 'p', 's1', 1, '1'); INSERT INTO message VALUES ('m1', 's1', 1714557600000, '{{"role": "user"}}'), ('m2', 's1', 5, '{{"role": "assistant"}}'), ('m3', 's2', 5, '{{"role": "user"}}'), ('m4', 's1', 5, 'bad'), ('m5', 'zz', 5, '{{"role": "user"}}'), ('m6', 's1', 5, '{{"role": "user"}}');
    INSERT INTO part VALUES ('b', 'm1', 's1', '{part(type="text", text=" second ")}'), ('a', 'm1', 's1', '{part(type="text", text="first")}'), ('c', 'm1', 's1', '{part(type="text", text="no", synthetic=True)}'), ('d', 'm3', 's2', '{part(type="text", text="task")}'), ('e', 'm6', 's1', '{part(type="file")}');""")
    database(tmp_path / "odd.db", "CREATE TABLE session(id);")
    (tmp_path / "broken.db").write_bytes(b"no database at all" * 100)
    stores_ = stores.store_files(spark, str(tmp_path))
    assert {(r.item_ref.rsplit("/", 1)[1], r.code) for r in stores.unsupported(stores.structure(stores_), stores.PART_STORE).collect()} == {("odd.db", "SOURCE_UNSUPPORTED_SCHEMA"), ("broken.db", "SOURCE_INACCESSIBLE")}
    tree = tmp_path / "storage"
    for name, doc in {"session/p/s1": {"id": "s1", "projectID": "p"}, "message/s1/m1": {"id": "m1", "role": "user"}, "message/s1/m9": {"id": "m9", "role": "user", "time": {"created": 1714557600000}}, "part/m9/x": {"id": "x", "type": "text", "text": "only in the tree"}, "part/m1/x": {"id": "x", "type": "text", "text": "older"}}.items():
        (tree / f"{name}.json").parent.mkdir(parents=True, exist_ok=True)
        (tree / f"{name}.json").write_text(json.dumps(doc))
    found = records.files(spark, str(tree), "*.json")
    both = stores.part_store_messages(stores_).unionByName(stores.part_tree_messages(found))
    out = {r.message_id: r for r in stores.part_utterances(both).collect()}
    assert {k: r.text for k, r in out.items()} == {"m1": "first\n\nsecond", "m9": "only in the tree"} and out["m1"].part_ids == ["a", "b"] and out["m1"].generation_text_mismatch and out["m1"].ts.hour == 10
    assert stores.tree_gate(found).count() == 0


def test_dictation_and_keys(spark, tmp_path):
    rows = ", ".join(f"('id{i}', 'words {i}', '2024-05-01 10:00:00.000 +00:00', 'com.x', 'c', 'formatted', 0, '1.0', 2, 'secret')" for i in range(300))
    database(tmp_path / "a.db", f"CREATE TABLE History(transcriptEntityId, asrText, timestamp, app, conversationId, status, isArchived, appVersion, numWords, audio); INSERT INTO History VALUES {rows}, ('id1', 'twice', NULL, NULL, ' ', 'dismissed', 1, NULL, 1, NULL), ('e', ' ', NULL, NULL, NULL, 'empty', 0, NULL, 0, NULL);")
    database(tmp_path / "b.db", "CREATE TABLE History(transcriptEntityId, asrText, timestamp); INSERT INTO History VALUES ('x', 'a', NULL), ('x', 'b', NULL), ('y', 'c', NULL);")
    database(tmp_path / "c.db", "CREATE TABLE cursorDiskKV(key, value); INSERT INTO cursorDiskKV VALUES ('composerData:1', '{}'), ('composerData:2', '{}'), ('composerDatb', 'x'), ('bubbleId:1:2', '{}');")
    found = stores.store_files(spark, str(tmp_path))
    read = stores.dictation_rows(found)
    files = {r.path.rsplit("/", 1)[1]: (r.seen, r.pk_anomalies, r.supported) for r in stores.dictation_files(read).collect()}
    assert files == {"a.db": (301, 2, True), "b.db": (3, 2, False)}
    out = stores.dictation_utterances(read, {"com.x": "editor"}).collect()
    assert len(out) == 299 and out[0].destination == "editor" and out[0].ts.hour == 10 and out[0].flags == ["nonuuid_pk"] and "audio" not in read.columns
    assert [(r.status, r.n) for r in stores.empty_by_status(read).collect()] == [("empty", 1)]
    assert sorted(r.key for r in stores.key_range(found, "composerData:").collect()) == ["composerData:1", "composerData:2"] and stores.has_keys(found, "bubbleId:").first().n == 1


def test_tasks(spark, tmp_path):
    say = lambda ts, say, **k: {"ts": 1714557600000 + ts, "type": "say", "say": say} | k
    use = {"role": "assistant", "content": [{"type": "tool_use", "name": "new_task", "input": {"message": "do  the thing"}}]}
    docs = {
        "t1/api.json": [{"role": "user", "content": [{"type": "text", "text": "<task>first task</task>"}, {"type": "text", "text": "<environment_details>x <task>no</task>"}]}, use, {"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "<feedback>so <explicit_instructions a>x</explicit_instructions></feedback><answer> </answer>"}]}]}, {"role": "user", "content": "<answer>open <answer>"}, {"role": "user", "content": "<answer>see (see below for file content)</answer>"}],
        "t2/api.json": [{"role": "user", "content": "<task>do the\nthing</task>"}],
        "t3/api.json": {"no": "list"},
    }
    for name, doc in docs.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(doc))
    found = records.files(spark, str(tmp_path), "*.json")
    rows = tasks.documents(found)
    assert [r.code for r in tasks.broken(found).collect()] == ["SOURCE_UNSUPPORTED_SCHEMA"]
    own = tasks.own_tasks(tasks.spans(tasks.payloads(rows)), tasks.new_task_arguments(rows))
    ui = rows.sparkSession.createDataFrame([(r.path, i, json.dumps(x)) for r in rows.select("path").distinct().collect() for i, x in enumerate([say(0, "task"), say(5000, "user_feedback"), say(9000, "other")])], "path string, record int, j string").select("path", "record", F.parse_json("j").alias("v"))
    out = [(r.text, r.wrapper, r.text_status, r.ts and r.ts.second) for r in tasks.timed(own, tasks.feedback_times(ui), F.lit(None).cast("timestamp")).orderBy("record", "block").collect()]
    assert out == [("first task", "task", "verbatim", 0), ("so", "feedback", "verbatim", 5), ("see (see below for file content)", "answer", "cleaned", None)]
    pay = spark.createDataFrame([("<task>a</task> <feedback>b <i>c</i></feedback>",), ("<task>a</task><answer>",), ("<task>x <environment_details></task>",), ('{"status": 1, "feedback": " good "}',), ("{}",)], "payload string")
    assert [(r.text, r.flags) for r in tasks.spans_any(pay).orderBy("text").collect()] == [("a", []), ("b <i>c</i>", ["unknown_wrapper"])]
    assert [r.text for r in tasks.status_feedback(pay).collect()] == ["good"]


def state(*blocks, **root):
    return json.dumps({"root": {"type": "root", "children": list(blocks)} | root})


def words(x):
    return {"type": "text", "text": x}


def para(*children, kind="paragraph"):
    return {"type": kind, "children": list(children)}


def mention(name, key="mentionName"):
    return {"type": "mention", key: name}


def test_composers(spark):
    head = lambda i, **k: ("s", f"composerData:{i}", json.dumps({"_v": 12, "composerId": i, "createdAt": 1714557600000, "fullConversationHeadersOnly": [{"bubbleId": b, "type": t} for b, t in (("b1", 1), ("b2", 2), ("b3", 1))]} | k))
    bubble = lambda c, b, **k: ("s", f"bubbleId:{c}:{b}", json.dumps({"_v": 3, "type": 1, "text": f"text {b}", "richText": state(para(words(f"text {b}")))} | k))
    items = [head("a", subComposerIds=["sub"]), head("sub"), head("n", isBestOfNSubcomposer=True), head("x", conversationMap={"k": 1}), ("s", "composerData:y", "{bad"), head("z", composerId="other"), head("m"), bubble("a", "b1"), bubble("a", "b3", isNudge=True), bubble("sub", "b1"), bubble("m", "b1"), ("s", "other", "x")]
    table = lambda rows: spark.createDataFrame(rows, "path string, key string, value string")
    rows = table(items)
    assert {r.composer_id: r["class"] for r in composers.composers(rows).collect()} == {"a": "current", "sub": "current", "n": "current", "x": "embedded", "y": "malformed", "z": "id_mismatch", "m": "current"}
    assert [(r.composer_id, r.text, r.gate, r.ts.hour) for r in composers.utterances(rows).collect()] == [("a", "text b1", "verbatim_exact", 10)]
    gate = composers.store_gate(rows).first()
    assert (gate.composers, gate.current, gate.embedded, gate.malformed, gate.id_mismatch, gate.best_of_n, gate.sub_composers, gate.missing, gate.fetched, gate.kept, gate.supported, gate.composer_versions) == (7, 4, 1, 1, 1, 1, 1, 1, 3, 1, True, [12])
    leak = table([*items, head("w"), bubble("w", "b1", text="<attached x"), bubble("w", "b3")])
    assert composers.utterances(leak).count() == 0
    # A bubble without a state, or in conflict with it, gives no text; a store in which a quarter of the states conflict gives none at all.
    more = [head("p"), bubble("p", "b1", richText=None), bubble("p", "b3", richText=state(para(words("OTHER text"))))]
    assert composers.utterances(table([*items, *more])).count() == 0  # one of two states
    calm = [x for i in range(3) for x in (head(f"q{i}"), bubble(f"q{i}", "b1"), bubble(f"q{i}", "b3"))]
    found = composers.store_gate(table([*items, *more, *calm])).first()
    assert (found.verbatim, found.no_editor_state, found.text_projection_mismatch, found.drifted, found.consistent) == (7, 1, 1, False, True)
    assert {r.composer_id for r in composers.utterances(table([*items, *more, *calm])).collect()} == {"a", "q0", "q1", "q2"}
    broken = [("s", f"bubbleId:r{i}:b{k}", "{bad") for i in range(1) for k in (1, 3)]
    assert not composers.store_gate(table([*items, *calm, head("r0"), *broken])).first().supported  # two malformed of eleven


def reference_projection(node):
    """Text and mentions of a node, by recursion."""
    if not isinstance(node, dict):
        return "", []
    kind = node.get("type")
    if kind == "text":
        return (node["text"] if isinstance(node.get("text"), str) else ""), []
    if kind in ("tab", "linebreak"):
        return {"tab": "\t", "linebreak": "\n"}[kind], []
    if kind == "mention":
        name = next((node[k] for k in ("mentionName", "name", "label", "text") if isinstance(node.get(k), str) and node[k].strip()), "")
        return name, [name] if name else []
    parts = [reference_projection(c) for c in node["children"]] if isinstance(node.get("children"), list) else []
    return "".join(p[0] for p in parts), [n for p in parts for n in p[1]]


def test_editor_states(spark):
    rng = random.Random(6)

    def tree(depth):
        if depth == 0 or rng.random() < 0.35:
            return rng.choice([words(rng.choice(["a", "b c", "", "é"])), {"type": "tab"}, {"type": "linebreak"}, mention(rng.choice(["f.py", "f", " "])), mention("g", "label"), {"type": "text", "text": 3}, {"type": "image"}, 7, None, {"children": [words("u")]}])
        return para(*[tree(depth - 1) for _ in range(rng.randint(0, 4))], kind=rng.choice(["paragraph", "list", "paragraph", 5]))

    deep = para(words("bottom"))
    for _ in range(40):
        deep = para(deep)
    states = [[tree(rng.randint(0, 6)) for _ in range(rng.randint(1, 4))] for _ in range(120)] + [[deep, words("x")]]
    rows = spark.createDataFrame([(i, state(*s)) for i, s in enumerate(states)], "i int, rich string").repartition(4)
    got = {r.i: r.p for r in rows.select("i", editor_states.projection(F.col("rich")).alias("p")).collect()}
    for i, blocks in enumerate(states):
        parts = [reference_projection(b) for b in blocks]
        assert got[i].text == "\n".join(p[0] for p in parts), blocks
        assert list(got[i].names) == [n for p in parts for n in p[1]]
    assert "<untyped>" in {u for p in got.values() for u in p.unknown} and "list" in {u for p in got.values() for u in p.unknown}
    none = [None, "", " ", "{", "[]", "{}", '{"root": 1}', '{"root": {"children": []}}', '{"root": {"children": {}}}', '"x"']
    empty = spark.createDataFrame([(x,) for x in none], "rich string").select(editor_states.projection(F.col("rich")).alias("p"))
    assert {r.p for r in empty.collect()} == {None}
    odd = spark.createDataFrame([(state(para(words("x")), type="page"),)], "rich string").select(editor_states.projection(F.col("rich")).alias("p")).first().p
    assert (odd.text, list(odd.unknown)) == ("x", ["page"])


def test_gates_and_mentions(spark):
    ask = state(para(words("see "), mention("util.py"), words(" and "), mention("util"), words(" now")), para(words("bye")))
    cases = {
        ("see util.py and util now\nbye", ask): ("verbatim_exact", "see and now\nbye"),
        ("see util.py  and util now bye", ask): ("verbatim_whitespace", "see and now bye"),
        ("see @util.py and @util now\nbye", ask): ("verbatim_mention_sigil", "see and now\nbye"),
        ("  see @util.py and @util now\nbye", ask): ("verbatim_mention_sigil", "see and now\nbye"),
        ("something else", ask): ("text_projection_mismatch", None),
        ("x", None): ("no_editor_state", None),
        ("plain  text", state(para(words("plain  text")))): ("verbatim_exact", "plain  text"),
        # A name that is also a word of the prose goes once only, the longer name first.
        ("a test of test and test.x", state(para(words("a "), mention("test"), words(" of test and "), mention("test.x")))): ("verbatim_exact", "a of test and"),
        ("@f f @f", state(para(mention("f"), words(" f "), mention("f")))): ("verbatim_mention_sigil", "f"),
        ("only.py", state(para(mention("only.py")))): ("verbatim_exact", ""),
    }
    rows = spark.createDataFrame([(i, t, r) for i, (t, r) in enumerate(cases)], "i int, text string, rich string").withColumn("s", editor_states.projection(F.col("rich")))
    rows = rows.withColumn("g", editor_states.gate(F.col("text"), F.col("s"))).withColumn("own", F.when(F.col("g").isin(*formats.VERBATIM_GATES), editor_states.without_mentions(F.col("text"), F.col("s.names"))))
    assert [(r.g, r.own) for r in rows.orderBy("i").collect()] == list(cases.values())


def test_scans_merge(spark, tmp_path):
    """States of parts merge to that of the whole, and a refresh scans changed files only."""
    rng = random.Random(2)
    rows = [(f"f{rng.randint(0, 9)}", rng.choice(["a", "b"]), rng.choice([None, 1, 2, 3]), rng.choice([None, 5, 9])) for _ in range(300)]
    scan = states.Scan(sums={"n": F.expr("true"), "twos": F.col("v") == 2}, least={"low": F.col("t")}, greatest={"high": F.col("t")}, sets={"vs": F.col("v")})
    whole = spark.createDataFrame(rows, "file string, inst string, v int, t int")
    want = {r.inst: r for r in scan.of(whole, "inst").collect()}
    for parts in (1, 3, 7):
        split = functools.reduce(DataFrame.union, [scan.of(spark.createDataFrame(rows[i::parts], whole.schema), "inst") for i in range(parts)])
        assert {r.inst: r for r in scan.merged(split, "inst").collect()} == want
    schema, path = "file string, inst string, n long, twos long, low int, high int, vs array<int>", f"{tmp_path}/inv"
    listed = lambda files: spark.createDataFrame([(f, s) for f, s in files.items()], "file string, stamp string")
    of = lambda table: lambda fresh: scan.of(table.join(fresh, "file", "left_semi"), "file", "inst")
    files = {f: "1" for f in {r[0] for r in rows}}
    assert states.refresh(path, listed(files), of(whole), schema) == len(files)
    assert {r.inst: r for r in states.inventory(spark, path, schema, scan, "inst").collect()} == want
    assert states.refresh(path, listed(files), of(whole), schema) == 0
    changed = [r for r in rows if r[0] != "f3"] + [("f3", "a", 8, 1)]
    later = spark.createDataFrame([r for r in changed if r[0] != "f5"], whole.schema)
    now = {f: "2" if f == "f3" else "1" for f in files if f != "f5"}
    assert states.refresh(path, listed(now), of(later), schema) == 1
    assert {r.inst: r for r in states.inventory(spark, path, schema, scan, "inst").collect()} == {r.inst: r for r in scan.of(later, "inst").collect()}
