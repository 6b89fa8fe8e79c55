import json
import os

from pyspark.sql import functions as F

from threadloom.operators import search, sync, tools
from threadloom.sources import live


def test_summaries():
    s = tools.call_summary
    assert s("Bash", '{"command":" ls "}') == "ls" and s("shell", "make x") == "make x" and s("Read", '{"path":"/a"}') == "/a"
    assert s("Grep", '{"pattern":"x","path":"src"}') == "x in src" and s("glob", '{"pattern":"*.py"}') == "*.py" and s("apply_patch", "a\n*** Add File: q\n") == "*** Add File: q" and s("apply_patch", "x") == "(patch)"
    assert s("odd", '{"a":1,"b":"t","c":[1],"d":true,"e":"u","f":2}') == "a: 1, b: t, d: true, e: u" and s("odd", '{"a":"' + "é" * 80 + '"}') == "a: " + "é" * 50
    assert s(None, None) == "null" and s("odd", "[1, 2]") == "[1,2]"


def test_readable_and_decoded():
    v = {"a": " x ", "b": ["x", "y", {"type": "image_file", "t": "no"}], "metadata": "no", "callId": "no", "c": '{"d": [1, true, null]}', "e": "data:image/png;x", "f": "{cut"}
    assert tools.readable(v) == "x\ny\n1\ntrue\n{cut"
    assert tools.decoded('{"a":"[1, \\"{\\\\\\"b\\\\\\":2}\\"]"}') == {"a": [1, {"b": 2}]}
    assert tools.pick({"Name": 1, "NAME": 2, "x": 3}, "y", "name") == 1


def test_captured():
    v = {"cwd": "/w/", "input": {"path": "a\\b", "file_path": ["f1", "f2/"], "uri": ["file:///x%20y", "http://no"]}, "path": "no", "args": json.dumps({"path": "in"}), "z": {"type": "directory", "path": "d"}, "trackedFileBackups": {"k.py": 1}}
    got = tools.captured(v)
    assert got["dirs"] == ["/w", "d"] and got["files"] == ["f1", "f2", "k.py"] and set(got["paths"]) == {"/w", "d", "f1", "f2", "k.py", "a/b", "/x y", "in"}
    assert tools.captured({"changes": {"c": {}}}, "rollout")["files"] == ["c"] and tools.clean_path("C:/") == "C:/" and tools.clean_path("  ") is None


def test_authored():
    text = "# AGENTS.md instructions for /x\n\n<INSTRUCTIONS>\na\n</INSTRUCTIONS>\n<environment_context>e</ENVIRONMENT_CONTEXT> <external_a b>t</external_a b>\n## My request for Codex:\n do it "
    assert tools.authored(text) == "do it" and tools.authored("<skill>x</skill>") is None and tools.authored(None) is None and tools.authored("<skill>open") == "<skill>open"


def test_generated_kinds(spark):
    u = "01234567-89ab-cdef-0123-456789abcdef"
    wrap = lambda b: f"{tools._PREAMBLE}\n<SYSTEM_MESSAGE>\n{b}\n</SYSTEM_MESSAGE>"
    m = lambda sender, text: wrap(f"[Message] timestamp=2026-01-01T00:00:00Z sender={sender} priority=MESSAGE_PRIORITY_HIGH content={text}")
    cases = [
        ("SYSTEM", "CHECKPOINT", "x", "checkpoint"), ("SYSTEM", "DIRECTORY_RULES", "x", "directory_rules"), ("SYSTEM", "ERROR_MESSAGE", "x", "error"), ("USER", "CHECKPOINT", "x", None), ("SYSTEM", "CHECKPOINT", " ", None),
        ("SYSTEM", "SYSTEM_MESSAGE", wrap("Stop hook blocked termination: no"), "hook_feedback"), ("SYSTEM", "SYSTEM_MESSAGE", m(u, "hello\nyou"), "agent_message"), ("SYSTEM", "SYSTEM_MESSAGE", m("who", "hello"), None),
        ("SYSTEM", "SYSTEM_MESSAGE", m(f"{u}/task-3", f'Task id "{u}/task-3" finished with result: ok'), "task_finished"), ("SYSTEM", "SYSTEM_MESSAGE", m(f"{u}/task-3", f'Task id "{u}/task-4" finished with result: ok'), None),
        ("SYSTEM", "SYSTEM_MESSAGE", m(f"{u}/task-3", f'Task id "{u}/task-3" was canceled with result: ok'), "task_canceled"), ("SYSTEM", "SYSTEM_MESSAGE", m(f"{u}/task-3", "Check it"), "task_reminder"),
        ("SYSTEM", "SYSTEM_MESSAGE", m(f"{u}/task-3", "The command output has stabilized for 5 s"), "task_stalled"), ("SYSTEM", "SYSTEM_MESSAGE", m("system", "[Notice] All your subagents and background tasks have been stopped due to server restart."), "restart_notice"),
        ("SYSTEM", "SYSTEM_MESSAGE", m("system", "The subagent x encountered an error and has either stopped or failed to start execution: y"), "subagent_error"), ("SYSTEM", "SYSTEM_MESSAGE", "plain", None), (None, "CHECKPOINT", None, None),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, s string, t string, c string")
    got = {r.i: r.k for r in df.select("i", tools.generated_kind(F.col("s"), F.col("t"), F.col("c")).alias("k")).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}


def test_pairing_in_order(spark):
    rows = [("s", 1, "call", "Read"), ("s", 2, "call", "run-it"), ("s", 3, "result", "RUN_IT"), ("s", 4, "result", "other"), ("s", 5, "result", "x"), ("s", 6, "call", "y")]
    got = {(r.call_step, r.result_step) for r in tools.paired_in_order(spark.createDataFrame(rows, "session string, step int, kind string, name string")).collect()}
    assert got == {(2, 3), (1, 4), (None, 5), (6, None)}


def test_questions(spark):
    ask = json.dumps({"questions": [{"id": "q", "question": "Go?", "options": [{"label": "yes"}]}, {"id": "p", "question": "Key?", "isSecret": True}]})
    rows = [
        (1, 1, 1, ("function_call", "c1", "request_user_input", ask, None)), (2, 1, 2, ("function_call_output", "c1", None, None, json.dumps({"answers": {"q": {"answers": ["yes"]}, "p": ["k"]}}))),
        (3, 1, 3, ("function_call", "c2", "a.request_user_input_async", ask, None)), (4, 1, 4, ("function_call_output", "c2", None, None, '{"accepted":true}')), (5, 1, 5, ("function_call", "c3", "shell", "{}", None)),
    ]
    df = spark.createDataFrame(rows, "row_id int, file_id int, line_no int, payload struct<type:string,call_id:string,name:string,arguments:string,output:string>")
    got = {r.line_no: (r.role, r.text) for r in tools.questions(df).collect()}
    assert got == {1: ("assistant", "Go?\n- yes\n\nKey?"), 2: ("user", "Go?\nyes\n\nKey?\n[secret]"), 3: ("assistant", "Go?\n- yes\n\nKey?")}
    named = tools.with_summaries(spark.createDataFrame([("bash", '{"cmd":"ls"}'), (None, None)], "name string, arguments string"))
    assert [r.summary for r in named.collect()] == ["ls", "null"]
    paths = tools.with_paths(spark.createDataFrame([('{"cwd":"/a"}',), (None,)], "j string"), "j", "rollout").collect()
    assert paths[0].captured.dirs == ["/a"] and paths[1].captured.paths == []


def test_projection_fingerprints_and_live(spark, tmp_path):
    hits = spark.createDataFrame([(1, "content", 3, 9)], "doc_id int, field string, start int, end int")
    origins = spark.createDataFrame([(1, "content", "a", 0, 5), (1, "content", "b", 7, 20), (1, "content", "c", 9, 30), (1, "user", "d", 0, 9), (2, "content", "e", 0, 9)], "doc_id int, field string, source string, start int, end int")
    assert sorted(tuple(r)[2:] for r in search.projected(hits, origins).collect()) == [("a", 3, 5), ("b", 0, 2)]
    lines = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("p", 3, " ")], "path string, line_no int, line string")
    assert tuple(sync.fingerprints(lines).first())[:2] == ("p", 2)
    files = spark.createDataFrame([("p", bytearray(b"x"), None)], "path string, content binary, signature string")
    assert sync.content_checksums(files).first().crc > 0
    rel = spark.createDataFrame([("c", "p")], "child string, parent string")
    f = lambda *v: spark.createDataFrame(list(v), "path string, fingerprint string")
    assert sync.still_valid(rel, f(("c", "1"), ("p", "1")), f(("c", "1"), ("p", "1"))).count() == 1 and sync.still_valid(rel, f(("c", "1"), ("p", "1")), f(("c", "1"), ("p", "2"))).count() == 0
    for n, r in enumerate(({"pid": os.getpid(), "sessionId": "s1"}, {"pid": os.getpid(), "sessionId": "s2", "startTicks": 1}, {"pid": 2**30, "sessionId": "s3"}, {})):
        (tmp_path / f"{n}.json").write_text(json.dumps(r))
    assert [r.session_id for r in live.snapshot(spark, {"a": str(tmp_path), "b": str(tmp_path / "no")}).collect()] == ["s1"]
    d = search.discovery(spark.createDataFrame([("s", "x " * 600, 1.0)], "session_id string, last_msg_content string, score double")).first()
    assert len(d.last_msg_content) == 512 and d.score == 1.0
