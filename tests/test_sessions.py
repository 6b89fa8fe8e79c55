import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators import history, lineage, projection, scans, sessions, sync
from threadloom import rules, sinks


def test_scans_equal_plain_windows(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}", i, rng.choice([None, i % 7]), rng.randrange(3)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, v int, w int")
    up = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select("o", F.coalesce(F.sum("v").over(up), F.lit(0)).alias("s"), F.max("v").over(before).alias("m"), F.last("v", ignorenulls=True).over(up).alias("l"), F.last("v", ignorenulls=True).over(before).alias("p"))
    got = scans.running_sum(df, "k", ["o"], F.col("v"), "s", size=16)
    got = scans.running_max(got, "k", ["o"], "v", "m", size=16)
    got = scans.running_last(got, "k", ["o"], F.col("v"), "l", size=16)
    got = scans.running_last(got, "k", ["o"], F.col("v"), "p", size=16, strict=True).select("o", "s", "m", "l", "p")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_noise(spark):
    rows = [(1, "u1", None, "<command-name>/exit</command-name>"), (2, "u2", "u1", "<local-command-stdout>bye"), (3, "u3", "u9", "<local-command-stdout>stays"), (4, "u4", None, "<local-command-caveat>x"), (5, None, None, None)]
    df = spark.createDataFrame(rows, "row_id int, uuid string, parentUuid string, text string")
    assert sorted(r.row_id for r in sessions.without_noise(df).collect()) == [3, 5]


def test_patch_and_plan(spark):
    patch = "*** Begin Patch\n*** Add File: a.py\n+x\n+y\n*** Update File: b c.py \n@@\n-o\n+n\n k\n*** Delete File: d\n*** End Patch"
    got = {(r.n, r.op, r.path, r.added, r.removed) for r in sessions.patch_files(spark.createDataFrame([(1, patch), (2, "nothing"), (3, None)], "k int, t string"), "k", "t").collect()}
    assert got == {(1, "add", "a.py", 2, 0), (2, "update", "b c.py", 1, 1), (3, "delete", "d", 0, 0)}
    df = spark.createDataFrame([('{"plan":[{"step":"a","status":"pending"}]}',), ('{"plan":[{"step":"a","status":"odd"}]}',), ('{"plan":[]}',), ("{",)], "t string")
    assert [r.x and [tuple(i) for i in r.x] for r in df.select(sessions.plan_items(F.col("t")).alias("x")).collect()] == [[("a", "pending")], None, None, None]


def test_turns_and_aborts(spark):
    df = spark.createDataFrame([("s", 1, "agent"), ("s", 2, "user"), ("s", 3, "agent"), ("s", 4, "user"), ("s", 5, "aborted"), ("t", 1, "user")], "s string, o int, k string")
    turned = sessions.user_turns(df, "s", ["o"], F.col("k") == "user")
    assert [r.turn for r in turned.where("s = 's'").orderBy("o").collect()] == [0, 1, 1, 2, 2]
    assert [tuple(r) for r in sessions.trailing_aborted(turned, ["s"], F.col("k") == "aborted").collect()] == [("s", 2, 2)]


def test_visibility(spark):
    masks = {k: v for k, v in [("tool", 4), ("think", 512), ("plan", 0)]}
    df = spark.createDataFrame(list(masks.items()), "k string, m int")
    assert {r.k for r in df.where(projection.visible(F.col("m"), projection.Display())).collect()} == {"tool", "plan"}
    assert projection.SHOW_ALL.hidden() == 0 and projection.Display().hidden() == 16 + 64 + 512
    every, seen, not_seen = (set(projection.default_masks(m, projection.Display())) for m in ("all", "visible", "hidden"))
    assert seen | not_seen == every and not seen & not_seen and 512 in not_seen and not_seen == {512, 16, 64, 66, 17, 65} and len(projection.masks()) == 15
    cases = [
        ("user", "# AGENTS.md instructions for /x\ny", False, None, 17), ("system", " CLAUDE.md instructions", None, None, 16), ("user", "# AGENTS.md instructions x", False, None, 1), ("user", "hi", True, None, 65), ("assistant", "hi", True, None, 2),
        ("user", "<codex_internal_context a='1'>x</codex_internal_context>\n<goal_context>y</goal_context> ", None, None, 65), ("user", "<goal_context>y</goal_context> and more", None, None, 1), ("assistant", None, None, None, 2), ("user", "<skill>x</skill>", None, None, 33),
        ("user", "<skill>x", None, None, 1), ("user", "<task-notification>x</task-notification>", None, None, 8), ("system", "x", None, "checkpoint", 2), ("summary", "x", None, "task_reminder", 64), ("summary", "x", None, None, 0), ("user", "<INSTRUCTIONS>x</INSTRUCTIONS>", None, None, 17),
    ]
    t = spark.createDataFrame(cases, "r string, t string, c boolean, k string, m int")
    got = t.select("m", projection.message_mask(F.col("r"), F.col("t"), F.col("c"), F.col("k")).alias("n")).collect()
    assert [r.n for r in got] == [r.m for r in got]
    foot = spark.createDataFrame([("a\n<oai-mem-citation>x</oai-mem-citation>\n",), ("```\n<oai-mem-citation>x</oai-mem-citation>",)], "t string").select(projection.citation_footer(F.col("t")).alias("x")).collect()
    assert tuple(foot[0].x) == ("a", "<oai-mem-citation>x</oai-mem-citation>") and foot[1].x.footer is None
    assert spark.createDataFrame([(" ", "b\nc", None)], "a string, b string, c string").select(projection.preview(F.col("a"), F.col("b"), F.col("c")).alias("p")).first().p == "b c"


LINEAGE = "key string, agent string, session_id string, fork_parents array<string>, trashed boolean, safe boolean, modified long, events array<string>, inherited array<string>, own long, activity array<string>, aborted struct<events:array<string>,active:boolean,lines:string>, turns array<struct<lines:string,last:string>>"


def node(key, agent, parents, events, inherited=(), own=0, modified=1, trashed=False, safe=True, activity=(), aborted=None, turns=()):
    return (key, agent, key.upper(), list(parents), trashed, safe, modified, list(events), list(inherited), own, list(activity), aborted, list(turns))


def superseded(spark, *nodes):
    return {r.key: r.superseded_by for r in lineage.superseded(spark.createDataFrame(list(nodes), LINEAGE)).collect()}


def test_superseded_copies(spark):
    a = node("a", "transcript", [], ["1", "2"], own=2)
    assert superseded(spark, a, node("b", "transcript", ["A"], ["3"], ["1", "2"], own=1)) == {"a": "B"}
    assert superseded(spark, a, node("b", "transcript", ["A"], ["3"], ["1"], own=1)) == {}
    assert superseded(spark, a, node("b", "transcript", ["A"], [], ["1", "2"], modified=5)) == {"a": "B"}
    assert superseded(spark, a, node("b", "transcript", ["A"], ["3"], ["1", "2"], own=1, trashed=True)) == {}
    assert superseded(spark, a, node("b", "transcript", ["A"], ["3"], ["1", "2"], own=1, safe=False)) == {}
    siblings = superseded(spark, a, node("b", "transcript", ["A"], ["3"], ["1", "2"], own=1, modified=9), node("c", "transcript", ["A"], ["4", "5"], ["1", "2"], own=2, modified=2))
    assert siblings == {"a": "C"}


def test_successors_are_followed(spark):
    chain = [node("a", "transcript", [], ["1"], own=1), node("b", "transcript", ["A"], ["2"], ["1"], own=1), node("c", "transcript", ["B"], ["3"], ["2"], own=1)]
    assert superseded(spark, *chain) == {"a": "C", "b": "C"}


def test_superseded_rollouts(spark):
    a = node("a", "rollout", [], ["1", "2", "3"], aborted=(["3"], False, "h"))
    assert superseded(spark, a, node("b", "rollout", ["A"], ["1", "2", "3", "4"])) == {"a": "B"}
    assert superseded(spark, a, node("b", "rollout", ["A"], ["1", "2"])) == {"a": "B"}  # only the empty aborted turn is gone: equal, the leaf stays
    assert superseded(spark, a, node("b", "rollout", ["A"], ["1", "2", "5"], activity=["5"])) == {"a": "B"}
    assert superseded(spark, a, node("b", "rollout", ["A"], ["1", "2", "5"])) == {}
    busy = node("a", "rollout", [], ["1", "2", "3"], aborted=(["3"], True, "h"))
    assert superseded(spark, busy, node("b", "rollout", ["A"], ["1", "2", "5"], activity=["5"])) == {}
    assert superseded(spark, busy, node("b", "rollout", ["A"], ["1", "2", "5"], activity=["5"], turns=[("h", "5")])) == {"a": "B"}
    cycle = superseded(spark, node("a", "bundle", ["B"], ["1"]), node("b", "bundle", ["A"], ["1"]))
    assert cycle == {}


def test_components_and_chains(spark):
    v = spark.createDataFrame([(i,) for i in range(30)], "v int")
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(25, 24), (5, 5)], "a int, b int")
    got = {r.v: r.root for r in lineage.components(v, e).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[25] == got[24] == 24 and got[29] == 29
    p = spark.createDataFrame([(i, i + 1) for i in range(13)] + [(100, 101), (101, 100), (102, 100)], "v int, to int")
    ends = {r.v: r.last for r in lineage.followed(p).collect()}
    assert all(ends[i] == 13 for i in range(13)) and ends[100] is ends[101] is ends[102] is None


MEMBERS = "path string, agent string, thread_id string, rollout_id string, history_base string, fork_parent string, trashed boolean"


def test_plans(spark):
    m = spark.createDataFrame(
        [("p1", "rollout", "t1", "r1", None, None, False), ("p2", "rollout", "t2", "r2", "r1", None, False), ("p3", "rollout", "t2", "r3", None, None, False), ("p4", "rollout", "t4", "r4", "r2", None, True), ("p5", "rollout", "t5", "r5", "r4", "t1", False), ("p6", "x", "t1", "r1", None, None, False), ("p7", "rollout", "t7", "r7", "r9", None, True)],
        MEMBERS,
    )
    seed = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    moved, blocked = lineage.plan(m, seed("p1", "p4", "zz"), "trash")
    assert {r.path for r in moved.collect()} == {"p1", "p2", "p3", "p5"} and {r.path for r in blocked.collect()} == {"p4", "zz"}
    moved, _ = lineage.plan(m, seed("p5"), "trash")
    assert {r.path for r in moved.collect()} == {"p5"}
    moved, blocked = lineage.plan(m, seed("p7"), "restore")
    assert {r.path for r in moved.collect()} == {"p7"} and {r.blocker for r in blocked.collect()} == {"history it needs is gone"}
    t = spark.createDataFrame([(f"q{k}", "rollout", "t", f"q{k}", None, None, k > 1) for k in range(5)], MEMBERS)
    assert {r.path for r in lineage.plan(t, seed("q4"), "restore")[0].collect()} == {"q2", "q3", "q4"} and {r.path for r in lineage.plan(t, seed("q1"), "trash")[0].collect()} == {"q0", "q1"}
    policies = spark.createDataFrame([(1, "skip"), (2, "include")], "group int, policy string")
    chosen = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "c", False)], "group int, member string, chosen boolean")
    assert [tuple(r) for r in lineage.skipped_groups(chosen, policies).collect()] == [(1, "b")]
    live = spark.createDataFrame([("rollout", "t2", "running")], "agent string, session_id string, protection string")
    assert {r.blocker for r in lineage.plan(m, seed("p1"), "trash", live)[1].collect()} == {"in use: running"}
    assert {r.path for r in lineage.related(m, seed("p4")).collect()} == {"p1", "p2", "p3", "p4", "p5"}
    assert {r.rollout_id for r in lineage.ambiguous_ids(m).collect()} == {"r1"}
    g = spark.createDataFrame([(1, "trash", "a"), (2, "trash", "a"), (3, "trash", "b"), (4, "untrash", "b")], "group int, op string, member string")
    merged, clash = lineage.merged_groups(g)
    assert {(r.group, r.merged) for r in merged.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)} and [r.member for r in clash.collect()] == ["b"]


def test_histories(spark):
    lines = [
        ("f1", 1, '{"type":"session_meta","ordinal":0,"payload":{"id":"A"}}'), ("f1", 2, '{"ordinal":1}'), ("f1", 3, '{"ordinal":1}'), ("f1", 4, "{cut"),
        ("f2", 1, '{"type":"session_meta","payload":{"id":"B","history_base":{"thread_id":"A","end_ordinal_exclusive":1}}}'), ("f2", 2, '{"x":1}'),
        ("f3", 1, '{"type":"session_meta","payload":{"id":"C","history_base":{"thread_id":"Z"}}}'),
        ("f4", 1, '{"type":"session_meta","payload":{"id":"D","history_base":{"thread_id":"E"}}}'), ("f5", 1, '{"type":"session_meta","payload":{"id":"E","history_base":{"thread_id":"D"}}}'), ("f6", 1, '{"id":"F"}'), ("f6", 2, "x"),
    ]
    df = spark.createDataFrame(lines, "path string, line_no long, line string")
    h = history.headers(df).cache()
    assert {r.path: r.thread_id for r in h.collect()} == {"f1": "A", "f2": "B", "f3": "C", "f4": "D", "f5": "E", "f6": "F"}
    members = h.select("thread_id", F.col("thread_id").alias("rollout_id"), "path", "base_id", "base_end_ordinal", "base_end_byte", F.lit(False).alias("trashed"))
    tip = history.tips(members)
    assert {r.path: r.status for r in tip.collect()} == {f"f{i}": "complete" for i in range(1, 7)}
    segments, issues = history.chains(members, tip)
    assert [(r.seg, r.segment_path, r.end_ordinal) for r in segments.where("path = 'f2'").orderBy("seg").collect()] == [(1, "f1", 1), (2, "f2", None)]
    status = {r.path: (r.status, r.issues) for r in history.statuses(tip, issues).collect()}
    assert status["f2"] == ("complete", []) and status["f3"] == ("incomplete", ["missing history"]) and status["f4"] == ("incomplete", ["cyclic history"])
    read = [(r.seg, r.line_no, r.flaw) for r in history.bounded(df, segments.where("path = 'f2'")).orderBy("seg", "line_no").collect()]
    assert read == [(1, 1, None), (1, 4, "malformed"), (2, 1, None), (2, 2, None)]
    assert {r.flaw for r in history.bounded(df, segments.where("path = 'f1'")).collect()} == {None, "malformed", "ordinal regression"}
    two = spark.createDataFrame([("T", "r1", "/a/x.jsonl", None, False), ("T", "r2", "/a/y.jsonl.zst", "r1", False), ("T", "r3", "/a/z.jsonl", "r1", False)], "thread_id string, rollout_id string, path string, base_id string, trashed boolean")
    assert {(r.path, r.status) for r in history.tips(two).collect()} == {("/a/y.jsonl.zst", "ambiguous"), ("/a/z.jsonl", "ambiguous")}
    chosen = spark.createDataFrame([("T", "/A/y.jsonl", True)], "thread_id string, selected_path string, paginated boolean")
    assert {(r.path, r.status) for r in history.tips(two, chosen).collect()} == {("/a/y.jsonl.zst", "complete")}
    gone = spark.createDataFrame([("T", "/q", True)], "thread_id string, selected_path string, paginated boolean")
    assert {r.status for r in history.tips(two, gone).collect()} == {"ambiguous"}


def test_sync(spark, tmp_path):
    schema = "path string, mtime long, size long, agent string, trashed boolean, original_path string, signature string"
    old = spark.createDataFrame([("a", 1, 1, "x", False, None, None), ("b", 1, 1, "x", False, None, None), ("c", 1, 1, "x", None, None, None)], schema)
    new = spark.createDataFrame([("a", 1, 1, "x", False, None, None), ("b", 2, 1, "x", False, None, None), ("d", 1, 1, "x", False, None, None)], schema)
    c = sync.detect(new, old)
    assert {r.path: r.change for r in c.collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "new"}
    assert tuple(sync.statistics(c).first()) == (3, 2, 1, 1)
    assert {(r.path, r.mtime) for r in sync.upserted(old, new.where("path IN ('b', 'd')"), c.where("change = 'deleted'")).collect()} == {("a", 1), ("b", 2), ("d", 1)}
    store = sync.Store(spark, f"file://{tmp_path}/index")
    assert store.current() is None and store.read("state") is None
    store.commit({"state": old})
    first = store.current()
    store.commit({"state": new})
    assert store.current() != first and {r.path for r in store.read("state").collect()} == {"a", "b", "d"}
    store.delete()
    assert store.current() is None and len(sync.profile_id(["/a"])) == 16


def test_rules(spark):
    m = spark.createDataFrame([("s1", 1, "user", "hé"), ("s1", 2, "assistant", "b"), ("s2", 1, "user", "x"), ("s2", 2, "user", "y"), ("s3", 1, "assistant", "z")], "session_id string, turn_no long, speaker string, content string")
    s = spark.createDataFrame([("s1", "/a", "f1"), ("s2", "/b", "f2"), ("s3", "/c", "f3")], "session_id string, cwd string, fingerprint string")
    r = rules.Rules()

    @r.rule("few", max_turns=1)
    def few(c):
        assert c["turns"][0]["text"].limit(2, "|") in ("h|", "z", "b")
        return [rules.trash("few"), rules.nothing("  ")]

    @r.rule("odd", min_turns=2, at_startup=False)
    def odd(c):
        return {"action": "delete"}

    out = rules.evaluate(s, m, r).cache()
    parts = rules.report(out)
    assert {(x.rule, x.session_id, x.action) for x in parts["proposals"].collect()} == {("few", "s1", "trash"), ("few", "s3", "trash")}
    assert [(x.rule, x.session_id) for x in parts["errors"].collect()] == [("odd", "s2")] and parts["remarks"].count() == 0
    assert {x.session_id for x in rules.evaluate(s, m, r, startup=True).collect()} == {"s1", "s3"}
    kept = rules.evaluate(s, m, r, protected=s.where("session_id = 's1'"), known=s.where("session_id = 's3'").select("session_id", "fingerprint"))
    assert {x.session_id for x in kept.collect()} == {"s2"}
    slow = rules.Rules()

    @slow.rule("slow")
    def endless(context):
        if context["session"]["session_id"] == "s1":
            while True:
                pass
        return endless(context) if context["session"]["session_id"] == "s2" else rules.trash("ok")

    found = {x.session_id: (x.action, (x.error or "").split(":")[0]) for x in rules.evaluate(s, m, slow, seconds=0.3).collect()}
    assert found == {"s1": (None, "TimeoutError"), "s2": (None, "RecursionError"), "s3": ("trash", "")}
    proposals = spark.createDataFrame([("r", "s3", "trash"), ("r", "s1", "trash"), ("r", "s2", "trash"), ("r", "s4", "trash")], "rule string, session_id string, action string")
    prints = lambda *rows: spark.createDataFrame(list(rows), "session_id string, fingerprint long")
    ready, skipped = rules.rechecked(proposals, s.where("session_id = 's2'"), prints(("s1", 1), ("s2", 1), ("s3", 1), ("s4", 1)), prints(("s1", 1), ("s2", 1), ("s3", 2)))
    assert [x.session_id for x in ready.collect()] == ["s1"] and {(x.session_id, x.skipped) for x in skipped.collect()} == {("s2", "in use"), ("s3", "changed"), ("s4", "changed")}
    assert rules.exported(s, m).count() == 3
    for bad in ({"name": ""}, {"name": "few"}, {"name": "n", "min_turns": -1}, {"name": "n", "min_turns": 3, "max_turns": 2}, {"name": "n", "color": 1}, {"name": "n", "dependency_policy": "x"}):
        try:
            r.rule(bad.pop("name"), **bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_sinks(spark):
    turns = spark.createDataFrame([("s", 2, "assistant", "````\ncode", None), ("s", 1, "user", "hi", None)], "session_id string, turn_no int, speaker string, content string, timestamp timestamp")
    text = sinks.markdown(turns).first().text
    assert text.index("## User") < text.index("## Assistant") and "turns: 2" in text
    tool = turns.withColumn("speaker", F.when(F.col("turn_no") == 2, "tool_result").otherwise(F.col("speaker")))
    assert "`````\n````\ncode\n`````" in sinks.markdown(tool).first().text
    assert sorted((r.part, r.text.count("# ")) for r in sinks.markdown(turns, size=1).collect()) == [(1, 2), (2, 1)]
    assert sinks.plain_text(turns).first().text == "[user] hi\n[assistant] ````\ncode"
    assert turns.where("turn_no = 2").select(sinks.fence(F.col("content")).alias("f")).first().f == "`" * 5
    d = spark.createDataFrame([(1, "2026-01-02", "a", "0123456789", "Ünï: title!  " + "x" * 60), (2, "2026-01-02", "a", "0123456700", None), (3, "2026-01-02", "a", "0123456711", " ")], "k int, d string, a string, i string, t string")
    named = d.select("k", sinks.file_stem(F.to_date("d"), F.col("a"), F.col("i"), F.col("t")).alias("stem"))
    names = {r.k: r.file_name for r in sinks.file_names(named, "k").collect()}
    assert names[1].startswith("2026-01-02-a-01234567-ünï-title-xxx") and len(names[1]) == len("2026-01-02-a-01234567-") + 48 + 3
    assert names[2] == "2026-01-02-a-01234567.md" and names[3] == "2026-01-02-a-01234567-1.md"
    h = spark.createDataFrame([("ab c", 1), ("abxc", 5), ("ab c", 9), ("zz", 2)], "query string, saved_at int")
    assert [tuple(r) for r in sinks.history_updated(h, h.limit(0), 2).collect()] == [("ab c", 9), ("abxc", 5)]
    assert [r.query for r in sinks.fuzzy_recall(h.where("saved_at > 1"), "abc").collect()] == ["ab c", "abxc"] and sinks.fuzzy_recall(h, "ABC").count() == 0
    long = spark.createDataFrame([("x " * 600,)], "t string")
    assert len(sinks.compact_json(long).first().value) < 530 < len(sinks.full_json(long).first().value)


def test_native_summaries(spark):
    rows = [(1, "S", "summary", None, "a"), (2, "s", "system", "away_summary", "b"), (3, "s", "system", "other", "c"), (4, "s", "summary", None, " "), (5, None, "summary", None, "d")]
    df = spark.createDataFrame(rows, "row_id int, sessionId string, type string, subtype string, summary string")
    assert [tuple(r) for r in sessions.summaries(df).collect()] == [("s", "b")]


def test_sync_of_whole_deliveries(spark):
    from threadloom.queries_sessions import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/basic_session.parquet").where("sessionId IS NOT NULL")
    found = {r.path: r.change for r in QUERIES["sync_whole"](spark, sf).collect()}
    assert set(found) == {r[0].lower() for r in rows.select("sessionId").distinct().collect()}  # the full state on both sides
    state = spark.createDataFrame([("a", 1), ("b", 1), ("gone", 1)], "path string, mtime long").selectExpr("*", "1L size", "'x' agent", "false trashed", "cast(null as string) original_path", "cast(null as string) signature")
    assert {(r.path, r.change) for r in sync.detect(state.where("path <> 'gone'"), state).collect()} == {("a", "unchanged"), ("b", "unchanged"), ("gone", "deleted")}
