import datetime as dt

from threadloom.llm import conversations as c

SCHEMA = (
    "row_id long, sessionId string, uuid string, parentUuid string, timestamp timestamp, type string, isSidechain boolean, isMeta boolean, message struct<role:string,content:string>, "
    "session string, depth int, event int"
)


def frame(spark, rows):
    t = dt.datetime(2026, 1, 1)
    full = []
    for k, (session, uuid, parent, kind, content, *flags) in enumerate(rows):
        f = dict(flags[0]) if flags else {}
        message = None if content is ... else (f.get("role", kind), content)
        full.append((k, session, uuid, parent, f.get("t", t + dt.timedelta(seconds=k)), kind, f.get("side"), f.get("meta"), message, "x", 1, 2))
    return spark.createDataFrame(full, SCHEMA)


def faults(spark, rows):
    return {r.session_id: r.fault for r in c.faults(frame(spark, rows)).collect()}


def test_each_fault(spark):
    rows = [
        ("ok", "a1", None, "user", "hi"), ("OK", "a2", "A1", "assistant", "yes"),
        ("empty", "b1", None, "user", " \n"), ("empty", "b2", "b1", "assistant", "[]"), ("only-meta", "b3", None, "user", "x", {"meta": True}), ("side", "b4", None, "user", "x", {"side": True}), ("none", None, None, "file-history-snapshot", ...),
        ("lost", "c1", "gone", "user", "hi"), ("lost", "c2", "c1", "assistant", "yes"),
        ("loop", "d1", "d2", "user", "hi"), ("loop", "d2", "d1", "assistant", "yes"),
        ("mute", "e1", None, "user", "hi"), ("mute", "e2", "e1", "assistant", '""'),
        ("via", "f1", None, "user", "hi"), ("via", "f2", "f1", "system", None), ("via", "f3", "f2", "user", "m", {"meta": True}), ("via", "f4", "f3", "assistant", "yes"),
        ("goes-on", "g1", "a2", "user", "more"), ("goes-on", "g2", "g1", "assistant", "yes"),
        ("other-session", "h1", None, "user", "hi"), ("ok", "h2", "h1", "assistant", "yes"),
        ("side-reply", "i1", None, "user", "hi"), ("side-reply", "i2", "i1", "assistant", "yes", {"side": True}),
        ("blank-ask", "j1", None, "user", None), ("blank-ask", "j2", "j1", "assistant", "yes"), ("role", "k1", None, "assistant", "tool", {"role": "user"}), ("role", "k2", "k1", "user", "yes", {"role": "assistant"}),
        ("null-role", "l1", None, "user", "hi", {"role": None}), ("null-role", "l2", "l1", "assistant", "yes", {"role": None}), (None, "m1", None, "user", "hi"),
    ]
    assert faults(spark, rows) == {"empty": "empty", "only-meta": "empty", "side": "empty", "none": "empty", "lost": "broken", "loop": "broken", "mute": "no_reply", "other-session": "no_reply", "side-reply": "no_reply"}


def test_first_fault_holds_and_repeats_count_once(spark):
    rows = [("s", "a", "gone", "user", " "), ("t", "b", "gone", "user", "hi"), ("u", "c", None, "user", "hi"), ("u", "d", "c", "assistant", "yes"), ("u", "c", None, "user", "hi"), ("v", None, "x", "user", "q"), ("w", None, None, "user", "q")]
    assert faults(spark, rows) == {"s": "empty", "t": "broken", "v": "broken", "w": "no_reply"}


def test_long_chains_of_meta_rows(spark):
    rows = [("s", "u0", None, "user", "hi")] + [("s", f"u{i}", f"u{i - 1}", "system", None) for i in range(1, 12)] + [("s", "end", "u11", "assistant", "yes")]
    assert faults(spark, rows) == {}
    assert faults(spark, rows[:-1]) == {"s": "no_reply"}


def test_order_and_empty(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [("s", "b", "a", "assistant", "2", {"t": None}), ("s", "a", None, "user", "1", {"t": t}), ("s", "d", "c", "assistant", "4"), ("s", "c", "b", "user", "3"), ("s", "d", "c", "assistant", "4"), ("s", "e", "b", "assistant", " ")]
    got = [(r.session_id, r.turn_no, r.speaker, r.content) for r in c.conversations(frame(spark, rows)).orderBy("turn_no").collect()]
    assert got == [("s", 1, "user", "1"), ("s", 2, "assistant", "2"), ("s", 3, "user", "3"), ("s", 4, "assistant", "4")]
    assert c.faults(frame(spark, [])).count() == 0 and c.conversations(frame(spark, [])).count() == 0


def test_branches_do_not_mix(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [
        ("s", "a", None, "user", "ask"), ("s", "b", "a", "assistant", "first answer"), ("s", "c", "b", "user", "more"), ("s", "d", "a", "assistant", "again"), ("s", "e", "c", "assistant", "on the first"),
        ("s", "f", "d", "user", "edited"), ("s", "g", "f", "assistant", "last"), ("s", None, "g", "assistant", "no id"), ("s", "z", None, "user", "later tree", {"t": t + dt.timedelta(hours=1)}), ("s", "y", "z", "assistant", "yes", {"t": None}),
    ]
    got = [(r.content, r.active) for r in c.conversations(frame(spark, rows)).orderBy("turn_no").collect()]
    assert got == [
        ("ask", True), ("first answer", False), ("more", False), ("on the first", False), ("again", True), ("edited", True), ("last", True), ("no id", True), ("later tree", True), ("yes", False),
    ]


def test_functions_of_stretches_compose():
    import random

    rng = random.Random(5)
    monoid = c.Monoid()
    for _ in range(300):
        symbols = [rng.choice([c.NOTHING, c.REPLY, *range(c.MESSAGE, c.MESSAGE + 8)]) + rng.choice([0, 16]) for _ in range(rng.randrange(30))]
        state = 0
        for s in symbols:
            state = c.step(state, s)
        end, at = 0, 0
        while at < len(symbols):
            size = rng.randrange(1, 9)
            function = 0
            for s in symbols[at : at + size]:
                function = monoid.after(function, s)
            end, at = monoid.functions[function][end], at + size
        assert end == state
    assert len(monoid.functions) < 400


def test_speakers_are_users_and_assistants(spark):
    rows = [("s", "a", None, "user", "hi", {"role": "narrator"}), ("s", "b", "a", "assistant", "yes", {"role": "model"})]
    assert [r.speaker for r in c.conversations(frame(spark, rows)).orderBy("turn_no").collect()] == ["user", "assistant"]
