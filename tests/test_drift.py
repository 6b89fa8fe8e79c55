import json
import random

from threadloom.operators import drift



def json_type(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int | float):
        return "number"
    return "string" if isinstance(value, str) else "object" if isinstance(value, dict) else "array"


def kind_and_body(record):
    payload = record.get("payload")
    body = payload if isinstance(payload, dict) else record
    first = (payload.get("type") if isinstance(payload, dict) else None, record.get("type"), record.get("record_type"))
    return next((x for x in first if isinstance(x, str) and x), "session_meta"), body


SCHEMA = "file_id long, producer string, file_seq int, line_no int, line string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def line(kind, **payload):
    return json.dumps({"type": "event_msg", "payload": {"type": kind, **payload}})


def got(spark, rows):
    return {tuple(r) for r in drift.changes(frame(spark, rows)).collect()}


def test_each_change(spark):
    rows = [
        (1, "p", 1, 1, line("m", a="x", b=1, c="keep", o={"k": 1, "old": "v"}, gone=True)),
        (1, "p", 1, 2, '{"type":"event_msg","payload":{"type":"m","late":'),
        (2, "p", 3, 1, line("m", b="1", c="keep", a2="x", o={"k": 1, "new": "v"}, fresh=[1], nothing=None)),
        (2, "p", 3, 2, line("other", z=1)),
        (3, "p", 2, 1, line("none", q=1)),
        (4, "q", 9, 1, line("m", b=1)),
    ]
    assert got(spark, rows) == {
        (2, "m", "b", "retyped"), (2, "m", "a2", "renamed"), (2, "m", "gone", "removed"), (2, "m", "fresh", "added"), (2, "m", "o.new", "renamed"),
    }


def test_objects_are_compared_where_both_have_them(spark):
    rows = [(1, "p", 1, 1, line("m", o={"k": 1})), (2, "p", 2, 1, line("m", o="text")), (3, "p", 3, 1, line("m", o={"j": 2}))]
    assert got(spark, rows) == {(2, "m", "o", "retyped"), (3, "m", "o", "retyped")}


def test_bare_records_and_kinds(spark):
    rows = [
        (1, "p", 1, 1, '{"id":"i","timestamp":"t"}'), (1, "p", 1, 2, '{"record_type":"state"}'), (2, "p", 2, 1, '{"type":"session_meta","payload":{"id":"i2","cwd":"/"}}'),
        (2, "p", 2, 2, "[1]"), (2, "p", 2, 3, "null"), (2, "p", 2, 4, None), (2, "p", 2, 5, '{"record_type":"state","x":1}'),
    ]
    assert got(spark, rows) == {(2, "session_meta", "timestamp", "removed"), (2, "session_meta", "cwd", "added"), (2, "state", "x", "added")}


def test_empty_and_nulls(spark):
    assert got(spark, []) == set()
    assert got(spark, [(None, None, None, None, None), (1, "p", 1, 1, "")]) == set()


def brute(rows):
    files = {}
    for f, p, s, _, text in rows:
        try:
            record = json.loads(text)
        except (TypeError, ValueError):
            continue
        kind, body = kind_and_body(record)
        kinds = files.setdefault((p, s, f), {})
        fields = kinds.setdefault(kind, {})

        def walk(o, prefix, top=False):
            for k, v in o.items():
                if v is None or top and k in ("type", "record_type"):
                    continue
                t, values = fields.setdefault(prefix + k, (set(), set()))
                t.add(json_type(v))
                if json_type(v) in ("string", "number"):
                    values.add((json_type(v), v))
                if isinstance(v, dict):
                    walk(v, prefix + k + ".")

        walk(body, "", True)
    out = set()
    for (p, s, f), kinds in files.items():
        for kind, new in kinds.items():
            before = [(q, g) for (pp, q, g), kk in files.items() if pp == p and q < s and kind in kk]
            if not before:
                continue
            old = files[(p, *max(before))][kind]

            def shared_object(path):
                parent = path.rpartition(".")[0]
                return not parent or all("object" in x.get(parent, (set(), set()))[0] for x in (old, new))

            added = [x for x in new if x not in old and shared_object(x)]
            removed = [x for x in old if x not in new and shared_object(x)]
            for a in list(added):
                for r in list(removed):
                    if a.rpartition(".")[0] == r.rpartition(".")[0] and new[a][1] & old[r][1]:
                        out.add((f, kind, a, "renamed"))
                        added.remove(a)
                        removed.remove(r)
                        break
            out |= {(f, kind, x, "added") for x in added} | {(f, kind, x, "removed") for x in removed}
            out |= {(f, kind, x, "retyped") for x in new if x in old and shared_object(x) and new[x][0] != old[x][0]}
    return out


def test_against_brute_force(spark):
    rng, rows = random.Random(3), []
    for f in range(40):
        names = rng.sample(["a", "b", "c", "d"], rng.randrange(1, 5))
        for n in range(3):
            body = {k: rng.choice([f"{k}v", 1.5, True, None, [1], {"x": rng.choice([1, "s"]), f"y{rng.randrange(2)}": "c" + k}]) for k in names if rng.random() < 0.8}
            rows.append((f, f"p{f % 3}", f, n, line(rng.choice(["k1", "k2"]), **body)))
    assert got(spark, rows) == brute(rows)


def test_unified(spark):
    lines = spark.createDataFrame([("s", 1, 1, line("m", a=1, B="x")), ("s", 1, 2, line("m", a="t", b=True)), ("s", 1, 3, "{cut"), ("t", 2, 1, '{"record_type":"state","src_table":"c"}')], "src_table string, file_id long, line_no int, line string")
    out = drift.unified(lines)
    assert {"a", "a__number", "a__string", "src_table_2"} <= set(out.columns)
    seen = {(r.src_file_id, r.src_line_no): r for r in out.collect()}
    assert len(seen) == 3 and seen[1, 1].a == "1" and seen[1, 1].a__number == 1.0 and seen[1, 2].a__number is None and seen[1, 2].a__string == "t" and seen[2, 1].record_kind == "state"


def test_unified_splits_conflicts_inside_objects(spark):
    lines = spark.createDataFrame(
        [
            ("s", 1, 1, line("m", p={"net": True, "deep": {"n": 1, "it's": "q"}})), ("s", 1, 2, line("m", p={"net": "on", "deep": {"n": "one"}})), ("s", 1, 3, line("m", p="text")),
            ("s", 1, 4, line("m", **{"x.y": 1})), ("s", 1, 5, line("m", x={"y": "z"})), ("s", 1, 6, line("m", p={"net": None, "deep": [{"n": 2}]})),
        ],
        "src_table string, file_id long, line_no int, line string",
    )
    out = drift.unified(lines)
    seen = {r.src_line_no: r.asDict() for r in out.collect()}
    column = lambda name: [seen[k][name] for k in sorted(seen)]
    assert column("p.net") == ["true", "on", None, None, None, None]
    assert column("p.net__boolean") == [True, None, None, None, None, None] and column("p.net__string") == [None, "on", None, None, None, None]
    assert column("p.deep.n__number") == [1.0, None, None, None, None, None] and column("p.deep.n__string") == [None, "one", None, None, None, None]
    assert column("p.deep.it's") == ["q", None, None, None, None, None] and column("p.deep__array")[5] == '[{"n":2}]' and column("p__string")[2] == "text"
    assert column("x.y") == [None, None, None, "1", None, None] and column("x.y_2") == [None, None, None, None, "z", None]


def test_fused_keeps_every_type(spark):
    rows = [(1, "p", 1, 1, line("m", o={"k": 1})), (1, "q", 1, 1, line("m", o={"k": "1"})), (2, "p", 2, 1, line("m", o=None)), (3, None, None, 1, line("m", o=True))]
    got = {(r.record_kind, r.field_path, tuple(r.types), r.files) for r in drift.fused(frame(spark, rows)).collect()}
    assert got == {("m", "o", ("boolean", "object"), 3), ("m", "o.k", ("number", "string"), 2)}


def test_unified_with_any_key(spark):
    keys = ["a'b", 'a"b', "a'\"b", "back\\slash", "", "d.o[t", "'\"[."]
    lines = spark.createDataFrame([("s", 1, k, line("m", o={key: k})) for k, key in enumerate(keys)], "src_table string, file_id long, line_no int, line string")
    for r in drift.unified(lines).collect():
        assert r[f"o.{keys[r.src_line_no]}"] == str(r.src_line_no)


def test_records_of_any_depth_and_number(spark):
    deep = '{"type":"m","payload":{"type":"m","d":' + '{"x":' * 400 + "1" + "}" * 400 + ',"a":' + "[" * 100_000 + "]" * 100_000 + "}}"
    long = '{"type":"m","payload":{"type":"m","n":' + "7" * 5_000 + "}}"
    rows = [(1, "p", 1, 1, deep), (1, "p", 1, 2, long), (2, "p", 2, 1, line("m", k=None)), (2, "p", 2, 2, long.replace('"n"', '"m"'))]
    found = got(spark, rows)
    assert found == {(2, "m", "d", "removed"), (2, "m", "a", "removed"), (2, "m", "m", "renamed")}


def test_a_repeated_key_counts_by_its_last_value(spark):
    rows = [(1, "p", 1, 1, '{"type":"m","a":{"x":1},"a":2,"\\u0062":1}'), (2, "p", 2, 1, '{"type":"m","a":3,"b":"1"}')]
    assert got(spark, rows) == {(2, "m", "b", "retyped")}
    same = [(1, "p", 5, 1, line("m", a=1)), (2, "p", 5, 1, line("m", b=2)), (None, "p", 6, 1, line("m", c=1)), (3, None, 1, 1, line("m", c=1)), (4, None, 2, 1, line("m"))]
    assert got(spark, same) == {(4, "m", "c", "removed")}
