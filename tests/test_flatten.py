import json
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.operators import flatten, structure

SCALARS = st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=6) | st.sampled_from(['"', "\\", '\\"', "[{", "}],:", "é\n"])
VALUES = st.recursive(SCALARS, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(exclude_characters=".", codec="utf-8"), max_size=4), x, max_size=4), max_leaves=25)


def brute(value):
    out = []

    def walk(v, path, near):
        if isinstance(v, list):
            for i, x in enumerate(v):
                p = f"{path}[{i}]"
                if isinstance(x, dict):
                    out.append((p, near, x))
                walk(x, p, p if isinstance(x, dict) else near)
        elif isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{path}.{k}", near)

    walk(value, "", "")
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=4), st.booleans(), st.booleans())
def test_index_against_brute_force(values, ascii_, tight):
    texts = [json.dumps(v, ensure_ascii=ascii_, separators=(",", ":") if tight else (" ,\n", " :\t")) for v in values]
    got = [sorted((p, n, json.dumps(json.loads(b), sort_keys=True)) for p, n, b in g) for g in flatten.index(texts)]
    want = [sorted((p, n, json.dumps(x, sort_keys=True)) for p, n, x in brute(v)) for v in values]
    assert got == want


def test_nodes(spark):
    schema = "row_id long, place string, message struct<content:array<struct<type:string,text:string,thinking:string,name:string,id:string,tool_use_id:string,input:string,is_error:boolean,content:array<struct<type:string,text:string>>>>>"
    block = lambda **k: tuple(k.get(n) for n in ("type", "text", "thinking", "name", "id", "tool_use_id", "input", "is_error", "content"))
    rows = [
        (1, "x", ([block(type="tool_use", input='{"edits":[{"a":1},null,{"b":[{"c":[[{}]]}]}]}'), None, block(type="tool_result", content=[("text", "t"), None, ("text", None)])],)),
        (2, "x", ([block(input='{"edits":[{"a":')],)), (2, "x", ([block(input='{"edits":[{"a":')],)), (3, "x", None), (4, "x", ([],)), (5, "x", (None,)), (6, "x", ([block(input="[{}]"), block(input=""), block(input='{"x":NaN}')],)),
    ]
    df = spark.createDataFrame(rows, schema)
    got = Counter((r.row_id, r.node_path, r.parent_path) for r in flatten.nodes(df, body=False).collect())
    e = "content[0].input.edits"
    assert got == Counter({
        (1, "content[0]", ""): 1, (1, f"{e}[0]", "content[0]"): 1, (1, f"{e}[2]", "content[0]"): 1, (1, f"{e}[2].b[0]", f"{e}[2]"): 1, (1, f"{e}[2].b[0].c[0][0]", f"{e}[2].b[0]"): 1,
        (1, "content[2]", ""): 1, (1, "content[2].content[0]", "content[2]"): 1, (1, "content[2].content[2]", "content[2]"): 1,
        (2, "content[0]", ""): 2, (6, "content[0]", ""): 1, (6, "content[1]", ""): 1, (6, "content[2]", ""): 1, (6, "content[0].input[0]", "content[0]"): 1,
    })
    bodies = {r.node_path: r.body for r in flatten.nodes(df).where("row_id = 1").collect()}
    assert json.loads(bodies[f"{e}[0]"]) == {"a": 1} and json.loads(bodies["content[2].content[0]"])["text"] == "t"
    assert flatten.nodes(df.limit(0)).count() == 0
    assert flatten.blocks(df).where("row_id = 1").count() == 2


def test_texts_of_any_depth_and_number(spark):
    deep = "[" * 100_000 + '{"a":[{"b":1}]}' + "]" * 100_000
    assert [p for p, _, _ in flatten.index([deep])[0]] == ["[0]" * 100_000, "[0]" * 100_000 + ".a[0]"]
    digits = '{"n":' + "1" * 5_000 + ',"e":[{"x":1}]}'
    assert [p for p, _, _ in flatten.index([digits, digits[:-1], None, digits])[3]] == [".e[0]"]
    df = spark.createDataFrame([(1, ([(digits, None)],)), (2, ([(deep, None)],))], "row_id long, message struct<content:array<struct<input:string,content:array<struct<text:string>>>>>")
    assert Counter(r.row_id for r in flatten.nodes(df, body=False).collect()) == {1: 2, 2: 3}


def test_what_is_no_json():
    bad = ['{"a":1,}', "[1 2]", '{"a" 1}', '{1:2}', "[01]", "[1.]", '["\\x"]', '["\n"]', "[}", "{]", "[]]", "[[]", '"a', "", " ", "nul", "[,]", '{"a":}', "1,2", '["\\u12g4"]', ":", "[1:2]", '{"a","b"}', "{}{}", "[NaN]"]
    good = ["[]", "{}", "1", '"a"', " [ ] ", '{"a":{"b":[]}}', '["\\u1234\\\\"]', "-1.5e+3", "null", '{"":[{}]}']
    index = structure.Index(pa.array(bad + good))
    assert index.good.tolist() == [False] * len(bad) + [True] * len(good)
