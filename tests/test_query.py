"""The query grammar, and agreement of the column evaluator with a plain one and with postings."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.operators import search
from threadloom.plans import query as ql

WORDS = {
    "w1": "continental", "w2": "controversial", "w3": "contal", "w4": "quiet", "w5": "quick", "w6": "quid", "w7": "qui", "w8": "conversion", "w9": "person", "w10": "son",
    "w11": "intercontinental continentally squid personal", "w12": "cont al qu i s on",
}


@pytest.fixture(scope="module")
def words(spark):
    return search.indexed(spark.createDataFrame(list(WORDS.items()), "doc_id string, text string"), {"content": "text", "user": "text"}).cache()


def found(df, text, **k):
    return {r.doc_id for r in search.matching(df, text, **k).collect()}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("cont*al", {"w1", "w2", "w3"}), ("CONT**AL", {"w1", "w2", "w3"}), ("<cont.*al>", {"w1", "w2", "w3"}), ("qui*", {"w4", "w5", "w6", "w7"}), ("user:qui*", {"w4", "w5", "w6", "w7"}),
        ("*s*on", {"w8", "w9", "w10"}), ("user:(cont*al OR *s*on)", {"w1", "w2", "w3", "w8", "w9", "w10"}), ("cont*al NOT *vers*", {"w1", "w3"}), ("cont*al qui*", set()),
        ('"cont*al"', {"w12"}), (r"cont\*al", {"w12"}), ("*", set(WORDS)), ("NOT *", set()), ("", set(WORDS)), ("quiet OR quick", {"w4", "w5"}), ("quiet -quick", {"w4"}),
        ("-quiet", set(WORDS) - {"w4"}), ("continent*", {"w1", "w11"}), ("[qui TO quick]", {"w5", "w7"}), ("{qui TO quick}", set()), ("IN [son quid]", {"w6", "w10"}), ("user:*", set(WORDS)),
        ('"qu i"', {"w12"}), ('"s al"~5', {"w12"}), ('"al s"~3', {"w12"}), ('"cont a"*', {"w12"}), ("quiet^3", {"w4"}), ("(quiet", {"w4"}), ("quiet)", {"w4"}), ("<(?=q)uiet>", set()), ("unknown:quiet", set()),
    ],
)
def test_matches(words, text, want):
    assert found(words, text) == want


def test_modes_and_diagnostics():
    assert ql.extract_mode("Hidden: a b") == ("a b", "hidden", None)
    assert ql.extract_mode('"all: x" (visible:)')[1] == "visible"
    assert ql.extract_mode("all: hidden:")[2] and ql.extract_mode("all: all: x")[1] == "all"
    assert ql.extract_mode("hall: x") == ("hall: x", None, None)
    assert ql.parse("a ) b").diagnostics and ql.parse("nofield:x").diagnostics
    assert not ql.parse('"a b c"~2').certain and ql.parse('"a b"~2').certain
    assert ql.parse("two words").bare and not ql.parse('"two words"').bare and not ql.parse("a AND b").bare
    assert ql.highlight_terms('user:foo AND "bar baz" NOT qux* -no') == ["foo", "bar", "baz", "qux"]


def test_folding():
    assert ql.fold(ql.parse("* OR a").tree) is True
    assert ql.fold(ql.parse("a NOT *").tree) is False
    assert ql.fold(ql.parse("IN [ ]").tree) is False


TERMS = ["ab", "cd", "ef", "gh"]
EXPR = st.recursive(st.sampled_from([*TERMS, '"ab cd"', '"cd ef"', "a*", "<[ce].>"]), lambda x: st.builds("({} AND {})".format, x, x) | st.builds("({} OR {})".format, x, x) | st.builds("({} NOT {})".format, x, x), max_leaves=5)


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(TERMS) for _ in range(rng.randrange(0, 5)))) for i in range(40)]
    df = search.indexed(spark.createDataFrame(docs, "doc_id int, text string"), {"content": "text"}).cache()
    return df, search.postings(df, "doc_id", df.text).cache()


@settings(max_examples=12, deadline=None)
@given(text=EXPR)
def test_two_evaluators_agree(small, text):
    df, index = small
    assert found(df, text) == {r.doc_id for r in search.by_postings(index, df, "doc_id", text).collect()}


def test_scores(spark):
    docs = [(1, "alpha beta", 100), (2, "alpha alpha gamma", 50), (3, "beta", 10), (4, "", 1)]
    df = search.indexed(spark.createDataFrame(docs, "doc_id int, text string, modified_ts long"), {"content": "text"})
    got = {r.doc_id: r.score for r in search.scored(df, "alpha OR gamma").collect()}
    assert got[1] == pytest.approx(search.bm25(1, 2, 4, 2, 1.5)) and got[2] == pytest.approx(search.bm25(2, 2, 4, 3, 1.5) + search.bm25(1, 1, 4, 3, 1.5))
    phrase = {r.doc_id: r.score for r in search.scored(df, "alpha beta").collect()}
    assert set(phrase) == {1} and phrase[1] > 5 * search.bm25(1, 2, 4, 2, 1.5)
    top = [r.doc_id for r in search.search(df, search.Request("alpha", sort="relevance", now=100, limit=0)).collect()]
    assert len(top) == 1
    assert [r.doc_id for r in search.search(df, search.Request(limit=2)).collect()] == [1, 2]


def test_filters_scope_and_dates(spark):
    rows = [
        (1, "a", "s1", "main", "/work/x/", None, 100, 5, "original", False, None), (2, "b", "s2", None, "/WORK//x", "/else", 200, 9, "sub_agent", False, None),
        (3, "a", "s3", "main", None, "/work/x/../x", 300, 1, "continued", True, None), (4, "a", "s4", "dev", "/work/./x", None, 400, 7, "original", None, "s1"),
    ]
    df = spark.createDataFrame(rows, "doc_id int, agent string, session_id string, branch string, project string, cwd string, modified_ts long, lines int, derivation_type string, trashed boolean, superseded_by string")
    ids = lambda f, scope=None, **k: {r.doc_id for r in search.search(df, search.Request(filters=f, scope=scope, limit=99), **k).collect()}
    assert ids(search.Filters()) == {1}
    assert ids(search.Filters(include_sub_agents=True, trashed=None, superseded=None)) == {1, 2, 3, 4}
    assert ids(search.Filters(trashed=True)) == {3} and ids(search.Filters(superseded=True)) == {4} and ids(search.Filters(branch="dev", superseded=None)) == {4}
    assert ids(search.Filters(include_sub_agents=True, after=100, before=200, min_lines=6)) == {2}
    assert ids(search.Filters(include_sub_agents=True, trashed=None, superseded=None), "/work/x") == {1, 2, 4}
    live = spark.createDataFrame([("a", "s1"), ("a", "s1")], "agent string, session_id string")
    assert ids(search.Filters(live_only=True), live=live) == {1}
    assert search.Filters().active() == 0 and search.Filters(agent="x", trashed=None).active() == 2 and search.Filters().merged({"agent": "q", "branch": None}).agent == "q"
    assert search.parse_date("1970-01-02", False) == 86400 and search.parse_date("1970-01-01", True) == 86399 and search.parse_date("1970-01-01T00:01:00Z", False) == 60
    assert search.parse_dir("/a/b:dev") == ("/a/b", "dev") and search.parse_dir("/a/b") == ("/a/b", None)
    with pytest.raises(ValueError):
        search.parse_dir("/a:b", "c")
    with pytest.raises(ValueError):
        search.parse_date("1970-01-01T00:00:00", False)


def test_snippet():
    text = "x " * 100 + "the <Needle> in\n\n hay " + "y " * 200
    out = search.snippet(text, ["needle", "in"])
    assert out.startswith("…") and out.endswith("…") and "&lt;<b>Needle</b>&gt; <b>in</b>" in out
    assert search.snippet("a b", []) == "a b" and search.snippet(None, ["a"]) == ""


def test_snippets_of_columns_equal_the_plain_ones(spark):
    texts = ["x " * 100 + "the <Needle> in\n\n hay " + "y " * 200, "needle", "a & b <lt> in in", "", None, "  no  hit ", "Needle " * 60, "inneedle needle2 (needle)"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for query in ("needle in", "lt amp", "*"):
        got = [r.snippet for r in search.with_snippets(df, query).orderBy("i").collect()]
        assert got == [search.snippet(t, ql.highlight_terms(query)) for t in texts]


def test_long_words_leave_gaps(spark):
    texts = ["a " + "z" * 39 + " b", "a " + "z" * 40 + " b", "é" * 19 + " x", "é" * 20 + " x", "ü" + "z" * 38 + " q", "漢" * 14 + " q", "!!", ""]
    df = search.indexed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), {"content": "text"})
    for r in df.orderBy("i").collect():
        want = ql.analyze(r.text)
        assert r.norm_content.split() == want and r.len_content == sum(t != "\u0001" for t in want)


def test_occurrences_of_every_kind_of_leaf(spark):
    docs = [(1, "the search index and the search", "Harbor index", ["src/Main/app.py"], 7), (2, "searching, trash old folder trash folder", "zebra", ["lib/main.c"], 9), (3, "", "", [], 5)]
    df = search.indexed(spark.createDataFrame(docs, "doc_id int, text string, title string, files array<string>, modified_ts long"), {"content": "text", "user": "title"}, {"files": "files"})

    def places(text):
        rows = search.occurrences(df, text)
        assert rows.columns == ["doc_id", "field", "term", "position", "words"]
        return sorted(tuple(r) for r in rows.collect())

    assert places("sea*") == [(1, "content", "search", 1, 1), (1, "content", "search", 5, 1), (2, "content", "searching", 0, 1)]
    assert places("<(sear|inde).>") == [(1, "content", "index", 2, 1)]
    assert places("user:[harbor TO index}") == [(1, "user", "harbor", 0, 1)]
    assert places('"search index"') == [(1, "content", "search index", 1, 2)]
    assert places('"search ind"*') == [(1, "content", "search index", 1, 2)]
    assert places('"trash folder"') == [(2, "content", "trash folder", 4, 2)]
    assert places('"trash folder"~1') == [(2, "content", "trash folder", 4, 2), (2, "content", "trash old folder", 1, 3)]
    assert places('"trash folder"~2') == [(2, "content", "folder trash", 3, 2), (2, "content", "trash folder", 4, 2), (2, "content", "trash old folder", 1, 3)]
    assert places('"trash old trash"~1') == [(2, "content", "trash old folder trash", 1, 4)]
    assert places("content: IN [old index] NOT user:zebra") == [(1, "content", "index", 2, 1)]
    assert places("files:main OR modified_ts:[9 TO 10]") == [(1, "files", "Main/app.py", 1, 1), (2, "files", "main.c", 1, 1), (2, "modified_ts", "9", 0, 1)]
    assert places("search OR sear*") == places("sear*")
    assert places("*") == places("NOT search") == places("") == places("<zz+>") == []
