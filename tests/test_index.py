import pytest

from threadloom.operators import index, search

ROWS = [
    (1, "Parser trash folder, parser!", "a", 10, "x"), (2, "folder of trash", "b", 20, "y"), (3, None, "c", 30, "x"), (4, "", "d", 40, "x"), (5, "ledger " * 300 + "x" * 50 + " end", "e", 50, "y"), (6, "Trash, folder and Ledger", "parser", 60, "x"),
]
SCHEMA = "doc_id long, text string, title string, modified_ts long, agent string"


def keys(df):
    return sorted(r.doc_id for r in df.collect())


def test_answers_equal_those_over_the_texts(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    stored = index.Index(spark, str(tmp_path / "i"), "doc_id", {"content": "text", "user": "title"})
    assert stored.manifest()["version"] == 0 and keys(stored.matching("parser")) == []
    stored.rebuild(docs)
    over = search.indexed(docs, {"content": "text", "user": "title"})
    for q in ("parser", '"trash folder"', '"folder trash"~3', "par*", "NOT ledger", "*", "user:parser", '"parser tra"*', "content: IN [ledger of]", "user:[b TO d]", "trash folder", "+trash -ledger", "ledger^2 OR parser", "nothing", "x*", '"ledger end"'):
        assert keys(stored.matching(q)) == keys(search.matching(over, q)), q
        want = {r.doc_id: round(r.score, 6) for r in search.scored(over, q).collect()}
        assert {r.doc_id: round(r.score, 6) for r in stored.matching(q).collect()} == want, q
    hits = stored.search(search.Request("trash", search.Filters(agent="x"), sort="relevance", now=60)).collect()
    assert [r.doc_id for r in hits] == [6, 1]


def test_updates_deletes_and_two_writers(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    stored = index.Index(spark, str(tmp_path / "i"))
    stored.update(docs.where("doc_id < 4"))
    before = stored.manifest()
    fresh = spark.createDataFrame([(1, "now cache", "a", 70, "x"), (7, "parser", "z", 1, "x")], SCHEMA)
    stored.update(fresh, spark.createDataFrame([(2,)], "doc_id long"))
    m = stored.manifest()
    assert (m["version"], m["n"], m["total"]) == (2, 3, {"content": 3}) and (before["n"], before["total"]) == (3, {"content": 7})
    assert keys(stored.matching("parser")) == [7] and keys(stored.matching("trash")) == [] and keys(stored.matching("*")) == [1, 3, 7]
    assert [r.doc_id for r in stored.search(search.Request("")).collect()] == [1, 3, 7]
    with pytest.raises(index.Busy):
        stored._commit({**m, "version": 2})
    assert stored.manifest() == m
    (tmp_path / "i" / f"manifest-{index.FORMAT}-0000000009").write_text("{")  # a writer that has not finished
    assert stored.manifest() == m
    stored.delete()
    assert stored.manifest()["version"] == 0


def test_only_the_buckets_of_the_words_are_read(spark, tmp_path):
    stored = index.Index(spark, str(tmp_path / "i"))
    stored.update(spark.createDataFrame(ROWS, SCHEMA))
    plan = stored.matching("parser")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
