from collections import Counter

from threadloom.operators import delivery as d

SCHEMA = "row_id long, ingested_at long, message struct<id:string,role:string>, messageId string, isSnapshotUpdate boolean, kind string, ident string, n long"


def rows(spark, data):
    return spark.createDataFrame([(k, t, m, s, u, "x", "y", 1) for k, t, m, s, u in data], SCHEMA)


DATA = [
    (1, 10, (" MSG_a ", "u"), None, None), (2, 11, ("msg_A", "u"), None, None), (3, 9, ("msg_a\t", "u"), None, None), (4, 1, ("msg_b", "u"), None, None),
    (5, 1, None, "S1", False), (6, 2, None, "s1", True), (7, 3, None, "s1 ", True), (8, 1, None, None, None), (9, 1, None, None, None), (10, 1, ("  ", None), "", None), (11, 1, None, "s2", None),
]


def test_repeated_and_once(spark):
    df = rows(spark, DATA)
    assert {(r.ident, r.id_kind, r.copies) for r in d.repeated(df).collect()} == {("msg_a", "message", 3), ("s1", "snapshot_update", 2)}
    kept = d.once(df)
    assert sorted(r.row_id for r in kept.collect()) == [3, 4, 5, 6, 8, 9, 10, 11]
    assert kept.columns == df.columns


def test_equal_rows_and_hot_group(spark):
    df = rows(spark, [(7, 7, ("hot", None), None, None)] * 200 + [(8, 8, ("cold", None), None, None)])
    assert Counter(r.row_id for r in d.once(df).collect()) == {7: 1, 8: 1}


def test_empty_and_deliver(spark):
    empty = rows(spark, [])
    assert d.once(empty).count() == 0 and d.repeated(empty).count() == 0
    stored = d.once(rows(spark, DATA[:4]))
    new = d.deliver(stored, rows(spark, [(20, 1, ("MSG_B", None), None, None), (21, 1, ("msg_c", None), None, None), (22, 2, ("msg_c", None), None, None), (23, 1, None, None, None)]))
    # rows without an identifier are no copies, but hold no identity to be stored once either
    assert sorted(r.row_id for r in new.collect()) == [21, 23]


def test_once_ranks_by_the_split_of_repeated(spark, monkeypatch):
    asked = []
    plain = d.repeated
    monkeypatch.setattr(d, "repeated", lambda df: asked.append(1) or plain(df))
    # 1 and 2 share a messageId beside message ids of their own; each is a message of its own, 3 is a copy of 1, and 4 of the snapshot in 1
    df = rows(spark, [(1, 1, ("a", None), "s", False), (2, 2, ("b", None), "s", False), (3, 3, ("A", None), None, None), (4, 4, None, "s", False)])
    assert {(r.ident, r.id_kind, r.copies) for r in plain(df).collect()} == {("a", "message", 2), ("s", "snapshot", 3)}
    assert sorted(r.row_id for r in d.once(df).collect()) == [1, 2] and asked
    assert {(r.ident, r.copies, r.kept.row_id) for r in d.ranked(df).collect()} == {("a", 2, 1), ("s", 3, 1)}
