import json
import sqlite3

import zstandard

from pyspark.sql import functions as F

from threadloom.sources import files
from threadloom.streaming import ingest


def test_lines(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/x.jsonl").write_text('{"i":1}\n\n{cut\n' + "".join(f'{{"n":{i}}}\n' for i in range(500)))
    (tmp_path / "a/b/y z.jsonl.zst").write_bytes(zstandard.compress(b'{"i":2}\n{"i":3}\n'))
    (tmp_path / "a/no.txt").write_text("no")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # more than one split
    try:
        got = files.read_lines(spark, [str(tmp_path / "a"), str(tmp_path / "missing")]).cache()
        x = {r.line_no: r.line for r in got.where(F.col("path").endswith("x.jsonl")).collect()}
        assert len(x) == 503 and x[1] == '{"i":1}' and x[2] == "" and x[4] == '{"n":0}' and x[503] == '{"n":499}'
        assert {r.line_no: r.line for r in got.where(F.col("path").endswith("y z.jsonl.zst")).collect()} == {1: '{"i":2}', 2: '{"i":3}'}
        assert files.read_records(got).where("record IS NULL").count() == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert files.read_lines(spark, [str(tmp_path / "missing")]).count() == 0
    scan = files.scan_files(spark, {"one": [str(tmp_path / "a")], "two": [str(tmp_path / "none")]}).collect()
    assert [r.path.rsplit("/", 1)[1] for r in scan] == ["y z.jsonl.zst", "x.jsonl"] and not any(r.trashed for r in scan)


def test_damaged_files_are_told(spark, tmp_path):
    import pytest

    (tmp_path / "a").mkdir()
    whole = zstandard.compress(b"".join(b'{"i":%d}\n' % (i * 7919) for i in range(90_000)))
    (tmp_path / "a/good.jsonl.zst").write_bytes(zstandard.compress(b'{"i":2}\n'))
    (tmp_path / "a/cut.jsonl.zst").write_bytes(whole[: len(whole) // 2])
    assert [(r.path.rsplit("/", 1)[1], r.error) for r in files.damaged_files(spark, [str(tmp_path / "a"), str(tmp_path / "no")]).collect()] == [("cut.jsonl.zst", "the file ends early")]
    with pytest.raises(Exception):
        files.read_lines(spark, [str(tmp_path / "a")]).count()
    assert files.read_lines(spark, [str(tmp_path / "a")], skip_damaged=True).where("path LIKE '%good%'").count() == 1


def test_trash_and_archive(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/s1.jsonl").write_text("{}\n")
    (tmp_path / "t/x.json").write_text(json.dumps({"agent": "a", "members": [{"stored_path": "s1.jsonl", "original_path": "/home/s1.jsonl"}]}))
    assert [(r.agent, r.size, r.trashed, r.original_path) for r in files.scan_trash(spark, str(tmp_path / "t")).collect()] == [("a", 3, True, "/home/s1.jsonl")]
    assert files.scan_trash(spark, str(tmp_path / "no")).count() == 0
    assert [r.eligible for r in files.scan_archived(spark, str(tmp_path / "t")).collect()] == [False]


def test_bundles_metadata_and_history(spark, tmp_path):
    for name, two in (("id1", True), ("id2", False)):
        d = tmp_path / f"brain/{name}/.system_generated/logs"
        d.mkdir(parents=True)
        (d / "transcript.jsonl").write_text("{}\n")
        if two:
            (d / "transcript_full.jsonl").write_text("{}\n{}\n")
    got = {r.id: r for r in files.scan_bundles(spark, str(tmp_path)).collect()}
    assert set(got) == {"id1", "id2"} and got["id1"].size == 9 and got["id2"].full is None
    meta = tmp_path / "m.json"
    meta.write_text(json.dumps({"conversations": {"id1": {"summary": {"WorkspaceURIs": ["file:///w/a", "file:///w/b"], "Title": "T"}}, "id2": {"summary": {}}}}))
    known = files.conversation_metadata(spark, str(meta))
    history = spark.createDataFrame([("id2", "/old", 1), ("id2", "/new", 2), ("id1", "/other", 3)], "conversationId string, workspace string, line_no int")
    assert {r.id: r.cwd for r in files.with_history_fallback(known, history).collect()} == {"id1": "/w/a", "id2": "/new"}


def test_database_summaries_and_sidecars(spark, tmp_path):
    db = tmp_path / "t.db"
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE threads (id TEXT, rollout_path TEXT, history_mode TEXT)")
        c.executemany("INSERT INTO threads VALUES (?, ?, ?)", [("t1", "/a", "paginated"), ("t2", "/b", None)])
    assert {(r.thread_id, r.paginated, r.branch) for r in files.thread_selections(spark, str(db)).collect()} == {("t1", True, None), ("t2", False, None)}
    assert files.thread_selections(spark, str(db), "t2").count() == 1 and files.thread_selections(spark, str(tmp_path / "no.db")).count() == 0
    d = tmp_path / "s"
    d.mkdir()
    (d / "1.md").write_text("thread_id: t1\r\nrollout_path: /a\r\nupdated_at: 2026\r\n\r\nBody\r\nmore\r\n")
    (d / "2.md").write_text("thread_id: t1\n\nBody")
    (d / "3.md").write_text("---\nfingerprint: f\nlines: 3\n---\nText")
    assert [tuple(r) for r in files.rollout_summaries(spark, str(d)).collect()] == [("t1", "/a", "2026", "Body\nmore")]
    assert [tuple(r)[1:] for r in files.summary_sidecars(spark, str(d)).collect()] == [("f", 3, "Text")]
    h = tmp_path / "h.json"
    h.write_text(json.dumps([{"query": " a ", "saved_at": "2026-01-01T00:00:00Z"}, {"query": "", "saved_at": "2026-01-01T00:00:00Z"}, {"query": "b", "saved_at": "?"}]))
    assert [r.query for r in files.search_history(spark, str(h)).collect()] == ["a"]
    h.write_text("broken")
    assert files.search_history(spark, str(h)).count() == 0
    t = tmp_path / "trash"
    t.mkdir()
    (t / "x.json").write_text(json.dumps({"schema_version": 1, "agent": "a", "session_path": "/p", "members": [{"stored_path": "s"}]}))
    (t / "y.json").write_text(json.dumps({"schema_version": 1}))
    assert [r.session_path for r in files.trash_items(spark, str(t)).collect()] == ["/p"]


def test_stream_stores_each_message_once(spark, tmp_path):
    schema = "row_id long, ingested_at long, message struct<id:string>, messageId string, isSnapshotUpdate boolean"
    source, target, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    put([(1, 1, ("a",), None, None), (2, 2, ("A ",), None, None), (3, 3, ("b",), None, None)])
    for more in ([], [(4, 4, ("B",), None, None), (5, 5, ("c",), None, None)]):
        if more:
            put(more)
        ingest.store_once(ingest.stream_rows(spark, source, schema), target, log).awaitTermination()
    assert sorted(r.row_id for r in spark.read.parquet(target).collect()) == [1, 3, 5]
    ids = spark.read.parquet(target + "-ids")
    assert {r.ident for r in ids.collect()} == {"a", "b", "c"} and "bucket" in ids.columns
    rows = spark.createDataFrame([("S", 0), ("s", 600), ("s", 9000), (None, 1)], "sessionId string, t long").select("sessionId", F.timestamp_seconds("t").alias("timestamp"))
    assert sorted(r.rows for r in ingest.activity(rows).collect()) == [1, 2]
