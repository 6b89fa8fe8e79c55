import hashlib

from pyspark.sql import functions as F

from threadloom.functions import text as tx


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" if not isinstance(v, list) else f"{k} array<string>" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_analyzer(spark):
    t = "Foo_bar ÄB-12 " + "z" * 40 + " x"
    assert one(spark, tx.tokens(F.col("t")), t=t) == ["foo", "bar", "äb", "12", "x"]
    assert one(spark, tx.normal_form(F.col("t")), t=t) == " foo bar äb 12 \x01 x "
    assert one(spark, tx.tokens(F.col("t")), t=None) == []


def test_text_forms(spark):
    c = F.col("t")
    assert one(spark, tx.compact(c, 8), t=" a  b\ncdefgh ") == "a b cde…" and one(spark, tx.compact(c, 8), t="a b") == "a b"
    assert one(spark, tx.path_suffixes(c), t="/a/b//") == ["/a/b", "a/b", "b"]
    assert one(spark, tx.path_suffixes(c), t=r"C:\x\y") == ["C:/x/y", "x/y", "y"]
    assert one(spark, tx.normal_path(c), t="/A//b/./c/../") == "/a/b/c/.."
    assert one(spark, tx.strip_wrappers(c), t="<command-name>/x</command-name>\n<command-args>a b</command-args>") == "/x a b"
    assert one(spark, tx.strip_wrappers(c), t="see <command-name>/x</command-name>") == "see <command-name>/x</command-name>"
    assert tuple(one(spark, tx.reasoning_header(c), t="**Plan**\n\nbody")) == ("Plan", "body") and tuple(one(spark, tx.reasoning_header(c), t="body")) == (None, "body")
    assert tuple(one(spark, tx.exec_output(c), t="Exit code: 2\nWall time: 0.5 seconds\nOutput:\nhi\nyou")) == (2, 0.5, "hi\nyou")
    assert tuple(one(spark, tx.exec_output(c), t="Process exited with code -1")) == (-1, None, "Process exited with code -1")
    shell = "<user_shell_command>\n<command>ls</command>\n<result>\nExit code: 0\nDuration: 0.0126 seconds\nOutput:\nf\n</result>\n</user_shell_command>"
    assert tuple(one(spark, tx.shell_command(c), t=shell)) == ("ls", 0, 13, "f") and one(spark, tx.shell_command(c), t="ls") is None
    assert one(spark, tx.tool_label(c), t=" Shell_Command ") == "bash" and one(spark, tx.tool_label(c), t=" Odd ") == "Odd"
    assert one(spark, tx.session_id_from_path(c), t="/a/b/x-1.jsonl.zst") == "x-1" and one(spark, tx.session_id_from_path(c), t="/a/ .jsonl") == "unknown-session"
    assert one(spark, tx.decode_project_dir(c), t="-home-dev-x") == "/home/dev/x" and one(spark, tx.decode_project_dir(c), t="C--work-x") == "C:/work/x"
    assert one(spark, tx.model_from_settings(c), t="Model changed to big one. Next") == "big one"
    for p, want in (("/a/subagents/b", "sub_agent"), ("/a/x.TRIMMED.jsonl", "trimmed"), ("/continued-1", "continued"), ("/rollover", "rollover"), ("/a", "original")):
        assert one(spark, tx.derivation(F.col("t"), F.lit(None).cast("boolean")), t=p) == want


def test_fingerprints_and_ranges(spark):
    a, b = one(spark, tx.line_fingerprint(F.col("t")), t="b\n\na\r\n"), one(spark, tx.line_fingerprint(F.col("t")), t="a\nb")
    assert a == b == hashlib.sha256(b"\1" + bytes(7) + b"a\1" + bytes(7) + b"b").hexdigest() != one(spark, tx.line_fingerprint(F.col("t")), t="ab")
    df = spark.createDataFrame([([(5, 7), (1, 3), (3, 4), (6, 9)],)], "r array<struct<start:int,end:int>>")
    r = df.select(tx.merged_ranges(F.col("r")).alias("m")).first()["m"]
    assert [tuple(x) for x in r] == [(1, 4), (5, 9)]
    assert len(one(spark, tx.signature(F.col("t")), t="x")) == 16
