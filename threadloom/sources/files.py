"""Readers of session trees: JSON lines (plain or zstd), bundles, metadata, summaries, histories and the thread database."""

from __future__ import annotations

import os
import sqlite3

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINES = "path string, line_no bigint, line string"


def _have(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The patterns that match something on the file system they name, or on the default one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in patterns:
        found = path(p).getFileSystem(conf).globStatus(path(p))
        if found is not None and len(found):
            out.append(p)
    return out


def read_lines(spark: SparkSession, directories: list[str], suffix: str = "*.{jsonl,jsonl.zst}", skip_damaged: bool = False) -> DataFrame:
    """(path, line_no, line) of all files below the directories; missing directories are empty.

    Large plain files are read in splits: a line's number is its place in its split plus the lines of the splits before, one small
    row for each split.  A file that cannot be read to its end is an error; ``skip_damaged`` takes what can be read of it, and
    ``damaged_files`` lists such files.
    """
    have = _have(spark, directories)
    if not have:
        return spark.createDataFrame([], LINES)
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).option("ignoreCorruptFiles", str(skip_damaged).lower()).text(have)
    lines = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    splits = lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(splits.select("path", "block", "first", before.alias("before")), ["path", "block"]).select(F.url_decode(F.regexp_replace("path", "^file:(//)?", "")).alias("path"), (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def damaged_files(spark: SparkSession, directories: list[str]) -> DataFrame:
    """(path, error) of compressed files below the directories that do not read to their end."""
    have = _have(spark, directories)
    if not have:
        return spark.createDataFrame([], "path string, error string")

    def test(contents: pd.Series) -> pd.Series:
        import zstandard

        def fault(content: bytes) -> str | None:
            try:
                reader = zstandard.ZstdDecompressor().decompressobj()
                reader.decompress(content)
                return None if reader.eof else "the file ends early"
            except zstandard.ZstdError as error:
                return str(error)

        return contents.map(fault)

    test.__annotations__ = {"contents": pd.Series, "return": pd.Series}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zst").load(have)
    found = files.select(F.url_decode(F.regexp_replace("path", "^file:(//)?", "")).alias("path"), F.pandas_udf(test, "string")("content").alias("error"))
    return found.where("error IS NOT NULL")


def read_records(lines: DataFrame) -> DataFrame:
    """Adds ``record`` (variant); lines that are no JSON have null."""
    return lines.withColumn("record", F.try_parse_json("line"))


def scan_files(spark: SparkSession, roots: dict[str, list[str]], trash: str | None = None) -> DataFrame:
    """(path, agent, mtime, size, trashed) of the session files below each producer's roots, in path order."""
    out = None
    for agent, directories in {**roots, **({"trash": [trash]} if trash else {})}.items():
        have = _have(spark, directories)
        if not have:
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jsonl,jsonl.zst}").load(have)
        part = files.select(
            F.url_decode(F.regexp_replace("path", "^file:(//)?", "")).alias("path"), F.lit(None if agent == "trash" else agent).cast("string").alias("agent"),
            F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"), F.lit(agent == "trash").alias("trashed"),
        )
        out = part if out is None else out.unionByName(part)
    empty = "path string, agent string, mtime bigint, size bigint, trashed boolean"
    return spark.createDataFrame([], empty) if out is None else out.orderBy("path")


def scan_bundles(spark: SparkSession, directory: str) -> DataFrame:
    """(id, transcript, full, mtime, size): one row for each bundle that has a transcript; time is the latest, size the sum."""
    # The directory's name begins with a dot, which listings pass over unless it is named.
    have = _have(spark, [f"{directory}/brain/*/.system_generated/logs"])
    if not have:
        return spark.createDataFrame([], "id string, transcript string, full string, mtime bigint, size bigint")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "transcript*.jsonl").load(have)
    f = files.select("path", F.unix_timestamp("modificationTime").alias("mtime"), "length", F.regexp_extract("path", r"/brain/([^/]+)/\.system_generated/logs/transcript(?:_full)?\.jsonl$", 1).alias("id")).where("id <> ''")
    full = F.col("path").endswith("_full.jsonl")
    out = f.groupBy("id").agg(F.max(F.when(~full, F.col("path"))).alias("transcript"), F.max(F.when(full, F.col("path"))).alias("full"), F.max("mtime").alias("mtime"), F.sum("length").alias("size"))
    return out.where("transcript IS NOT NULL")


def conversation_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(id, cwd, title, preview) of a JSON map of conversations; the first workspace is the working directory."""
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    text.createOrReplaceTempView("__tl_conversations")
    rows = spark.sql("SELECT e.key AS id, e.value AS c FROM __tl_conversations, LATERAL variant_explode(variant_get(v, '$.conversations', 'variant')) AS e")
    get = lambda p: F.try_variant_get("c", p, "string")
    return rows.select("id", F.regexp_replace(get("$.summary.WorkspaceURIs[0]"), "^file://", "").alias("cwd"), get("$.summary.Title").alias("title"), get("$.summary.Preview").alias("preview"))


def with_history_fallback(sessions: DataFrame, history: DataFrame) -> DataFrame:
    """Fills a null cwd with the last workspace of the history.  history: conversationId, workspace, line_no."""
    last = history.where("conversationId IS NOT NULL AND workspace IS NOT NULL").groupBy(F.col("conversationId").alias("id")).agg(F.max_by("workspace", "line_no").alias("workspace"))
    return sessions.join(last, "id", "left").withColumn("cwd", F.coalesce("cwd", "workspace")).drop("workspace")


def trash_items(spark: SparkSession, directory: str) -> DataFrame:
    """Sidecars of the trash store with an explicit schema; items without a producer are left out."""
    schema = "schema_version int, agent string, trashed_at timestamp, session_path string, members array<struct<stored_path:string,original_path:string>>, reason struct<kind:string,text:string>"
    have = _have(spark, [directory])
    if not have:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("multiLine", "true").json(have).where("agent IS NOT NULL")


def scan_trash(spark: SparkSession, directory: str) -> DataFrame:
    """(path, agent, mtime, size, trashed, original_path) of the files that the sidecars of the trash store name."""
    empty = "path string, agent string, mtime bigint, size bigint, trashed boolean, original_path string"
    if not _have(spark, [directory]):
        return spark.createDataFrame([], empty)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jsonl,jsonl.zst}").load(directory)
    payload = files.select(F.url_decode(F.regexp_replace("path", "^file:(//)?", "")).alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size")).withColumn("stored_path", F.substring_index("path", "/", -1))
    members = trash_items(spark, directory).select("agent", F.explode("members").alias("m")).select("agent", F.substring_index("m.stored_path", "/", -1).alias("stored_path"), "m.original_path")
    return payload.join(members, "stored_path").select("path", "agent", "mtime", "size", F.lit(True).alias("trashed"), "original_path")


def scan_archived(spark: SparkSession, directory: str, agent: str = "rollout") -> DataFrame:
    """Files of the archive: read as history of others, not eligible as sessions of their own."""
    return scan_files(spark, {agent: [directory]}).withColumn("eligible", F.lit(False))


def thread_selections(spark: SparkSession, database: str, thread: str | None = None, timeout_ms: int = 250) -> DataFrame:
    """(thread_id, selected_path, paginated, branch) of the provider's thread table, read on the driver: a small lookup table of one
    machine.  Columns the table lacks come out null; a missing database is empty."""
    schema = "thread_id string, selected_path string, paginated boolean, branch string"
    if not os.path.exists(database):
        return spark.createDataFrame([], schema)
    with sqlite3.connect(f"file:{database}?mode=ro", uri=True, timeout=timeout_ms / 1000) as db:
        have = {r[1] for r in db.execute("PRAGMA table_info(threads)")}
        if not {"id", "rollout_path"} <= have:
            return spark.createDataFrame([], schema)
        pick = ", ".join(c if c in have else f"NULL AS {c}" for c in ("id", "rollout_path", "history_mode", "git_branch"))
        rows = db.execute(f"SELECT {pick} FROM threads" + (" WHERE id = ?" if thread else ""), (thread,) if thread else ()).fetchall()
    return spark.createDataFrame([(r[0], r[1], r[2] == "paginated", r[3]) for r in rows], schema)


def rollout_summaries(spark: SparkSession, directory: str) -> DataFrame:
    """(thread_id, rollout_path, updated_at, body) of Markdown files with a key-value head, a blank line and a body; incomplete ones dropped."""
    have = _have(spark, [directory])
    schema = "thread_id string, rollout_path string, updated_at string, body string"
    if not have:
        return spark.createDataFrame([], schema)
    text = spark.read.option("pathGlobFilter", "*.md").text(have, wholetext=True).select(F.regexp_replace("value", "\r\n", "\n").alias("t"))
    head = F.regexp_extract("t", r"(?s)^(.*?)\n[ \t]*\n", 1)
    key = lambda k: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*)$", 1)), F.lit(""))
    body = F.nullif(F.regexp_replace(F.regexp_replace("t", r"(?s)^.*?\n[ \t]*\n", ""), r"^\s+|\s+$", ""), F.lit(""))
    return text.where(head != "").select(key("thread_id").alias("thread_id"), key("rollout_path").alias("rollout_path"), key("updated_at").alias("updated_at"), body.alias("body")).where("thread_id IS NOT NULL AND rollout_path IS NOT NULL AND body IS NOT NULL").orderBy("updated_at", "thread_id")


def summary_sidecars(spark: SparkSession, directory: str) -> DataFrame:
    """(path, fingerprint, lines, body) of sidecars with front matter between '---' lines."""
    text = spark.read.option("pathGlobFilter", "*.md").text(directory, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n", "\n").alias("t"))
    front = F.regexp_extract("t", r"(?s)^---\n(.*?)\n---\n", 1)
    key = lambda k: F.nullif(F.trim(F.regexp_extract(front, rf"(?m)^{k}:[ \t]*(.*)$", 1)), F.lit(""))
    return text.where(front != "").select("path", key("fingerprint").alias("fingerprint"), key("lines").try_cast("bigint").alias("lines"), F.regexp_replace("t", r"(?s)^---\n.*?\n---\n", "").alias("body"))


def search_history(spark: SparkSession, path: str) -> DataFrame:
    """(query, saved_at) of a JSON list; invalid entries are skipped, a broken file is empty."""
    have = _have(spark, [path])
    schema = "query string, saved_at timestamp"
    if not have:
        return spark.createDataFrame([], schema)
    rows = spark.read.text(have, wholetext=True).select(F.explode(F.from_json("value", "array<struct<query:string,saved_at:string>>")).alias("e"))
    return rows.select(F.trim("e.query").alias("query"), F.col("e.saved_at").try_cast("timestamp").alias("saved_at")).where("query <> '' AND saved_at IS NOT NULL")
