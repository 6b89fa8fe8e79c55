"""Queries of functions and small operators, over forms built from the driver's tables, and the SQL that says by itself what they must give."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.operators import history, lineage, projection, search, sessions
from threadloom.util import ensure_checkpoint_dir, table


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def wrappers_stripped(spark: SparkSession, sf: str) -> DataFrame:
    """P5: a text of tags only, and one of tags within prose."""
    wrapped = F.concat(F.lit("<command-name>/"), "source", F.lit("</command-name>\n  <command-args>"), "title", F.lit("</command-args>\n"))
    mixed = F.concat(F.lit("say <bash-input>"), "source", F.lit("</bash-input>"))
    return _documents(spark, sf).select("doc_id", tx.strip_wrappers(wrapped).alias("stripped"), tx.strip_wrappers(mixed).alias("kept"))


def exec_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """The text form of a finished command."""
    form = F.concat(F.lit("Exit code: "), F.col("doc_id") % 200, F.lit("\nWall time: "), F.col("doc_id") % 100, F.lit(".5 seconds\nOutput:\n"), "text")
    older = F.concat(F.lit("Process exited with code -"), F.col("doc_id") % 7, F.lit("\nno output"))
    return _documents(spark, sf).select("doc_id", F.inline(F.array(tx.exec_output(form), tx.exec_output(older))))


def reasoning_headers(spark: SparkSession, sf: str) -> DataFrame:
    """A header in bold before a blank line, and text without one."""
    d = _documents(spark, sf)
    return d.select("doc_id", F.inline(F.array(tx.reasoning_header(F.concat(F.lit("**Step "), "doc_id", F.lit("**\n\n"), "text")), tx.reasoning_header(F.concat(F.lit("**Step** "), "source")))))


def shell_commands(spark: SparkSession, sf: str) -> DataFrame:
    """The envelope of a user's shell command, and other text."""
    form = F.concat(
        F.lit("<user_shell_command>\n<command>\nls "), "source", F.lit("\n</command>\n<result>\nExit code: "), F.col("doc_id") % 3, F.lit("\nDuration: "), F.col("doc_id") % 50, F.lit(".2504 seconds\nOutput:\n"), "session_id", F.lit("\n</result>\n</user_shell_command>")
    )
    return _documents(spark, sf).where("session_id IS NOT NULL").select("doc_id", F.explode(F.array(tx.shell_command(form), tx.shell_command(F.col("source")))).alias("c")).select("doc_id", "c.*")


def settings_models(spark: SparkSession, sf: str) -> DataFrame:
    """The model named in a settings text."""
    return _documents(spark, sf).select("doc_id", tx.model_from_settings(F.concat(F.lit("The user changed model from A to "), "source", F.lit(" (High). No need to comment."))).alias("model"))


def path_ids(spark: SparkSession, sf: str) -> DataFrame:
    """SC14: session ids from file names."""
    d = _documents(spark, sf)
    path = lambda s: tx.session_id_from_path(F.concat(F.lit("/r/p-x/"), "session_id", F.lit(s)))
    return d.select("doc_id", path(".jsonl").alias("plain"), path(".jsonl.zst").alias("packed"), tx.session_id_from_path(F.lit("/r/ .jsonl")).alias("blank"))


def project_dirs(spark: SparkSession, sf: str) -> DataFrame:
    """Names of project directories back to paths."""
    cwd = table(spark, sf, "basic_session").where("cwd IS NOT NULL").select("cwd").distinct()
    return cwd.select("cwd", tx.decode_project_dir(F.translate("cwd", "/", "-")).alias("decoded"), tx.decode_project_dir(F.concat(F.lit("C-"), F.translate("cwd", "/", "-"))).alias("on_drive"))


def source_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """H7."""
    return _documents(spark, sf).where("source IS NOT NULL").select("doc_id", tx.signature(F.col("doc_id"), F.col("source")).alias("signature"))


def merged_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping and touching ranges of a session joined."""
    d = _documents(spark, sf).where("session_id IS NOT NULL AND n_chars IS NOT NULL")
    start = (F.col("doc_id") * 37 % 400).cast("int")
    distinct = d.select("session_id", start.alias("start"), (start + F.col("n_chars") % 23).cast("int").alias("end")).distinct()  # at most 400 x 23 a session
    ranges = distinct.groupBy("session_id").agg(F.collect_list(F.struct("start", "end")).alias("r"))
    return ranges.select("session_id", F.inline(tx.merged_ranges(F.col("r"))))


def citation_footers(spark: SparkSession, sf: str) -> DataFrame:
    """A complete citation block at the end of a text, and one inside an open fence."""
    block = F.lit("\n<oai-mem-citation>x</oai-mem-citation>\n")
    forms = F.array(projection.citation_footer(F.concat("source", block)), projection.citation_footer(F.concat(F.lit("```\n"), "source", block)))
    return _documents(spark, sf).select("doc_id", F.posexplode(forms).alias("form", "f")).select("doc_id", "form", "f.body", "f.footer")


def previews(spark: SparkSession, sf: str) -> DataFrame:
    """The text by which a session is listed."""
    return _documents(spark, sf).select("doc_id", projection.preview(F.when(F.col("lang") == "en", F.col("title")), F.lit(" \n"), F.col("source")).alias("preview"))


def field_masks(spark: SparkSession, sf: str) -> DataFrame:
    """The masks searched in each mode, with the default display and with all shown."""
    rows = [(name, mode, m) for name, d in (("default", projection.Display()), ("all shown", projection.SHOW_ALL)) for mode in ("all", "visible", "hidden") for m in projection.default_masks(mode, d)]
    return spark.createDataFrame(rows, "display string, mode string, mask int")


def patches(spark: SparkSession, sf: str) -> DataFrame:
    """The file sections of a patch, with the body of added files."""
    form = F.concat(F.lit("*** Begin Patch\n*** Add File: "), "source", F.lit("/new.py\n+"), "title", F.lit("\n+\n+end\n*** Update File: a b.txt\n@@\n-old\n-older\n+new\n*** Delete File: gone\n*** End Patch"))
    d = _documents(spark, sf).where("title IS NOT NULL AND source IS NOT NULL").select("doc_id", form.alias("patch"))
    return sessions.patch_files(d, "doc_id", "patch")


def plans(spark: SparkSession, sf: str) -> DataFrame:
    """The items of a plan; none where an entry is malformed."""
    good = F.to_json(F.struct(F.array(F.struct(F.col("source").alias("step"), F.lit("pending").alias("status")), F.struct(F.lit("b").alias("step"), F.lit("completed").alias("status"))).alias("plan")))
    bad = F.lit('{"plan":[{"step":"a","status":"maybe"}]}')
    d = _documents(spark, sf).where("source IS NOT NULL")
    return d.select("doc_id", F.posexplode(F.concat(sessions.plan_items(good), F.coalesce(sessions.plan_items(bad), F.array().cast("array<struct<step:string,status:string>>")))).alias("place", "i")).select("doc_id", "place", "i.step", "i.status")


def settings(spark: SparkSession, sf: str) -> DataFrame:
    """Dates, limits, saved and explicit filters, directories, active filters."""
    from threadloom.operators import sync

    saved = search.Filters(agent="faq", min_lines=3)
    values = {
        "day": search.parse_date("2026-02-03", False), "end of day": search.parse_date("2026-02-03", True), "moment": search.parse_date("2026-02-03T04:05:06+02:00", False), "json": search.LIMITS["json"], "markdown": search.LIMITS["markdown"], "zip": search.LIMITS["zip"],
        "merged agent": saved.merged({"agent": "wiki", "min_lines": None}).agent, "merged lines": saved.merged({"agent": "wiki", "min_lines": None}).min_lines, "active": saved.active(), "dir": search.parse_dir("/a/b:main")[0],
        "branch": search.parse_dir("/a/b:main")[1], "plain dir": search.parse_dir("/a/b")[0], "profile": sync.profile_id(["/a", "/b"]),
    }
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in values.items()], "name string, value string")


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Number of lines that are not blank, and the hash of the last."""
    from threadloom.operators import sync

    lines = table(spark, sf, "rollout_raw").groupBy("file_id", "line_no").agg(F.min_by("line", "row_id").alias("line"))
    return sync.fingerprints(lines, "file_id")


def checksums(spark: SparkSession, sf: str) -> DataFrame:
    """A14, signature left out: CRC-32 of path and content; its SQL checks that equal inputs and only they agree."""
    from threadloom.operators import sync

    d = _documents(spark, sf).where("source IS NOT NULL").select(F.col("source").alias("path"), F.encode("text", "utf-8").alias("content"), F.lit(None).cast("string").alias("signature"))
    c = sync.content_checksums(d)
    return c.groupBy("path").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("crc").alias("contents"))


def upserts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents after the last delivery replaced those of its sessions, and sessions of the first delivery were deleted."""
    from threadloom.operators import sync

    rows = table(spark, sf, "basic_session").where("sessionId IS NOT NULL")
    last = rows.agg(F.max("batch_id")).first()[0]
    before = rows.where(F.col("batch_id") < F.lit(last)).groupBy(F.lower("sessionId").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    fresh = rows.join(rows.where(F.col("batch_id") == F.lit(last)).select(F.lower("sessionId").alias("p")).distinct(), F.lower("sessionId") == F.col("p"), "left_semi").groupBy(F.lower("sessionId").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    gone = rows.groupBy(F.lower("sessionId").alias("path")).agg(F.max("batch_id").alias("b")).where("b = 1").select("path")
    return sync.upserted(before, fresh, gone)


def valid_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Fork relations whose sessions did not change with the last delivery."""
    from threadloom.operators import sync

    rows = table(spark, sf, "basic_session").where("sessionId IS NOT NULL")
    last = rows.agg(F.max("batch_id")).first()[0]
    state = lambda r: r.groupBy(F.lower("sessionId").alias("path")).agg(F.count(F.lit(1)).alias("fingerprint"))
    forks = rows.where("forkedFrom.sessionId IS NOT NULL").select(F.lower("sessionId").alias("child"), F.lower("forkedFrom.sessionId").alias("parent")).distinct()
    return sync.still_valid(forks, state(rows.where(F.col("batch_id") < F.lit(last))), state(rows))


def forked_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """X1-X3, X6, X7, A6, A7, JN5, JN6, O8: each session forked twice over, the second fork from the first; all events inherited."""
    rows = table(spark, sf, "rich_content").where("sessionId IS NOT NULL AND uuid IS NOT NULL")
    own = rows.groupBy(F.lower("sessionId").alias("s")).agg(F.array_sort(F.collect_set(F.lower("uuid"))).alias("events"))
    none, text = F.array().cast("array<string>"), lambda end: F.concat("s", F.lit(end))

    def copy(end: str, parents, events, inherited, count: int) -> DataFrame:
        return own.select(
            text(end).alias("key"), F.lit("transcript").alias("agent"), text(end).alias("session_id"), parents.alias("fork_parents"), F.lit(False).alias("trashed"), F.lit(True).alias("safe"), F.lit(1).cast("bigint").alias("modified"),
            events.alias("events"), inherited.alias("inherited"), F.lit(count).cast("bigint").alias("own"), none.alias("activity"), F.lit(None).cast("struct<events:array<string>,active:boolean,lines:string>").alias("aborted"), F.array().cast("array<struct<lines:string,last:string>>").alias("turns"),
        )

    every = copy("", none, F.col("events"), none, 1).unionByName(copy("-f", F.array("s"), F.array(text("-e")), F.col("events"), 1)).unionByName(copy("-g", F.array(text("-f")), F.array(text("-h")), F.array(text("-e")), 1))
    return lineage.superseded(every)


def equivalent_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Each session with a later copy of all its events; the copy is kept."""
    rows = table(spark, sf, "rich_content").where("sessionId IS NOT NULL AND uuid IS NOT NULL")
    own = rows.groupBy(F.lower("sessionId").alias("s")).agg(F.array_sort(F.collect_set(F.lower("uuid"))).alias("events"))
    none = F.array().cast("array<string>")
    make = lambda key, parents, events, inherited, modified: own.select(
        key.alias("key"), F.lit("transcript").alias("agent"), key.alias("session_id"), parents.alias("fork_parents"), F.lit(False).alias("trashed"), F.lit(True).alias("safe"), F.lit(modified).cast("bigint").alias("modified"), events.alias("events"), inherited.alias("inherited"),
        F.lit(0).cast("bigint").alias("own"), none.alias("activity"), F.lit(None).cast("struct<events:array<string>,active:boolean,lines:string>").alias("aborted"), F.array().cast("array<struct<lines:string,last:string>>").alias("turns"),
    )
    return lineage.superseded(make(F.col("s"), none, F.col("events"), none, 1).unionByName(make(F.concat("s", F.lit("-copy")), F.array("s"), none, F.col("events"), 2)))


def ambiguous_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Branches that more than one directory claims."""
    rows = table(spark, sf, "basic_session").where("gitBranch IS NOT NULL AND cwd IS NOT NULL")
    return lineage.ambiguous_ids(rows.select(F.col("gitBranch").alias("rollout_id"), F.col("cwd").alias("path")))


def branch_values(spark: SparkSession, sf: str) -> DataFrame:
    """H6: which branch a thread shows, by whether it is paginated."""
    rows = table(spark, sf, "basic_session").select("row_id", F.coalesce("isSidechain", F.lit(False)).alias("paginated"), F.col("gitBranch").alias("db"), F.col("version").alias("header"))
    return rows.select("row_id", history.branch(F.col("paginated"), F.lit(True), F.col("db"), F.col("header")).alias("branch"))


def scanned_tree(spark: SparkSession, sf: str) -> DataFrame:
    """SC1, SC2, SC8, O5: lines written as compressed files, a directory for each producer, and read back as a tree; damaged lines are no records."""
    from threadloom.sources import files

    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/tree-{uuid.uuid4().hex[:8]}"
    table(spark, sf, "rollout_raw").where("producer IS NOT NULL AND line IS NOT NULL").select("producer", "line").write.partitionBy("producer").option("compression", "gzip").text(at)
    lines = files.read_records(files.read_lines(spark, [at, f"{at}/missing"], "*.txt.gz")).withColumn("producer", F.regexp_extract("path", "producer=([^/]+)/", 1))
    last = lines.groupBy("producer", "path").agg(F.max("line_no").alias("last"), F.count(F.lit(1)).alias("n"), F.count("record").alias("r"), F.sum(F.octet_length("line")).alias("b"))
    return last.groupBy("producer").agg(F.sum("n").alias("lines"), F.sum("last").alias("numbered"), F.sum("r").alias("records"), F.sum("b").alias("bytes"))


def history_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """SC4, SC5, JN4: sessions of even batches keep their directory, the others take the last one of the history."""
    from threadloom.sources import files

    rows = table(spark, sf, "basic_session").where("sessionId IS NOT NULL").withColumn("id", F.lower("sessionId"))
    s = rows.groupBy("id").agg(F.when(F.max("batch_id") % 2 == 0, F.min("cwd")).alias("cwd"))
    return files.with_history_fallback(s, rows.select(F.col("id").alias("conversationId"), F.col("cwd").alias("workspace"), F.col("row_id").alias("line_no")))


_ALL = (
    scanned_tree, history_fallback, wrappers_stripped, exec_outputs, reasoning_headers, shell_commands, settings_models, path_ids, project_dirs, source_signatures, merged_ranges, citation_footers, previews, field_masks, patches, plans, settings,
    fingerprints, checksums, upserts, valid_relations, forked_sessions, equivalent_copies, ambiguous_ids, branch_values,
)
QUERIES = {f.__name__: f for f in _ALL}

_NL = "chr(10)"
ORACLE = {
    "scanned_tree": """SELECT producer, count(*) AS lines, count(*) AS numbered, count(*) FILTER (json_valid(line)) AS records, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM rollout_raw WHERE producer IS NOT NULL AND line IS NOT NULL GROUP BY 1""",
    "history_fallback": """SELECT lower(sessionId) AS id, coalesce(CASE WHEN max(batch_id) % 2 = 0 THEN min(cwd) END, arg_max(cwd, row_id) FILTER (cwd IS NOT NULL)) AS cwd FROM basic_session WHERE sessionId IS NOT NULL GROUP BY 1""",
    "wrappers_stripped": r"""SELECT doc_id, trim(regexp_replace('/' || source || ' ' || title, '\s+', ' ', 'g')) AS stripped, 'say <bash-input>' || source || '</bash-input>' AS kept FROM documents""",
    "exec_outputs": """SELECT doc_id, CASE WHEN text IS NOT NULL THEN CAST(doc_id % 200 AS INT) END AS exit_code, CASE WHEN text IS NOT NULL THEN doc_id % 100 + CAST(0.5 AS DOUBLE) END AS wall_seconds, text AS output FROM documents
UNION ALL SELECT doc_id, CAST(-(doc_id % 7) AS INT), NULL, 'Process exited with code -' || (doc_id % 7) || chr(10) || 'no output' FROM documents""",
    "reasoning_headers": """SELECT doc_id, CASE WHEN text IS NOT NULL THEN 'Step ' || doc_id END AS header, text AS body FROM documents UNION ALL SELECT doc_id, NULL, '**Step** ' || source FROM documents""",
    "shell_commands": """SELECT doc_id, CASE WHEN source IS NOT NULL THEN 'ls ' || source END AS command, CASE WHEN source IS NOT NULL THEN CAST(doc_id % 3 AS INT) END AS exit_code,
  CASE WHEN source IS NOT NULL THEN doc_id % 50 * 1000 + 250 END AS duration_ms, CASE WHEN source IS NOT NULL THEN session_id END AS stdout FROM documents WHERE session_id IS NOT NULL
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL FROM documents WHERE session_id IS NOT NULL""",
    "settings_models": "SELECT doc_id, source || ' (High)' AS model FROM documents",
    "path_ids": "SELECT doc_id, session_id AS plain, session_id AS packed, 'unknown-session' AS blank FROM documents WHERE session_id IS NOT NULL UNION ALL SELECT doc_id, 'unknown-session', 'unknown-session', 'unknown-session' FROM documents WHERE session_id IS NULL",
    "project_dirs": "SELECT DISTINCT cwd, replace(cwd, '-', '/') AS decoded, 'C:/' || substr(replace(cwd, '-', '/'), 2) AS on_drive FROM basic_session WHERE cwd IS NOT NULL",
    "source_signatures": """SELECT doc_id, left(sha256('{"doc_id":' || doc_id || ',"source":"' || source || '"}'), 16) AS signature FROM documents WHERE source IS NOT NULL""",
    "merged_ranges": """
WITH r AS (SELECT session_id, doc_id * 37 % 400 AS s, doc_id * 37 % 400 + n_chars % 23 AS e FROM documents WHERE session_id IS NOT NULL AND n_chars IS NOT NULL),
m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY session_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS starts FROM r),
g AS (SELECT *, sum(starts) OVER (PARTITION BY session_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT session_id, CAST(min(s) AS INT) AS start, CAST(max(e) AS INT) AS "end" FROM g GROUP BY session_id, island""",
    "citation_footers": """SELECT doc_id, 0 AS form, source AS body, CASE WHEN source IS NOT NULL THEN '<oai-mem-citation>x</oai-mem-citation>' END AS footer FROM documents
UNION ALL SELECT doc_id, 1, '```' || chr(10) || source || chr(10) || '<oai-mem-citation>x</oai-mem-citation>' || chr(10), NULL FROM documents""",
    "previews": r"""SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN nullif(trim(regexp_replace(title, '\s+', ' ', 'g')), '') END, nullif(trim(regexp_replace(source, '\s+', ' ', 'g')), '')) AS preview FROM documents""",
    # Bits: 1 user, 2 agent, 4 and 8 tool call and result, 16 documents, 32 skill, 64 context, 128 and 256 the user's own tool call and result, 512 thinking; 16, 64 and 512 are hidden by default.
    "field_masks": """
WITH m AS (SELECT unnest([0, 1, 2, 4, 8, 12, 16, 17, 33, 64, 65, 66, 128, 384, 512]) AS mask), d AS (SELECT unnest(['default', 'all shown']) AS display, unnest([592, 0]) AS hidden), o AS (SELECT unnest(['all', 'visible', 'hidden']) AS mode)
SELECT display, mode, CAST(mask AS INT) AS mask FROM m, d, o WHERE mode = 'all' OR ((mask & hidden) = 0) = (mode = 'visible')""",
    "patches": """
SELECT doc_id, 1::BIGINT AS n, 'add' AS op, source || '/new.py' AS path, 3::BIGINT AS added, 0::BIGINT AS removed, title || chr(10) || chr(10) || 'end' AS body FROM documents WHERE title IS NOT NULL AND source IS NOT NULL
UNION ALL SELECT doc_id, 2, 'update', 'a b.txt', 1, 2, NULL FROM documents WHERE title IS NOT NULL AND source IS NOT NULL
UNION ALL SELECT doc_id, 3, 'delete', 'gone', 0, 0, NULL FROM documents WHERE title IS NOT NULL AND source IS NOT NULL""",
    "plans": """SELECT doc_id, CAST(0 AS INT) AS place, source AS step, 'pending' AS status FROM documents WHERE source IS NOT NULL UNION ALL SELECT doc_id, 1, 'b', 'completed' FROM documents WHERE source IS NOT NULL""",
    "settings": """SELECT * FROM (VALUES ('day', CAST(CAST(epoch(TIMESTAMP '2026-02-03 00:00:00') AS BIGINT) AS VARCHAR)), ('end of day', CAST(CAST(epoch(TIMESTAMP '2026-02-03 23:59:59') AS BIGINT) AS VARCHAR)),
('moment', CAST(CAST(epoch(TIMESTAMP '2026-02-03 02:05:06') AS BIGINT) AS VARCHAR)), ('json', '20'), ('markdown', '2000'), ('zip', NULL), ('merged agent', 'wiki'), ('merged lines', '3'), ('active', '2'), ('dir', '/a/b'), ('branch', 'main'), ('plain dir', '/a/b'),
('profile', left(sha256('["/a", "/b"]'), 16))) t(name, value)""",
    "fingerprints": """
WITH l AS (SELECT file_id, line_no, arg_min(line, row_id) AS line FROM rollout_raw GROUP BY 1, 2)
SELECT file_id, count(*) AS lines, sha256(arg_max(line, line_no)) AS last_hash FROM l WHERE trim(line) <> '' GROUP BY 1""",
    "checksums": "SELECT source AS path, count(*) AS files, count(DISTINCT text) AS contents FROM documents WHERE source IS NOT NULL GROUP BY 1",
    "upserts": """
WITH r AS (SELECT lower(sessionId) AS path, batch_id, max(batch_id) OVER () AS top FROM basic_session WHERE sessionId IS NOT NULL)
SELECT path, count(*) FILTER (hot OR batch_id < top) AS n FROM (SELECT *, max(batch_id) OVER (PARTITION BY path) AS newest, max(batch_id) OVER (PARTITION BY path) = top AS hot FROM r) GROUP BY path HAVING max(newest) > 1""",
    "valid_relations": """
WITH r AS (SELECT lower(sessionId) AS s, batch_id, lower(forkedFrom.sessionId) AS p, max(batch_id) OVER () AS top FROM basic_session WHERE sessionId IS NOT NULL),
same AS (SELECT s FROM r GROUP BY s HAVING max(batch_id) < max(top))
SELECT DISTINCT s AS child, p AS parent FROM r WHERE p IS NOT NULL AND s IN (SELECT s FROM same) AND p IN (SELECT s FROM same)""",
    "forked_sessions": """
WITH s AS (SELECT DISTINCT lower(sessionId) AS s FROM rich_content WHERE sessionId IS NOT NULL AND uuid IS NOT NULL)
SELECT s AS key, s || '-g' AS superseded_by FROM s UNION ALL SELECT s || '-f', s || '-g' FROM s""",
    "equivalent_copies": "SELECT DISTINCT lower(sessionId) AS key, lower(sessionId) || '-copy' AS superseded_by FROM rich_content WHERE sessionId IS NOT NULL AND uuid IS NOT NULL",
    "ambiguous_ids": "SELECT gitBranch AS rollout_id, count(DISTINCT cwd) AS paths FROM basic_session WHERE gitBranch IS NOT NULL AND cwd IS NOT NULL GROUP BY 1 HAVING count(DISTINCT cwd) > 1",
    "branch_values": "SELECT row_id, CASE WHEN coalesce(isSidechain, false) THEN gitBranch ELSE coalesce(gitBranch, version) END AS branch FROM basic_session",
}
