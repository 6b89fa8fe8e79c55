"""Queries of the session operators over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import rules, sinks
from threadloom.functions import text as tx
from threadloom.operators import cells, history, lineage, projection, search, sessions, sync, tools
from threadloom.streaming import ingest
from threadloom.util import table


def _basic(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "basic_session")


def _rollout(spark: SparkSession, sf: str, *payload: str) -> DataFrame:
    return sessions.rollout_lines(table(spark, sf, "new_format"), payload)


def parse_transcript_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """P2, P26, P27, A1-A3, A9."""
    s = sessions.transcript_sessions(_basic(spark, sf))
    return s.select("session_id", "cwd", "branch", "model", "slug", "lines", "user_turns", "agent_turns", "is_sidechain", "modified_ts", "derivation_type", tx.compact(F.col("first_user_msg_content"), 60).alias("first_user"), "last_msg_role")


def parse_noise(spark: SparkSession, sf: str) -> DataFrame:
    """P3, JN3."""
    rows = _basic(spark, sf).select("row_id", "uuid", "parentUuid", F.col("message.content").alias("text"))
    return sessions.without_noise(rows).select("row_id")


def parse_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Adjacent text blocks merged."""
    return sessions.block_text(table(spark, sf, "rich_content"))


def parse_rollout_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """P8, P9, P17."""
    return sessions.rollout_sessions(_rollout(spark, sf, "type", "id", "cwd", "originator", "model", "effort", "info")).drop("created", "modified")


def pair_calls(spark: SparkSession, sf: str) -> DataFrame:
    """P10, JN1."""
    return sessions.paired_calls(_rollout(spark, sf, "type", "call_id", "name", "arguments", "output")).select("file_id", "call_id", "call_line", "name", "output_line", "status")


def redundant_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """P10: outputs after their call's end event."""
    return sessions.redundant_outputs(sessions.rollout_lines(table(spark, sf, "latest_format"), ("type", "call_id"))).select("file_id", "line_no", F.col("payload.call_id").alias("call_id"))


def adjacent_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """P24, W1."""
    rows = _basic(spark, sf).where("sessionId IS NOT NULL").select("row_id", F.lower("sessionId").alias("session_id"), "type", F.col("message.content").alias("content"))
    return sessions.adjacent_distinct(rows, "session_id", ["row_id"], ["type", "content"]).select("row_id")


def carried_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Tool results with the name of the call before them."""
    blocks = table(spark, sf, "rich_content").select("row_id", F.lower("sessionId").alias("session_id"), F.posexplode("message.content").alias("place", "b")).where("b IS NOT NULL AND session_id IS NOT NULL")
    kind = F.when(F.col("b.type") == "tool_use", "tool_call").when(F.col("b.type") == "tool_result", "tool_result").otherwise("message")
    rows = blocks.select("row_id", "place", "session_id", kind.alias("kind"), F.col("b.name").alias("name"))
    return sessions.carried_calls(rows, "session_id", ["row_id", "place"], F.col("kind"), F.col("name")).where("kind = 'tool_result'").select("row_id", "place", "call_summary")


def user_turns(spark: SparkSession, sf: str) -> DataFrame:
    """W5."""
    rows = _rollout(spark, sf, "type").select("file_id", "line_no", F.col("payload.type").alias("kind"))
    return sessions.user_turns(rows, "file_id", ["line_no"], F.col("kind") == "user_message").groupBy("file_id", "turn").agg(F.count(F.lit(1)).alias("rows"), F.max("line_no").alias("last_line"))


def running_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Where each line of a file begins."""
    lines = table(spark, sf, "rollout_raw").groupBy("file_id", "line_no").agg(F.min_by("line", "row_id").alias("line"))
    return sessions.running_offsets(lines).select("file_id", "line_no", "byte_start", "byte_end")


def ordinal_regressions(spark: SparkSession, sf: str) -> DataFrame:
    """W4."""
    rows = table(spark, sf, "latest_format").select("row_id", "file_id", "line_no", "ordinal", "ingested_at")
    return sessions.ordinal_regressions(rows, order="row_id").select("row_id", "ordinal", "highest")


def history_headers(spark: SparkSession, sf: str) -> DataFrame:
    """H1, H2: the thread of each file."""
    lines = table(spark, sf, "rollout_raw").select(F.col("file_id").cast("string").alias("path"), "line_no", "line")
    return history.headers(lines).select("path", "thread_id", "base_id", "base_end_ordinal", "mode")


def history_tips(spark: SparkSession, sf: str) -> DataFrame:
    """H3: current version of each thread."""
    lines = table(spark, sf, "rollout_raw").select(F.col("file_id").cast("string").alias("path"), "line_no", "line")
    members = history.headers(lines).select("thread_id", F.col("thread_id").alias("rollout_id"), "path", "base_id", F.lit(False).alias("trashed"))
    return history.tips(members).select("thread_id", "path", "status")


def thread_names(spark: SparkSession, sf: str) -> DataFrame:
    """SC10: the last slug of each session."""
    rows = _basic(spark, sf).where("slug IS NOT NULL").select(F.lower("sessionId").alias("id"), F.col("slug").alias("thread_name"), F.col("row_id").alias("line_no"))
    return history.thread_names(rows)


def _state(rows: DataFrame) -> DataFrame:
    return rows.where("sessionId IS NOT NULL").groupBy(F.lower("sessionId").alias("path")).agg(
        F.unix_timestamp(F.max("timestamp")).alias("mtime"), F.count(F.lit(1)).alias("size"), F.lit("transcript").alias("agent"), F.lit(False).alias("trashed"),
        F.lit(None).cast("string").alias("original_path"), F.lit(None).cast("string").alias("signature"),
    )


def sync_changes(spark: SparkSession, sf: str) -> DataFrame:
    """JN9, I1: the first five batches against all but the first."""
    rows = _basic(spark, sf)
    return sync.detect(_state(rows.where("batch_id > 1")), _state(rows.where("batch_id <= 5")))


def sync_whole(spark: SparkSession, sf: str) -> DataFrame:
    """JN9, I1: the whole table against the state after the delivery before the last."""
    rows = _basic(spark, sf)
    last = rows.agg(F.max("batch_id")).first()[0]
    return sync.detect(_state(rows), _state(rows.where(F.col("batch_id") < F.lit(last))))


def sync_whole_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """A11."""
    return sync.statistics(sync_whole(spark, sf))


def sync_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """A11."""
    return sync.statistics(sync_changes(spark, sf))


def session_families(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of sessions by their forks."""
    rows = _basic(spark, sf).where("sessionId IS NOT NULL")
    edges = rows.where("forkedFrom.sessionId IS NOT NULL").select(F.lower("sessionId").alias("a"), F.lower("forkedFrom.sessionId").alias("b")).distinct()
    v = rows.select(F.lower("sessionId").alias("v")).distinct()
    return lineage.components(v, edges.join(v.select(F.col("v").alias("b")), "b", "left_semi")).select(F.col("v").alias("session_id"), F.col("root").alias("family"))


def supersession(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that a fork stands for."""
    rows = _basic(spark, sf).where("sessionId IS NOT NULL AND uuid IS NOT NULL").withColumn("s", F.lower("sessionId"))
    inherited = F.lower("forkedFrom.messageUuid")
    s = rows.groupBy("s").agg(
        F.array_sort(F.collect_set(F.lower("uuid"))).alias("events"), F.array_sort(F.collect_set(inherited)).alias("inherited"), F.count_if(inherited.isNull()).alias("own"),
        F.array_sort(F.collect_set(F.lower("forkedFrom.sessionId"))).alias("fork_parents"), F.unix_timestamp(F.max("timestamp")).alias("modified"),
    )
    aborted = F.lit(None).cast("struct<events:array<string>,active:boolean,lines:string>")
    s = s.select(
        F.col("s").alias("key"), F.lit("transcript").alias("agent"), F.col("s").alias("session_id"), "fork_parents", F.lit(False).alias("trashed"), F.lit(True).alias("safe"), "modified", "events", "inherited", "own",
        F.array().cast("array<string>").alias("activity"), aborted.alias("aborted"), F.array().cast("array<struct<lines:string,last:string>>").alias("turns"),
    )
    return lineage.superseded(s)


def visibility(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by mask, and whether they show by default."""
    s = projection.segments(table(spark, sf, "rich_content"))
    return s.groupBy("mask").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.length("text")).alias("chars"), F.bool_and(projection.visible(F.col("mask"), projection.Display())).alias("shown"))


def search_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Text of each session by mask."""
    return projection.search_fields(table(spark, sf, "rich_content"))


# What generated messages begin with, set round a row's text by the flags that the row has, so that each rule of J4 meets rows.
_FORMED = """CASE WHEN isSidechain THEN concat('# AGENTS.md instructions for /x', chr(10), coalesce(message.content, '')) WHEN isMeta THEN '<skill>x</skill> and more' WHEN gitBranch IS NULL THEN '<goal_context>x</goal_context>'
  WHEN slug IS NULL THEN ' <task-notification>x</task-notification>' ELSE message.content END"""


def message_masks(spark: SparkSession, sf: str) -> DataFrame:
    """J4."""
    rows = _basic(spark, sf).where("message IS NOT NULL").withColumn("text", F.expr(_FORMED))
    mask = projection.message_mask(F.coalesce("message.role", "type"), F.col("text"), F.col("isCompactSummary"))
    return rows.select("row_id", mask.alias("mask"))


def _shown_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Messages as parts of sessions: analyzed content, the user's own words, and whether they show by default."""
    rows = _basic(spark, sf).where("message IS NOT NULL AND sessionId IS NOT NULL")
    role = F.coalesce("message.role", "type")
    mask = projection.message_mask(role, F.col("message.content"), F.col("isCompactSummary"))
    parts = rows.select(F.lower("sessionId").alias("session_id"), F.col("message.content").alias("text"), F.when(role == "user", F.col("message.content")).alias("said"), projection.visible(mask, projection.Display()).alias("shown"))
    return search.indexed(parts, {"content": "text", "user": "said"})


# Each query text beside the SQL condition over h(x): some part of the session holds the word x, with s = shown, c = padded words, u = the user's.
VISIBLE = {
    "q02_visible": ("visible: summary parser", "bool_or(s AND c LIKE '% summary %') AND bool_or(s AND c LIKE '% parser %')"),
    "q02_hidden": ("hidden: the", "bool_or(NOT s AND c LIKE '% the %')"),
    "q02_all": ("all: session NOT cache", "bool_or(c LIKE '% session %') AND NOT bool_or(c LIKE '% cache %')"),
    "q02_default": ("parser AND NOT ledger", "bool_or(s AND c LIKE '% parser %') AND NOT bool_or(s AND c LIKE '% ledger %')"),
    "q02_prefixed": ("hidden: the OR user:parser", "bool_or(NOT s AND c LIKE '% the %') OR bool_or(u LIKE '% parser %')"),
}


def _seen(text: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return search.sessions_matching(_shown_parts(spark, sf), "session_id", text)

    return run


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return cells.parse([("transcript", table(spark, sf, "rich_content")), *[("rollout", table(spark, sf, t)) for t in ("old_format", "new_format", "latest_format")]])


def parse_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of all producers and formats."""
    return _cells(spark, sf)


def session_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of cells by session."""
    return cells.metrics(_cells(spark, sf))


def live_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """S9, JN8: sessions found that are running: those of the last delivery."""
    rows = _basic(spark, sf)
    last = rows.agg(F.max("batch_id")).first()[0]
    live = rows.where((F.col("batch_id") == F.lit(last)) & F.col("sessionId").isNotNull()).select(F.lit("transcript").alias("agent"), F.lower("sessionId").alias("session_id"))
    found = sessions.transcript_sessions(rows)
    hits = search.search(found, search.Request(filters=search.Filters(live_only=True, include_sub_agents=True), limit=100_000), key="session_id", live=live)
    return hits.select("session_id", "is_live", "modified_ts")


def tool_labels(spark: SparkSession, sf: str) -> DataFrame:
    """P29."""
    names = table(spark, sf, "rich_content").select(F.explode("message.content").alias("b")).where("b.name IS NOT NULL")
    return names.groupBy(tx.tool_label(F.col("b.name")).alias("label")).agg(F.count(F.lit(1)).alias("calls"))


def line_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Hash of the multiset of lines of each text."""
    return table(spark, sf, "documents").select("doc_id", tx.line_fingerprint(F.col("text")).alias("hash"))


def query_history(spark: SparkSession, sf: str) -> DataFrame:
    """O3: latest entry of each query."""
    h = table(spark, sf, "documents").where("title IS NOT NULL").select(F.col("title").alias("query"), F.col("created_at").alias("saved_at"))
    return sinks.history_updated(h, h, 100).select("query", F.unix_timestamp("saved_at").alias("saved_at"))


def export_names(spark: SparkSession, sf: str) -> DataFrame:
    """K4."""
    d = table(spark, sf, "documents").select("doc_id", sinks.file_stem(F.col("created_at"), F.split_part("source", F.lit("/"), F.lit(1)), F.coalesce("session_id", F.lit("none")), F.col("title")).alias("stem"))
    return sinks.file_names(d, "doc_id")


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = _basic(spark, sf).where("sessionId IS NOT NULL AND type IN ('user', 'assistant')")
    return rows.select(F.lower("sessionId").alias("session_id"), F.col("row_id").alias("turn_no"), F.coalesce("message.role", "type").alias("speaker"), F.col("message.content").alias("content"), "timestamp")


def export_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """K2: a document for each session."""
    return sinks.markdown(_messages(spark, sf))


def export_text(spark: SparkSession, sf: str) -> DataFrame:
    """K3: role, time and text of each turn."""
    return sinks.plain_text(_messages(spark, sf))


def export_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """K1."""
    return sinks.compact_json(sessions.transcript_sessions(_basic(spark, sf)).select("session_id", "cwd", "branch", "first_user_msg_content", "lines"))


def rule_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Short sessions proposed for the trash by a rule."""
    r = rules.Rules()

    @r.rule("short", max_turns=3)
    def short(context: dict) -> dict:
        return rules.trash(f"{context['user_turns']} user turns")

    m = _messages(spark, sf)
    s = m.groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"))
    return rules.report(rules.evaluate(s, m, r))["proposals"].select("rule", "session_id", "action", "reason")


def rule_filters(spark: SparkSession, sf: str) -> DataFrame:
    """A rule over sessions of at least ten lines that are no sub-agents' ones."""
    r = rules.Rules()

    @r.rule("few", max_turns=8)
    def few(context: dict) -> dict:
        return rules.trash(f"{context['session']['lines']} lines")

    found = sessions.transcript_sessions(_basic(spark, sf)).select("session_id", "agent", "lines", "derivation_type")
    out = rules.evaluate(found, _messages(spark, sf), r, filters=search.Filters(agent="transcript", min_lines=10))
    return rules.report(out)["proposals"].select("session_id", "reason")


def activity_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of activity closed after 30 minutes, the batch form of the streaming operator."""
    a = ingest.activity(_basic(spark, sf))
    return a.select("session_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), F.col("rows"))


def step_merge(spark: SparkSession, sf: str) -> DataFrame:
    """P19, JN2: the latest format and the records of the new format whose (file, line) is not in it, by a shared step number."""
    a = table(spark, sf, "latest_format").select("row_id", (F.col("file_id") % 1_000_000 * 1000 + F.col("line_no")).alias("step_index"), F.lit("full").alias("src"))
    b = table(spark, sf, "new_format").select("row_id", (F.col("file_id") % 1_000_000 * 1000 + F.col("line_no")).alias("step_index"), F.lit("regular").alias("src"))
    return sessions.two_source_merge(a, b)


def _tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    blocks = table(spark, sf, "rich_content").select("row_id", F.posexplode("message.content").alias("place", "b")).where("b.type = 'tool_use'")
    return blocks.select("row_id", "place", F.col("b.name").alias("name"), F.col("b.input").alias("arguments"))


def tool_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """What each tool call does, in a line."""
    return tools.with_summaries(_tool_calls(spark, sf)).select("row_id", "place", "summary")


def readable_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """The plain values of each tool input."""
    return _tool_calls(spark, sf).select("row_id", "place", tools.over(lambda v: tools.readable(tools.loads(v)), "string", F.col("arguments")).alias("text"))


def captured_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every path written in a tool input, with its kind."""
    found = tools.with_paths(_tool_calls(spark, sf), "arguments", "transcript")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"captured.{k}").alias("p")) for k in ("dirs", "files", "paths")])
    return found.select("row_id", "place", F.inline(kinds)).select("row_id", "place", "kind", F.explode("p").alias("path"))


def discovery_records(spark: SparkSession, sf: str) -> DataFrame:
    """Compact records of sessions."""
    return search.discovery(sessions.transcript_sessions(_basic(spark, sf))).drop("created", "modified")


_ALL = (
    tool_summaries, readable_inputs, captured_paths, discovery_records,
    parse_transcript_sessions, parse_noise, parse_blocks, parse_rollout_sessions, pair_calls, redundant_outputs, adjacent_distinct, carried_calls, user_turns, running_offsets, ordinal_regressions,
    history_headers, history_tips, thread_names, sync_changes, sync_statistics, sync_whole, sync_whole_statistics, session_families, supersession, visibility, search_fields, message_masks, tool_labels, line_fingerprints,
    query_history, export_names, export_markdown, export_jsonl, rule_proposals, activity_spans, step_merge,
)
QUERIES = {f.__name__: f for f in (*_ALL, rule_filters, live_sessions, export_text, parse_cells, session_metrics)} | {name: _seen(text) for name, (text, _) in VISIBLE.items()}

_LINES = "SELECT DISTINCT ON (file_id, line_no) * FROM {t} ORDER BY file_id, line_no, ingested_at, row_id"
_ROLE = "coalesce(message.role, type)"
_SAID = "(type IN ('user', 'assistant') AND NOT coalesce(isMeta, false) AND trim(coalesce(message.content, '')) <> '')"

_SEGMENTS = """
WITH e AS (SELECT row_id, lower(sessionId) AS session, coalesce(message.role, type) AS role, unnest(message.content) AS b, unnest(range(1, len(message.content) + 1)) - 1 AS part FROM rich_content),
k AS (SELECT row_id, session, part, role, coalesce(b.type, 'text') AS kind, b FROM e WHERE b IS NOT NULL),
p AS (SELECT *, unnest(['text', 'name', 'input', 'output']) AS name,
  unnest([coalesce(b.text, b.thinking), b.name, b.input, array_to_string(list_filter(list_transform(b.content, lambda c: c.text), lambda c: c IS NOT NULL), chr(10) || chr(10))]) AS text FROM k),
s AS (SELECT row_id, session, part, kind, name, text, CASE kind WHEN 'thinking' THEN 512 WHEN 'tool_use' THEN 4 WHEN 'tool_result' THEN 8 ELSE CASE role WHEN 'user' THEN 1 ELSE 2 END END AS mask
  FROM p WHERE text IS NOT NULL AND trim(text) <> '')"""

_WHOLE = """
WITH a AS (SELECT lower(sessionId) AS path, CAST(floor(epoch(max(timestamp))) AS BIGINT) AS m, count(*) AS n FROM basic_session WHERE sessionId IS NOT NULL GROUP BY 1),
b AS (SELECT lower(sessionId) AS path, CAST(floor(epoch(max(timestamp))) AS BIGINT) AS m, count(*) AS n FROM basic_session WHERE sessionId IS NOT NULL AND batch_id < (SELECT max(batch_id) FROM basic_session) GROUP BY 1),
c AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'deleted' WHEN a.m IS DISTINCT FROM b.m OR a.n <> b.n THEN 'changed' ELSE 'unchanged' END AS change
  FROM a FULL OUTER JOIN b ON a.path = b.path)"""

ORACLE = {
    "parse_transcript_sessions": f"""
WITH s AS (SELECT lower(sessionId) AS session_id, arg_min(cwd, row_id) FILTER (cwd IS NOT NULL) AS cwd, arg_min(gitBranch, row_id) FILTER (gitBranch IS NOT NULL) AS branch,
  arg_min(message.model, row_id) FILTER (message.model IS NOT NULL) AS model, arg_max(slug, row_id) FILTER (slug IS NOT NULL) AS slug, count(*) AS lines,
  count(*) FILTER ({_SAID} AND {_ROLE} = 'user') AS user_turns, count(*) FILTER ({_SAID} AND {_ROLE} = 'assistant') AS agent_turns,
  bool_and(coalesce(isSidechain, false)) AS is_sidechain, greatest(coalesce(CAST(floor(epoch(max(timestamp))) AS BIGINT), 0), 0) AS modified_ts,
  arg_min(message.content, row_id) FILTER ({_SAID} AND {_ROLE} = 'user' AND NOT coalesce(isCompactSummary, false)) AS fu,
  arg_max({_ROLE}, row_id) FILTER ({_SAID}) AS last_msg_role
  FROM basic_session WHERE sessionId IS NOT NULL GROUP BY 1),
f AS (SELECT *, trim(regexp_replace(fu, '\\s+', ' ', 'g')) AS t, lower(coalesce(cwd, session_id)) AS p FROM s WHERE user_turns + agent_turns > 0)
SELECT session_id, cwd, branch, model, slug, lines, user_turns, agent_turns, is_sidechain, modified_ts,
  CASE WHEN is_sidechain OR regexp_matches(p, '(^|/)subagents(/|$)') THEN 'sub_agent' WHEN contains(p, 'trimmed') THEN 'trimmed' WHEN contains(p, 'continued') THEN 'continued'
       WHEN contains(p, 'rollover') THEN 'rollover' ELSE 'original' END AS derivation_type,
  CASE WHEN length(t) > 60 THEN left(t, 59) || '…' ELSE t END AS first_user, last_msg_role FROM f""",
    "parse_noise": r"""
WITH b AS (SELECT row_id, uuid, parentUuid, coalesce(message.content, '') AS t FROM basic_session),
x AS (SELECT uuid, min(row_id) AS at FROM b WHERE regexp_matches(t, '^\s*<command-name>/exit</command-name>') AND uuid IS NOT NULL GROUP BY 1)
SELECT row_id FROM b WHERE NOT regexp_matches(t, '^\s*<local-command-caveat>') AND NOT regexp_matches(t, '^\s*<command-name>/exit</command-name>')
AND NOT (regexp_matches(t, '^\s*<local-command-stdout>') AND EXISTS (SELECT 1 FROM x WHERE x.uuid = b.parentUuid AND x.at < b.row_id))""",
    "parse_blocks": """
WITH e AS (SELECT row_id, unnest(message.content) AS b, unnest(range(1, len(message.content) + 1)) AS place FROM rich_content),
k AS (SELECT row_id, place, coalesce(b.type, 'unknown') AS kind,
  coalesce(b.text, b.thinking, CASE WHEN b.content IS NULL THEN NULL ELSE coalesce(array_to_string(list_filter(list_transform(b.content, lambda c: c.text), lambda c: c IS NOT NULL), chr(10) || chr(10)), '') END, b.input) AS text FROM e WHERE b IS NOT NULL),
i AS (SELECT *, CASE WHEN kind = 'text' AND lag(kind) OVER (PARTITION BY row_id ORDER BY place) = 'text' THEN 0 ELSE 1 END AS starts FROM k),
g AS (SELECT *, sum(starts) OVER (PARTITION BY row_id ORDER BY place) AS part FROM i)
SELECT row_id, CAST(part AS BIGINT) AS part, min(kind) AS kind, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY place), '') AS text FROM g GROUP BY 1, 2""",
    "parse_rollout_sessions": f"""
WITH r AS ({_LINES.format(t="new_format")}), k AS (SELECT *, coalesce(payload.type, type) AS kind, TRY_CAST(timestamp AS TIMESTAMPTZ) AS ts FROM r)
SELECT file_id, arg_min(payload.id, line_no) FILTER (type = 'session_meta' AND payload.id IS NOT NULL) AS session_id, arg_min(payload.cwd, line_no) FILTER (type = 'session_meta' AND payload.cwd IS NOT NULL) AS cwd,
  arg_min(payload.originator, line_no) FILTER (type = 'session_meta' AND payload.originator IS NOT NULL) AS originator, arg_max(payload.model, line_no) FILTER (type = 'turn_context' AND payload.model IS NOT NULL) AS model,
  arg_max(payload.effort, line_no) FILTER (type = 'turn_context' AND payload.effort IS NOT NULL) AS effort, count(*) AS lines, count(*) FILTER (kind = 'user_message') AS user_messages,
  count(*) FILTER (kind = 'agent_message') AS agent_messages, count(*) FILTER (kind IN ('function_call', 'custom_tool_call')) AS tool_calls,
  count(*) FILTER (kind IN ('function_call_output', 'custom_tool_call_output')) AS tool_outputs, count(*) FILTER (kind = 'exec_command_end') AS exec_ends,
  arg_max(payload.info.total_token_usage.total_tokens, line_no) FILTER (payload.info.total_token_usage.total_tokens IS NOT NULL) AS total_tokens,
  CASE WHEN epoch_ms(max(ts)) > epoch_ms(min(ts)) THEN epoch_ms(max(ts)) - epoch_ms(min(ts)) END AS wall_ms FROM k GROUP BY 1""",
    "pair_calls": f"""
WITH r AS ({_LINES.format(t="new_format")}),
c AS (SELECT DISTINCT ON (file_id, payload.call_id) file_id, payload.call_id AS call_id, line_no AS call_line, payload.name AS name FROM r WHERE payload.type IN ('function_call', 'custom_tool_call') AND payload.call_id IS NOT NULL ORDER BY file_id, payload.call_id, line_no, row_id),
o AS (SELECT file_id, payload.call_id AS call_id, min(line_no) AS output_line FROM r WHERE payload.type IN ('function_call_output', 'custom_tool_call_output') AND payload.call_id IS NOT NULL GROUP BY 1, 2)
SELECT c.file_id, c.call_id, call_line, name, output_line, CASE WHEN output_line IS NULL THEN 'pending' ELSE 'done' END AS status FROM c LEFT JOIN o ON c.file_id = o.file_id AND c.call_id = o.call_id""",
    "redundant_outputs": f"""
WITH r AS ({_LINES.format(t="latest_format")}),
e AS (SELECT file_id, payload.call_id AS call_id, min(line_no) AS ended FROM r WHERE payload.type IN ('exec_command_end', 'patch_apply_end', 'web_search_end') GROUP BY 1, 2)
SELECT r.file_id, r.line_no, r.payload.call_id AS call_id FROM r JOIN e ON r.file_id = e.file_id AND r.payload.call_id = e.call_id AND r.line_no > e.ended WHERE r.payload.type IN ('function_call_output', 'custom_tool_call_output')""",
    "adjacent_distinct": """
WITH b AS (SELECT row_id, type, message.content AS c, lag(type) OVER w AS t0, lag(message.content) OVER w AS c0, lag(row_id) OVER w AS r0 FROM basic_session WHERE sessionId IS NOT NULL WINDOW w AS (PARTITION BY lower(sessionId) ORDER BY row_id))
SELECT row_id FROM b WHERE r0 IS NULL OR t0 IS DISTINCT FROM type OR c0 IS DISTINCT FROM c""",
    "carried_calls": """
WITH e AS (SELECT row_id, lower(sessionId) AS s, unnest(message.content) AS b, unnest(range(1, len(message.content) + 1)) - 1 AS place FROM rich_content WHERE sessionId IS NOT NULL),
k AS (SELECT row_id, s, place, CASE WHEN b.type = 'tool_use' THEN 'tool_call' WHEN b.type = 'tool_result' THEN 'tool_result' ELSE 'message' END AS kind, b.name AS name FROM e WHERE b IS NOT NULL),
g AS (SELECT *, sum(CASE WHEN kind = 'message' THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY row_id, place) AS reset FROM k),
l AS (SELECT *, last_value(CASE WHEN kind = 'tool_call' THEN name END IGNORE NULLS) OVER (PARTITION BY s, reset ORDER BY row_id, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS call_summary FROM g)
SELECT row_id, CAST(place AS INT) AS place, call_summary FROM l WHERE kind = 'tool_result'""",
    "user_turns": f"""
WITH r AS ({_LINES.format(t="new_format")}), t AS (SELECT file_id, line_no, CAST(sum(CASE WHEN payload.type = 'user_message' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no) AS BIGINT) AS turn FROM r)
SELECT file_id, turn, count(*) AS rows, max(line_no) AS last_line FROM t GROUP BY 1, 2""",
    "running_offsets": """
WITH l AS (SELECT file_id, line_no, arg_min(line, row_id) AS line FROM rollout_raw GROUP BY 1, 2)
SELECT file_id, line_no, CAST(sum(strlen(line) + 1) OVER w AS BIGINT) - (strlen(line) + 1) AS byte_start, CAST(sum(strlen(line) + 1) OVER w AS BIGINT) AS byte_end FROM l WINDOW w AS (PARTITION BY file_id ORDER BY line_no)""",
    "ordinal_regressions": """
WITH o AS (SELECT row_id, ordinal, max(ordinal) OVER (PARTITION BY file_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM latest_format)
SELECT row_id, ordinal, highest FROM o WHERE ordinal <= highest""",
    "thread_names": "SELECT lower(sessionId) AS id, arg_max(slug, row_id) AS thread_name FROM basic_session WHERE slug IS NOT NULL AND sessionId IS NOT NULL GROUP BY 1",
    "sync_changes": """
WITH a AS (SELECT lower(sessionId) AS path, CAST(floor(epoch(max(timestamp))) AS BIGINT) AS m, count(*) AS n FROM basic_session WHERE sessionId IS NOT NULL AND batch_id > 1 GROUP BY 1),
b AS (SELECT lower(sessionId) AS path, CAST(floor(epoch(max(timestamp))) AS BIGINT) AS m, count(*) AS n FROM basic_session WHERE sessionId IS NOT NULL AND batch_id <= 5 GROUP BY 1)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'deleted' WHEN a.m IS DISTINCT FROM b.m OR a.n <> b.n THEN 'changed' ELSE 'unchanged' END AS change FROM a FULL OUTER JOIN b ON a.path = b.path""",
    "sync_whole": f"{_WHOLE} SELECT path, change FROM c",
    "sync_whole_statistics": f"""{_WHOLE} SELECT count(*) FILTER (change <> 'deleted') AS scanned, count(*) FILTER (change IN ('new', 'changed')) AS updated,
  count(*) FILTER (change = 'unchanged') AS skipped, count(*) FILTER (change = 'deleted') AS removed FROM c""",
    "session_families": """
WITH RECURSIVE v AS (SELECT DISTINCT lower(sessionId) AS v FROM basic_session WHERE sessionId IS NOT NULL),
e0 AS (SELECT DISTINCT lower(sessionId) AS a, lower(forkedFrom.sessionId) AS b FROM basic_session WHERE sessionId IS NOT NULL AND forkedFrom.sessionId IS NOT NULL),
e AS (SELECT a, b FROM e0 WHERE b IN (SELECT v FROM v) UNION SELECT b, a FROM e0 WHERE b IN (SELECT v FROM v)),
r AS (SELECT v AS s, v AS x FROM v UNION SELECT r.s, e.b FROM r JOIN e ON r.x = e.a)
SELECT s AS session_id, min(x) AS family FROM r GROUP BY 1""",
    # Bits: 1 user, 2 agent, 8 tool result, 16 documents, 32 skill, 64 context.
    "message_masks": """
SELECT row_id, CASE WHEN role = 'user' THEN CASE WHEN isCompactSummary THEN 65 WHEN form = 'docs' THEN 17 WHEN form = 'skill' THEN 33 WHEN form = 'context' THEN 65 WHEN form = 'told' THEN 8 ELSE 1 END
  WHEN role = 'assistant' THEN 2 WHEN role = 'system' AND form = 'docs' THEN 16 ELSE 0 END AS mask
FROM (SELECT row_id, isCompactSummary, coalesce(message.role, type) AS role, CASE WHEN isSidechain THEN 'docs' WHEN isMeta THEN 'skill' WHEN gitBranch IS NULL THEN 'context' WHEN slug IS NULL THEN 'told' END AS form FROM basic_session WHERE message IS NOT NULL)""",
    "query_history": """
SELECT query, CAST(floor(epoch(saved_at)) AS BIGINT) AS saved_at FROM (SELECT title AS query, max(created_at) AS saved_at FROM documents WHERE title IS NOT NULL GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 100)""",
    "rule_proposals": f"""
SELECT 'short' AS rule, lower(sessionId) AS session_id, 'trash' AS action, count(*) FILTER ({_ROLE} = 'user') || ' user turns' AS reason FROM basic_session
WHERE sessionId IS NOT NULL AND type IN ('user', 'assistant') GROUP BY lower(sessionId) HAVING count(*) FILTER ({_ROLE} = 'user') <= 3""",
    "line_fingerprints": """
SELECT doc_id, sha256(unhex(array_to_string(list_transform(list_sort(list_filter(list_transform(string_split(text, chr(10)), lambda l: rtrim(l, chr(13))), lambda l: l <> '')),
  lambda l: rpad(printf('%02X%02X%02X', strlen(l) % 256, strlen(l) // 256 % 256, strlen(l) // 65536), 16, '0') || hex(l)), ''))) AS hash FROM documents""",
    "activity_spans": """
WITH b AS (SELECT lower(sessionId) AS s, epoch_us(timestamp) AS t FROM basic_session WHERE sessionId IS NOT NULL AND timestamp IS NOT NULL),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY s ORDER BY t) <= 1800000000 THEN 0 ELSE 1 END AS starts FROM b),
i AS (SELECT *, sum(starts) OVER (PARTITION BY s ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT s AS session_id, min(t) AS start_us, max(t) + 1800000000 AS end_us, count(*) AS rows FROM i GROUP BY s, k""",
    "step_merge": """
WITH a AS (SELECT row_id, file_id % 1000000 * 1000 + line_no AS step_index, 'full' AS src FROM latest_format), b AS (SELECT row_id, file_id % 1000000 * 1000 + line_no AS step_index, 'regular' AS src FROM new_format)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE step_index NOT IN (SELECT step_index FROM a)""",
    "tool_labels": """
SELECT CASE WHEN n IN ('bash', 'shell', 'shell_command', 'exec_command', 'execute', 'terminal') THEN 'bash' WHEN n IN ('read', 'write', 'edit', 'glob', 'grep', 'agent') THEN n WHEN n IN ('readfile', 'read_file') THEN 'read' WHEN n IN ('writefile', 'write_file') THEN 'write'
  WHEN n IN ('editfile', 'edit_file') THEN 'edit' WHEN n IN ('patch', 'apply_patch') THEN 'patch' WHEN n IN ('websearch', 'web_search') THEN 'search' WHEN n IN ('webfetch', 'web_fetch') THEN 'fetch' ELSE trim(name) END AS label, count(*) AS calls
FROM (SELECT name, replace(lower(trim(name)), '-', '_') AS n FROM (SELECT unnest(message.content).name AS name FROM rich_content)) WHERE name IS NOT NULL GROUP BY 1""",
    "sync_statistics": """
WITH a AS (SELECT lower(sessionId) AS path, CAST(floor(epoch(max(timestamp))) AS BIGINT) AS m, count(*) AS n FROM basic_session WHERE sessionId IS NOT NULL AND batch_id > 1 GROUP BY 1),
b AS (SELECT lower(sessionId) AS path, CAST(floor(epoch(max(timestamp))) AS BIGINT) AS m, count(*) AS n FROM basic_session WHERE sessionId IS NOT NULL AND batch_id <= 5 GROUP BY 1),
c AS (SELECT a.path AS p, b.path AS q, a.m IS DISTINCT FROM b.m OR a.n <> b.n AS differs FROM a FULL OUTER JOIN b ON a.path = b.path)
SELECT count(*) FILTER (p IS NOT NULL) AS scanned, count(*) FILTER (p IS NOT NULL AND (q IS NULL OR differs)) AS updated,
  count(*) FILTER (p IS NOT NULL AND q IS NOT NULL AND NOT differs) AS skipped, count(*) FILTER (p IS NULL) AS removed FROM c""",
    "visibility": _SEGMENTS + """ SELECT mask, count(*) AS parts, CAST(sum(length(text)) AS BIGINT) AS chars, (mask & 592) = 0 AS shown FROM s GROUP BY 1""",
    "search_fields": _SEGMENTS + """ SELECT session, mask, row_id // 10000 AS part, string_agg(text, chr(10) || chr(10) ORDER BY row_id, s.part, name) AS text FROM s WHERE session IS NOT NULL GROUP BY session, mask, row_id // 10000""",
    "export_markdown": f"""
WITH t AS (SELECT lower(sessionId) AS session_id, row_id, {_ROLE} AS r, coalesce(message.content, '') AS c, coalesce(' · ' || strftime(timestamp, '%Y-%m-%d %H:%M:%S'), '') AS tm FROM basic_session WHERE sessionId IS NOT NULL AND type IN ('user', 'assistant')),
o AS (SELECT *, row_id // 10000 AS p, count(*) OVER (PARTITION BY session_id) AS n, min(row_id) OVER (PARTITION BY session_id) // 10000 AS lead FROM t)
SELECT session_id, p AS part, CASE WHEN p = min(lead) THEN '# Session ' || session_id || chr(10) || chr(10) || '- turns: ' || min(n) || chr(10) || chr(10) ELSE '' END ||
  string_agg('## ' || upper(left(r, 1)) || substr(r, 2) || tm || chr(10) || chr(10) || c || chr(10), chr(10) ORDER BY row_id) AS text FROM o GROUP BY session_id, p""",
    "export_text": f"""
SELECT lower(sessionId) AS session_id, row_id // 10000 AS part, string_agg('[' || {_ROLE} || coalesce(' ' || strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ'), '') || '] ' || coalesce(message.content, ''), chr(10) ORDER BY row_id) AS text
FROM basic_session WHERE sessionId IS NOT NULL AND type IN ('user', 'assistant') GROUP BY 1, 2""",
    "export_names": r"""
WITH d AS (SELECT doc_id, concat_ws('-', strftime(created_at, '%Y-%m-%d'), split_part(source, '/', 1), left(regexp_replace(coalesce(session_id, 'none'), '[^\w-]', '', 'g'), 8),
  nullif(regexp_replace(left(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 48), '-+$', ''), '')) AS stem FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY doc_id) - 1 AS k FROM d)
SELECT doc_id, stem || CASE WHEN k > 0 THEN '-' || k ELSE '' END || '.md' AS file_name FROM n""",
    "live_sessions": f"""
SELECT lower(sessionId) AS session_id, true AS is_live, greatest(coalesce(CAST(floor(epoch(max(timestamp))) AS BIGINT), 0), 0) AS modified_ts FROM basic_session
WHERE sessionId IS NOT NULL GROUP BY 1 HAVING max(batch_id) = (SELECT max(batch_id) FROM basic_session) AND count(*) FILTER ({_SAID} AND {_ROLE} IN ('user', 'assistant')) > 0""",
    "history_tips": """
WITH j AS (SELECT CAST(file_id AS VARCHAR) AS path, line_no, TRY_CAST(line AS JSON) AS v FROM rollout_raw),
m AS (SELECT path, line_no, v ->> '$.type' AS type, coalesce(v ->> '$.payload.id', CASE WHEN line_no = 1 THEN v ->> '$.id' END) AS thread_id, v ->> '$.payload.history_base.thread_id' AS base_id FROM j WHERE v IS NOT NULL),
h AS (SELECT DISTINCT ON (path) path, thread_id, base_id FROM m WHERE thread_id IS NOT NULL AND (type = 'session_meta' OR type IS NULL) ORDER BY path, line_no),
b AS (SELECT h.*, EXISTS (SELECT 1 FROM h x WHERE x.thread_id = h.thread_id AND x.base_id = h.thread_id AND x.path <> h.path) AS is_base FROM h),
c AS (SELECT * FROM b WHERE NOT is_base OR NOT EXISTS (SELECT 1 FROM b y WHERE y.thread_id = b.thread_id AND NOT y.is_base))
SELECT thread_id, path, CASE WHEN count(*) OVER (PARTITION BY thread_id) > 1 THEN 'ambiguous' ELSE 'complete' END AS status FROM c""",
    "discovery_records": f"""
WITH s AS (SELECT lower(sessionId) AS session_id, arg_min(cwd, row_id) FILTER (cwd IS NOT NULL) AS cwd, arg_min(gitBranch, row_id) FILTER (gitBranch IS NOT NULL) AS branch, arg_max(slug, row_id) FILTER (slug IS NOT NULL) AS slug, count(*) AS lines,
  bool_and(coalesce(isSidechain, false)) AS is_sidechain, arg_min({_ROLE}, row_id) FILTER ({_SAID}) AS first_msg_role, arg_max({_ROLE}, row_id) FILTER ({_SAID}) AS last_msg_role, arg_max(message.content, row_id) FILTER ({_SAID}) AS lm,
  arg_min(message.content, row_id) FILTER ({_SAID} AND {_ROLE} = 'user' AND NOT coalesce(isCompactSummary, false)) AS fu, count(*) FILTER ({_SAID} AND {_ROLE} IN ('user', 'assistant')) AS turns FROM basic_session WHERE sessionId IS NOT NULL GROUP BY 1),
f AS (SELECT *, trim(regexp_replace(fu, '\\s+', ' ', 'g')) AS t, trim(regexp_replace(lm, '\\s+', ' ', 'g')) AS l, lower(coalesce(cwd, session_id)) AS p FROM s WHERE turns > 0)
SELECT session_id, 'transcript' AS agent, coalesce(cwd, session_id) AS project, branch, cwd, lines, first_msg_role, CASE WHEN length(t) > 512 THEN left(t, 511) || '…' ELSE t END AS first_user_msg_content, last_msg_role,
  CASE WHEN length(l) > 512 THEN left(l, 511) || '…' ELSE l END AS last_msg_content, CASE WHEN is_sidechain OR regexp_matches(p, '(^|/)subagents(/|$)') THEN 'sub_agent' WHEN contains(p, 'trimmed') THEN 'trimmed' WHEN contains(p, 'continued') THEN 'continued'
       WHEN contains(p, 'rollover') THEN 'rollover' ELSE 'original' END AS derivation_type, is_sidechain, slug FROM f""",
    "history_headers": """
WITH j AS (SELECT CAST(file_id AS VARCHAR) AS path, line_no, TRY_CAST(line AS JSON) AS v FROM rollout_raw),
m AS (SELECT path, line_no, v ->> '$.type' AS type, coalesce(v ->> '$.payload.id', CASE WHEN line_no = 1 THEN v ->> '$.id' END) AS thread_id, v ->> '$.payload.history_base.thread_id' AS base_id,
  CAST(v ->> '$.payload.history_base.end_ordinal_exclusive' AS BIGINT) AS base_end_ordinal, v ->> '$.payload.history_mode' AS mode FROM j WHERE v IS NOT NULL)
SELECT DISTINCT ON (path) path, thread_id, base_id, base_end_ordinal, mode FROM m WHERE thread_id IS NOT NULL AND (type = 'session_meta' OR type IS NULL) ORDER BY path, line_no""",
}
ORACLE |= {
    name: f"""
WITH r AS (SELECT lower(sessionId) AS session_id, coalesce(message.content, '') AS t, coalesce(message.role, type) AS role, coalesce(isCompactSummary, false) AS k FROM basic_session WHERE message IS NOT NULL AND sessionId IS NOT NULL),
p AS (SELECT session_id, ' ' || array_to_string(list_transform(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)), ' ') || ' ' AS c, role,
  NOT (role = 'user' AND (k OR regexp_matches(t, '^\\s*(?:(?:# )?(?:AGENTS|CLAUDE)\\.md instructions(?: for [^\\n]*)?[ \\t\\r]*(?:\\n|$)|<INSTRUCTIONS>)') OR regexp_matches(t, '(?i)^\\s*<(?:codex_internal_context|goal_context)'))
    OR role = 'system' AND regexp_matches(t, '^\\s*(?:(?:# )?(?:AGENTS|CLAUDE)\\.md instructions|<INSTRUCTIONS>)')) AS s FROM r),
q AS (SELECT *, CASE WHEN role = 'user' THEN c ELSE '' END AS u FROM p)
SELECT session_id FROM q GROUP BY session_id HAVING {condition}"""
    for name, (_, condition) in VISIBLE.items()
}

_LABEL = """CASE WHEN n IN ('bash', 'shell', 'shell_command', 'exec_command', 'execute', 'terminal') THEN 'bash' WHEN n IN ('read', 'write', 'edit', 'glob', 'grep', 'agent') THEN n WHEN n IN ('readfile', 'read_file') THEN 'read' WHEN n IN ('writefile', 'write_file') THEN 'write'
  WHEN n IN ('editfile', 'edit_file') THEN 'edit' WHEN n IN ('patch', 'apply_patch') THEN 'patch' WHEN n IN ('websearch', 'web_search') THEN 'search' WHEN n IN ('webfetch', 'web_fetch') THEN 'fetch' ELSE trim(name) END"""
_JOINED = "nullif(array_to_string(list_filter(list_transform({c}, lambda x: x.text), lambda x: x IS NOT NULL), chr(10)), '')"
_CELLS = f"""
WITH o AS ({_LINES.format(t="old_format")}), w AS ({_LINES.format(t="new_format")}), l AS ({_LINES.format(t="latest_format")}),
e AS (
  SELECT 'old' AS src, file_id, line_no, CASE WHEN record_type = 'state' THEN 'state' ELSE coalesce(type, 'session_meta') END AS kind, role, coalesce({_JOINED.format(c="content")}, {_JOINED.format(c="summary")}) AS text, name, arguments, call_id, output, NULL::INT AS exit_code FROM o
  UNION ALL SELECT 'new', file_id, line_no, coalesce(payload.type, type), payload.role, coalesce(payload.message, payload.text, {_JOINED.format(c="payload.content")}, {_JOINED.format(c="payload.summary")}), payload.name, payload.arguments, payload.call_id, payload.output, NULL FROM w
  UNION ALL SELECT 'latest', file_id, line_no, coalesce(payload.type, type), payload.role, coalesce(payload.message, payload.text, {_JOINED.format(c="payload.content")}, {_JOINED.format(c="payload.summary")}), payload.name, coalesce(payload.arguments, payload.input), payload.call_id,
    coalesce(payload.output, payload.aggregated_output), payload.exit_code FROM l
), r AS (SELECT *, replace(lower(trim(name)), '-', '_') AS n, kind IN ('function_call', 'custom_tool_call') AS is_call, kind LIKE '%call_output' AS is_out, kind IN ('exec_command_end', 'patch_apply_end', 'web_search_end') AS is_end FROM e),
p AS (SELECT DISTINCT ON (src, file_id, call_id) src, file_id, call_id, output FROM r WHERE is_out AND call_id IS NOT NULL ORDER BY src, file_id, call_id, line_no),
d AS (SELECT DISTINCT ON (src, file_id, call_id) src, file_id, call_id, output, exit_code FROM r WHERE is_end AND call_id IS NOT NULL ORDER BY src, file_id, call_id, line_no),
c AS (
  SELECT r.src, r.file_id, line_no, CASE {_LABEL} WHEN 'bash' THEN 'exec' WHEN 'patch' THEN 'patch' WHEN 'search' THEN 'web_search' ELSE CASE WHEN name = 'update_plan' THEN 'plan' ELSE 'tool_call' END END AS cell, NULL AS role, {_LABEL} AS tool, r.call_id, NULL AS header, arguments AS text,
    coalesce(d.output, p.output) AS output, d.exit_code, CASE WHEN p.src IS NULL AND d.src IS NULL THEN 'pending' WHEN d.exit_code <> 0 THEN 'failed' ELSE 'done' END AS status
    FROM r LEFT JOIN p ON p.src = r.src AND p.file_id = r.file_id AND p.call_id = r.call_id LEFT JOIN d ON d.src = r.src AND d.file_id = r.file_id AND d.call_id = r.call_id WHERE is_call
  UNION ALL SELECT src, file_id, line_no, 'tool_result', NULL, NULL, call_id, NULL, NULL, output, exit_code, 'done' FROM r WHERE (is_out OR is_end) AND NOT EXISTS (SELECT 1 FROM r x WHERE x.is_call AND x.src = r.src AND x.file_id = r.file_id AND x.call_id = r.call_id)
  UNION ALL SELECT src, file_id, line_no, 'message', coalesce(role, CASE kind WHEN 'user_message' THEN 'user' WHEN 'agent_message' THEN 'assistant' END), NULL, call_id, NULL, text, NULL, NULL, NULL FROM r WHERE kind IN ('message', 'user_message', 'agent_message') AND trim(coalesce(text, '')) <> ''
  UNION ALL SELECT src, file_id, line_no, 'reasoning', NULL, NULL, call_id, nullif(trim(regexp_extract(text, '^\\*\\*([^*\\n]+)\\*\\*\\s*\\n\\n', 1)), ''), regexp_replace(text, '^\\*\\*[^*\\n]+\\*\\*\\s*\\n\\n', ''), NULL, NULL, NULL FROM r WHERE kind IN ('reasoning', 'agent_reasoning') AND trim(coalesce(text, '')) <> ''
  UNION ALL SELECT src, file_id, line_no, CASE kind WHEN 'token_count' THEN 'metrics' ELSE 'session_info' END, NULL, NULL, call_id, NULL, NULL, NULL, NULL, NULL FROM r WHERE kind IN ('session_meta', 'turn_context', 'token_count')
), a AS (SELECT *, row_number() OVER v AS k, lag(cell) OVER v AS c0, lag(role) OVER v AS r0, lag(call_id) OVER v AS i0, lag(text) OVER v AS t0 FROM c WINDOW v AS (PARTITION BY src, file_id ORDER BY line_no)),
b AS (SELECT row_id, lower(sessionId) AS session, coalesce(message.role, type) AS role, unnest(message.content) AS b, unnest(range(1, len(message.content) + 1)) - 1 AS place FROM rich_content WHERE sessionId IS NOT NULL),
q AS (SELECT *, b.name AS name, replace(lower(trim(b.name)), '-', '_') AS n, CASE b.type WHEN 'thinking' THEN 'reasoning' WHEN 'tool_use' THEN 'tool_call' WHEN 'tool_result' THEN 'tool_result' ELSE 'message' END AS cell FROM b WHERE b IS NOT NULL),
f AS (
  SELECT 'rollout' AS agent, CAST(file_id AS VARCHAR) AS session, CAST(line_no AS BIGINT) AS line_no, 0::INT AS place, cell, role, tool, call_id, header, text, output, exit_code, status FROM a
  WHERE k = 1 OR c0 IS DISTINCT FROM cell OR r0 IS DISTINCT FROM role OR i0 IS DISTINCT FROM call_id OR t0 IS DISTINCT FROM text
  UNION ALL SELECT 'transcript', session, row_id, place::INT, cell, CASE WHEN cell = 'message' THEN role END, {_LABEL}, coalesce(b.id, b.tool_use_id), NULL, coalesce(b.text, b.thinking, b.input),
    CASE WHEN cell = 'tool_result' AND b.content IS NOT NULL THEN coalesce(array_to_string(list_filter(list_transform(b.content, lambda x: x.text), lambda x: x IS NOT NULL), chr(10) || chr(10)), '') END, NULL,
    CASE WHEN cell = 'tool_result' THEN CASE WHEN coalesce(b.is_error, false) THEN 'failed' ELSE 'done' END END FROM q
)"""
ORACLE |= {
    "rule_filters": f"""
WITH s AS (SELECT lower(sessionId) AS session_id, arg_min(cwd, row_id) FILTER (cwd IS NOT NULL) AS cwd, count(*) AS lines, bool_and(coalesce(isSidechain, false)) AS side, count(*) FILTER ({_SAID}) AS said,
  count(*) FILTER (type IN ('user', 'assistant') AND {_ROLE} = 'user') AS turns FROM basic_session WHERE sessionId IS NOT NULL GROUP BY 1)
SELECT session_id, lines || ' lines' AS reason FROM s WHERE said > 0 AND lines >= 10 AND turns <= 8 AND NOT side AND NOT regexp_matches(lower(coalesce(cwd, session_id)), '(^|/)subagents(/|$)')""",
    # Few sessions of the tables hold all of a parent's events; forked_sessions and equivalent_copies make such sessions.
    "supersession": """
WITH r AS (SELECT lower(sessionId) AS s, lower(uuid) AS u, lower(forkedFrom.sessionId) AS p, lower(forkedFrom.messageUuid) AS i, timestamp FROM basic_session WHERE sessionId IS NOT NULL AND uuid IS NOT NULL),
k AS (SELECT s, count(DISTINCT u) AS n, count(*) FILTER (i IS NULL) AS own, CAST(floor(epoch(max(timestamp))) AS BIGINT) AS m FROM r GROUP BY s),
e AS (SELECT DISTINCT s AS child, p AS parent FROM r WHERE p IS NOT NULL AND p <> s AND p IN (SELECT s FROM r)),
c AS (SELECT e.* FROM e JOIN k ON k.s = e.child WHERE own > 0 AND NOT EXISTS (SELECT 1 FROM r x WHERE x.s = e.parent AND x.u NOT IN (SELECT i FROM r y WHERE y.s = e.child AND i IS NOT NULL)))
SELECT parent AS key, arg_max(child, (n, m, child)) AS superseded_by FROM c JOIN k ON k.s = c.child GROUP BY 1""",
    "parse_cells": f"{_CELLS} SELECT * FROM f",
    "session_metrics": f"""{_CELLS} SELECT agent, session, count(*) FILTER (cell = 'message' AND role = 'user') AS user_messages, count(*) FILTER (cell = 'message' AND role = 'assistant') AS agent_messages, count(*) FILTER (cell = 'reasoning') AS reasoning,
  count(*) FILTER (cell IN ('tool_call', 'exec', 'patch', 'web_search', 'plan')) AS calls, count(*) FILTER (cell = 'exec') AS commands, count(*) FILTER (status = 'failed') AS failures, count(*) FILTER (status = 'pending') AS pending FROM f GROUP BY 1, 2""",
}
