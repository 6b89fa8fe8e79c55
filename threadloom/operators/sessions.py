"""Transcript rows to typed sessions, messages and cells: the ordered per-session folds as aggregates, joins and windows.

First and last values are ``min_by`` / ``max_by`` over the line number (with a unique tiebreak), so whole sessions are folded with partial
aggregation; operators that need a neighbour (adjacent repeats, turns, offsets) use the chunked scans of :mod:`threadloom.operators.scans`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import derivation
from threadloom.operators import scans


def first_value(value: Column, order: Column) -> Column:
    """First value that is not null, in ``order``."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def last_value(value: Column, order: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), order))


# --- first producer: message lines -----------------------------------------------------------------------------------


def is_exit_command(text: Column) -> Column:
    return text.rlike(r"^\s*<command-name>/exit</command-name>")


def without_noise(rows: DataFrame, text: str = "text", order: str = "row_id") -> DataFrame:
    """Drops caveat wrappers, exit commands, and the output of an exit command that came earlier (by parentUuid = its uuid)."""
    t = F.coalesce(F.col(text), F.lit(""))
    exits = rows.where(is_exit_command(t) & F.col("uuid").isNotNull()).groupBy(F.col("uuid").alias("__exit")).agg(F.min(order).alias("__at"))
    kept = rows.where(~t.rlike(r"^\s*<local-command-caveat>") & ~is_exit_command(t))
    output = t.rlike(r"^\s*<local-command-stdout>")
    rest = kept.where(~output)
    answers = kept.where(output)
    after = answers.join(exits, (F.col("parentUuid") == F.col("__exit")) & (F.col("__at") < F.col(order)), "left_anti")
    return rest.unionByName(after)


def transcript_sessions(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """One row of each session of transcript lines: identity, span, first and last turns, counts."""
    o = F.col(order)
    role = F.coalesce("message.role", "type")
    said = F.col("type").isin("user", "assistant") & ~F.coalesce("isMeta", F.lit(False)) & (F.trim(F.coalesce("message.content", F.lit(""))) != "")
    content = F.when(said, F.col("message.content"))
    user_text = F.when(said & (role == "user") & ~F.coalesce("isCompactSummary", F.lit(False)), F.col("message.content"))
    out = rows.where("sessionId IS NOT NULL").groupBy(F.lower("sessionId").alias("session_id")).agg(
        first_value(F.col("cwd"), o).alias("cwd"), first_value(F.col("gitBranch"), o).alias("branch"), first_value(F.col("message.model"), o).alias("model"),
        last_value(F.col("slug"), o).alias("slug"), F.min("timestamp").alias("created"), F.max("timestamp").alias("modified"), F.count(F.lit(1)).alias("lines"),
        first_value(F.when(said, role), o).alias("first_msg_role"), first_value(content, o).alias("first_msg_content"),
        last_value(F.when(said, role), o).alias("last_msg_role"), last_value(content, o).alias("last_msg_content"), first_value(user_text, o).alias("first_user_msg_content"),
        F.count_if(said & (role == "user")).alias("user_turns"), F.count_if(said & (role == "assistant")).alias("agent_turns"), F.bool_and(F.coalesce("isSidechain", F.lit(False))).alias("is_sidechain"),
        F.array_sort(F.collect_set(F.lower("forkedFrom.sessionId"))).alias("fork_parents"),
    )
    named = out.withColumn("agent", F.lit("transcript")).withColumn("project", F.coalesce("cwd", "session_id"))
    return (
        named.withColumn("modified_ts", F.greatest(F.coalesce(F.unix_timestamp("modified"), F.lit(0)), F.lit(0)))
        .withColumn("derivation_type", derivation(F.coalesce("project", F.lit("")), F.col("is_sidechain")))
        .where("user_turns + agent_turns > 0")
    )


def summaries(rows: DataFrame, text: str = "summary") -> DataFrame:
    """(session_id, summary): the last native summary of each session, from summary lines and away summaries of the system."""
    native = (F.col("type") == "summary") | ((F.col("type") == "system") & (F.col("subtype") == "away_summary"))
    kept = rows.where(native & F.col("sessionId").isNotNull() & (F.trim(F.coalesce(F.col(text), F.lit(""))) != ""))
    return kept.groupBy(F.lower("sessionId").alias("session_id")).agg(F.max_by(text, "row_id").alias("summary"))


def block_text(rows: DataFrame) -> DataFrame:
    """(row_id, part, kind, text): content blocks in order, adjacent text blocks merged with a blank line (gaps and islands by row)."""
    blocks = rows.select("row_id", F.posexplode("message.content").alias("place", "b")).where("b IS NOT NULL")
    kind = F.coalesce("b.type", F.lit("unknown"))
    text = F.coalesce("b.text", "b.thinking", F.array_join(F.transform("b.content", lambda c: c["text"]), "\n\n"), "b.input")
    w = Window.partitionBy("row_id").orderBy("place")
    marked = blocks.select("row_id", "place", kind.alias("kind"), text.alias("text"))
    island = F.sum(F.when((F.col("kind") == "text") & (F.lag("kind").over(w) == "text"), 0).otherwise(1)).over(w)
    grouped = marked.withColumn("part", island).groupBy("row_id", "part").agg(F.first("kind").alias("kind"), F.sort_array(F.collect_list(F.struct("place", "text"))).alias("t"))
    return grouped.select("row_id", F.col("part").cast("bigint").alias("part"), "kind", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))


def adjacent_distinct(rows: DataFrame, by: str, order: list[str], same: list[str]) -> DataFrame:
    """Drops a row that equals the row before it (null-safe, on ``same``); an equal run collapses to its first row."""
    marked = scans.running_last(rows, by, order, F.struct(*same), "__before", strict=True)
    return marked.where(~F.col("__before").eqNullSafe(F.struct(*same))).drop("__before")


def carried_calls(rows: DataFrame, by: str, order: list[str], kind: Column, summary: Column) -> DataFrame:
    """``call_summary`` of each tool result: that of the call before it; rows of other kinds reset it."""
    event = F.when(kind == "tool_call", F.struct(summary.alias("name"))).when(kind != "tool_result", F.struct(F.lit(None).cast("string").alias("name")))
    named = F.when((kind == "tool_call") & summary.isNull(), F.lit(None)).otherwise(event)
    marked = scans.running_last(rows, by, order, named, "__call")
    return marked.withColumn("call_summary", F.when(kind == "tool_result", F.col("__call.name"))).drop("__call")


def user_turns(rows: DataFrame, by: str, order: list[str], opens: Column) -> DataFrame:
    """``turn``: number of the user message that opened the row's turn (0 before the first)."""
    return scans.running_sum(rows, by, order, F.when(opens, 1).otherwise(0), "turn")


def trailing_aborted(turned: DataFrame, by: list[str], aborted: Column) -> DataFrame:
    """Of each session whose last turn was aborted, that turn."""
    ends = turned.groupBy(*by, "turn").agg(F.bool_or(aborted).alias("aborted"), F.count(F.lit(1)).alias("rows"))
    last = ends.groupBy(*by).agg(F.max_by(F.struct("turn", "aborted", "rows"), "turn").alias("t"))
    return last.where("t.aborted AND t.turn > 0").select(*by, "t.turn", "t.rows")


def running_offsets(lines: DataFrame, by: str = "file_id", order: str = "line_no", text: str = "line") -> DataFrame:
    """``byte_start`` and ``byte_end`` of each line in its file, the line break counted."""
    size = F.octet_length(text) + 1
    return scans.running_sum(lines, by, [order], size, "byte_end").withColumn("byte_start", F.col("byte_end") - size)


def ordinal_regressions(rows: DataFrame, by: str = "file_id", order: str = "line_no", ordinal: str = "ordinal") -> DataFrame:
    """Rows whose ordinal is not above all before it in the file."""
    return scans.running_max(rows, by, [order], ordinal, "highest").where(F.col(ordinal) <= F.col("highest"))


# --- second producer: rollout records --------------------------------------------------------------------------------


def rollout_lines(rows: DataFrame, payload: tuple[str, ...] | None = None) -> DataFrame:
    """Each (file_id, line_no) once: the row delivered first.  ``payload``: the fields of it that are wanted; others are not read."""
    if payload is not None:
        rows = rows.withColumn("payload", F.struct(*[F.col(f"payload.{p}").alias(p) for p in payload]))
    columns = rows.columns
    return rows.groupBy("file_id", "line_no").agg(F.min_by(F.struct(*columns), F.struct("ingested_at", "row_id")).alias("r")).select("r.*")


def rollout_sessions(rows: DataFrame) -> DataFrame:
    """One row of each file: the first meta wins, the last turn context wins, runtime metrics, span."""
    o = F.struct("line_no", "row_id")
    meta, turn = F.col("type") == "session_meta", F.col("type") == "turn_context"
    kind, ts = F.coalesce("payload.type", "type"), F.col("timestamp").try_cast("timestamp")
    wall = F.unix_millis(F.max(ts)) - F.unix_millis(F.min(ts))
    return rows.groupBy("file_id").agg(
        first_value(F.when(meta, F.col("payload.id")), o).alias("session_id"), first_value(F.when(meta, F.col("payload.cwd")), o).alias("cwd"),
        first_value(F.when(meta, F.col("payload.originator")), o).alias("originator"), last_value(F.when(turn, F.col("payload.model")), o).alias("model"),
        last_value(F.when(turn, F.col("payload.effort")), o).alias("effort"), F.min(ts).alias("created"), F.max(ts).alias("modified"), F.count(F.lit(1)).alias("lines"),
        F.count_if(kind == "user_message").alias("user_messages"), F.count_if(kind == "agent_message").alias("agent_messages"), F.count_if(kind.isin("function_call", "custom_tool_call")).alias("tool_calls"),
        F.count_if(kind.isin("function_call_output", "custom_tool_call_output")).alias("tool_outputs"), F.count_if(kind == "exec_command_end").alias("exec_ends"),
        last_value(F.col("payload.info.total_token_usage.total_tokens"), o).alias("total_tokens"), F.when(wall > 0, wall).alias("wall_ms"),
    )


def paired_calls(rows: DataFrame) -> DataFrame:
    """(file_id, call_id, call_line, name, arguments, output_line, output, status): calls with their first output, by left outer join.

    A call without an output is pending; the key holds the file, so a call id that a third of the rows share is spread over files.
    """
    kind = F.col("payload.type")
    calls = rows.where(kind.isin("function_call", "custom_tool_call") & F.col("payload.call_id").isNotNull()).groupBy("file_id", F.col("payload.call_id").alias("call_id"))
    calls = calls.agg(F.min_by(F.struct(F.col("line_no").alias("call_line"), F.col("payload.name").alias("name"), F.col("payload.arguments").alias("arguments")), F.struct("line_no", "row_id")).alias("c"))
    outputs = rows.where(kind.isin("function_call_output", "custom_tool_call_output") & F.col("payload.call_id").isNotNull()).groupBy("file_id", F.col("payload.call_id").alias("call_id"))
    outputs = outputs.agg(F.min_by(F.struct(F.col("line_no").alias("output_line"), F.col("payload.output").alias("output")), F.struct("line_no", "row_id")).alias("o"))
    joined = calls.join(outputs, ["file_id", "call_id"], "left")
    return joined.select("file_id", "call_id", "c.*", "o.output_line", "o.output", F.when(F.col("o").isNull(), "pending").otherwise("done").alias("status"))


def redundant_outputs(rows: DataFrame) -> DataFrame:
    """Outputs of calls for which an end event came earlier in the file."""
    kind, call = F.col("payload.type"), F.col("payload.call_id")
    ends = rows.where(kind.isin("exec_command_end", "patch_apply_end", "web_search_end")).groupBy(F.col("file_id").alias("f"), call.alias("c")).agg(F.min("line_no").alias("ended"))
    outputs = rows.where(kind.isin("function_call_output", "custom_tool_call_output"))
    return outputs.join(ends, (F.col("file_id") == F.col("f")) & (call == F.col("c")) & (F.col("line_no") > F.col("ended")), "left_semi")


def plan_items(arguments: Column) -> Column:
    """array<struct<step, status>> of a plan's JSON; null if any entry is malformed or there is none."""
    kind = "struct<plan:array<struct<step:string,status:string>>>"
    items = F.from_json(arguments, kind)["plan"]
    return F.when((F.size(items) > 0) & F.forall(items, lambda x: x["step"].isNotNull() & x["status"].isin("pending", "in_progress", "completed")), items)


def patch_files(patch: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, op, path, added, removed, body) of each file section of patches in the marked text form; body: the text of an added file."""
    lines = patch.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("at", "line"))
    mark = r"^\*\*\* (Add|Update|Delete) File: (.*?)\s*$"
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("n", F.sum(F.when(F.col("line").rlike(mark), 1).otherwise(0)).over(w).cast("bigint")).where("n > 0")
    head = F.col("line").rlike(mark)
    return marked.groupBy(key, "n").agg(
        F.max(F.when(head, F.lower(F.regexp_extract("line", mark, 1)))).alias("op"), F.max(F.when(head, F.regexp_extract("line", mark, 2))).alias("path"),
        F.count_if(~head & F.col("line").startswith("+")).alias("added"), F.count_if(~head & F.col("line").startswith("-")).alias("removed"),
        F.sort_array(F.collect_list(F.when(~head & F.col("line").startswith("+"), F.struct("at", F.substring("line", 2, 1 << 30).alias("line"))))).alias("body"),
    ).withColumn("body", F.when(F.col("op") == "add", F.array_join(F.transform("body", lambda x: x["line"]), "\n")))


def two_source_merge(full: DataFrame, regular: DataFrame, key: str = "step_index") -> DataFrame:
    """Full records, and regular records whose step is not among them."""
    return full.unionByName(regular.where(F.col(key).isNotNull()).join(full.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(full.columns))
