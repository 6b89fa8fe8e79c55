"""Lines of all producers to cells of one schema: messages, reasoning, tool calls with their results, commands, plans, session facts, metrics.

``parse`` picks the reader by producer.  Rollout lines of the three formats become one event table first; calls then take their first output
and the event that ended them by equi-joins on (file, call), so an output that repeats what an end event told makes no cell of its own.
Neighbours that say the same are told once, by chunked scans, so a long file is no single task.

Defined results: state records and records of unknown kinds make no cells; a repeated line counts once; an output or end event without a call is
a cell of its own; a call that nothing answers is pending; blank messages make no cells; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import reasoning_header, tool_label
from threadloom.operators import sessions

COLUMNS = ("agent", "session", "line_no", "place", "cell", "role", "tool", "call_id", "header", "text", "output", "exit_code", "status")
_CALLS = ("function_call", "custom_tool_call")
_OUTPUTS = ("function_call_output", "custom_tool_call_output")
_ENDS = ("exec_command_end", "patch_apply_end", "web_search_end")


def _get(rows: DataFrame, name: str, kind: str = "string") -> Column:
    """A field of the payload, or of the bare record, or null where the format has none."""
    if "payload" in rows.columns:
        return F.col(f"payload.{name}") if name in rows.schema["payload"].dataType.fieldNames() else F.lit(None).cast(kind)
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def events(rows: DataFrame) -> DataFrame:
    """(file_id, line_no, kind, role, text, name, arguments, call_id, output, exit_code) of rollout lines of one format."""
    texts = "array<struct<type:string,text:string>>"
    joined = lambda c: F.nullif(F.array_join(F.transform(c, lambda x: x["text"]), "\n"), F.lit(""))
    # A bare record (of the old format) is a state, of a kind, or a session's head.
    kind = F.coalesce("payload.type", "type") if "payload" in rows.columns else F.when(F.col("record_type") == "state", "state").otherwise(F.coalesce("type", F.lit("session_meta")))
    role = F.coalesce(_get(rows, "role"), F.when(kind == "user_message", "user").when(kind == "agent_message", "assistant"))
    content = _get(rows, "content", texts)
    text = F.coalesce(_get(rows, "message"), _get(rows, "text"), joined(content), joined(_get(rows, "summary", texts)))
    columns = [
        "file_id", "line_no", "row_id", "ingested_at", kind.alias("kind"), role.alias("role"), text.alias("text"), _get(rows, "name").alias("name"), F.coalesce(_get(rows, "arguments"), _get(rows, "input")).alias("arguments"),
        _get(rows, "call_id").alias("call_id"), F.coalesce(_get(rows, "output"), _get(rows, "aggregated_output")).alias("output"), _get(rows, "exit_code", "int").alias("exit_code"),
    ]
    return sessions.rollout_lines(rows.select(*columns)).drop("row_id", "ingested_at")


def rollout_cells(rows: DataFrame) -> DataFrame:
    """Cells of rollout lines of one format."""
    e = events(rows)
    kind = F.col("kind")
    first = lambda which, name, *fields: e.where(kind.isin(*which) & F.col("call_id").isNotNull()).groupBy("file_id", "call_id").agg(F.min_by(F.struct(F.col("line_no").alias("at"), *fields), "line_no").alias(name))
    outputs, ends = first(_OUTPUTS, "o", "output"), first(_ENDS, "d", "output", "exit_code")
    calls = e.where(kind.isin(*_CALLS)).join(outputs, ["file_id", "call_id"], "left").join(ends, ["file_id", "call_id"], "left")
    label = tool_label(F.col("name"))
    cell = F.when(label == "bash", "exec").when(label == "patch", "patch").when(label == "search", "web_search").when(F.col("name") == "update_plan", "plan").otherwise("tool_call")
    out = lambda df, cell, role, tool, header, text, output, code, status: df.select(
        F.col("file_id").cast("string").alias("session"), "line_no", F.lit(0).alias("place"), cell.alias("cell"), role.alias("role"), tool.alias("tool"), "call_id", header.alias("header"), text.alias("text"), output.alias("output"), code.alias("exit_code"), status.alias("status")
    )
    none, no_code = F.lit(None).cast("string"), F.lit(None).cast("int")
    answered = F.when(F.col("o").isNull() & F.col("d").isNull(), "pending").when(F.col("d.exit_code") != 0, "failed").otherwise("done")
    made = out(calls, cell, none, label, none, F.col("arguments"), F.coalesce("d.output", "o.output"), F.col("d.exit_code"), answered)
    known = e.where(kind.isin(*_CALLS) & F.col("call_id").isNotNull()).select("file_id", "call_id").distinct()
    alone = e.where(kind.isin(*_OUTPUTS, *_ENDS)).join(known, ["file_id", "call_id"], "left_anti")
    made = made.unionByName(out(alone, F.lit("tool_result"), none, none, none, none, F.col("output"), F.col("exit_code"), F.lit("done")))
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    said = e.where(kind.isin("message", "user_message", "agent_message") & ~blank)
    made = made.unionByName(out(said, F.lit("message"), F.col("role"), none, none, F.col("text"), none, no_code, none))
    thought = e.where(kind.isin("reasoning", "agent_reasoning") & ~blank).withColumn("h", reasoning_header(F.col("text")))
    made = made.unionByName(out(thought, F.lit("reasoning"), none, none, F.col("h.header"), F.col("h.body"), none, no_code, none))
    facts = e.where(kind.isin("session_meta", "turn_context", "token_count"))
    made = made.unionByName(out(facts, F.when(kind == "token_count", "metrics").otherwise("session_info"), none, none, none, none, none, no_code, none))
    return sessions.adjacent_distinct(made, "session", ["line_no", "place"], ["cell", "role", "call_id", "text"])


def transcript_cells(rows: DataFrame) -> DataFrame:
    """Cells of nested transcript lines, one for each block."""
    blocks = rows.where("sessionId IS NOT NULL").select("row_id", F.lower("sessionId").alias("session"), F.coalesce("message.role", "type").alias("role"), F.posexplode("message.content").alias("place", "b")).where("b IS NOT NULL")
    kind = F.coalesce("b.type", F.lit("text"))
    cell = F.when(kind == "thinking", "reasoning").when(kind == "tool_use", "tool_call").when(kind == "tool_result", "tool_result").otherwise("message")
    result = F.array_join(F.filter(F.transform("b.content", lambda c: c["text"]), lambda x: x.isNotNull()), "\n\n")
    return blocks.select(
        "session", F.col("row_id").alias("line_no"), "place", cell.alias("cell"), F.when(cell == "message", F.col("role")).alias("role"), tool_label(F.col("b.name")).alias("tool"), F.coalesce("b.id", "b.tool_use_id").alias("call_id"),
        F.lit(None).cast("string").alias("header"), F.coalesce("b.text", "b.thinking", "b.input").alias("text"), F.when(cell == "tool_result", result).alias("output"), F.lit(None).cast("int").alias("exit_code"),
        F.when(cell == "tool_result", F.when(F.coalesce("b.is_error", F.lit(False)), "failed").otherwise("done")).alias("status"),
    )


def parse(tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """Cells (``COLUMNS``) of tables of (producer, lines): ``transcript`` or ``rollout``, the latter in any of its formats."""
    readers = {"transcript": transcript_cells, "rollout": rollout_cells}
    out = None
    for agent, rows in tables:
        if agent not in readers:
            raise ValueError(f"no reader for {agent}")
        part = readers[agent](rows).withColumn("agent", F.lit(agent)).withColumn("line_no", F.col("line_no").cast("bigint")).withColumn("place", F.col("place").cast("int")).select(*COLUMNS)
        out = part if out is None else out.unionByName(part)
    return out


def metrics(cells: DataFrame) -> DataFrame:
    """Counts by session: what was said and thought, calls, commands and failures."""
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    c = F.col("cell")
    return cells.groupBy("agent", "session").agg(
        n((c == "message") & (F.col("role") == "user"), "user_messages"), n((c == "message") & (F.col("role") == "assistant"), "agent_messages"), n(c == "reasoning", "reasoning"), n(c.isin("tool_call", "exec", "patch", "web_search", "plan"), "calls"),
        n(c == "exec", "commands"), n(F.col("status") == "failed", "failures"), n(F.col("status") == "pending", "pending"),
    )
