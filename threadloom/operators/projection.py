"""What a part of a transcript is and who sees it: visibility masks, segments for search, and exports' default fields."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Row ids or turn numbers in a part of a long session's text.
PART = 10_000

# The visibility bits.
USER, AGENT, TOOL_CALL, TOOL_RESULT, PROJECT_DOCS, SKILL, INTERNAL_CONTEXT, USER_TOOL_CALL, USER_TOOL_RESULT, AGENT_THINKING = (1 << k for k in range(10))


@dataclass(frozen=True)
class Display:
    """Which kinds of parts are hidden."""

    hide_user: bool = False
    hide_agent: bool = False
    hide_tool_calls: bool = False
    hide_tool_results: bool = False
    hide_project_docs: bool = True
    hide_skills: bool = False
    hide_internal_context: bool = True
    hide_user_tool_calls: bool = False
    hide_user_tool_results: bool = False
    hide_agent_thinking: bool = True

    def hidden(self) -> int:
        return sum(1 << k for k, f in enumerate(fields(self)) if getattr(self, f.name))


SHOW_ALL = Display(*[False] * 10)


def visible(mask: Column, display: Display) -> Column:
    """A part is seen if none of the bits it needs is hidden."""
    return mask.bitwiseAND(F.lit(display.hidden())) == 0


# What opens generated blocks within a user's messages.
_DOCS = r"(?s)^\s*(?:(?:# )?(?:AGENTS|CLAUDE)\.md instructions(?: for [^\n]*)?[^\S\n]*(?:\n|$)|<INSTRUCTIONS>.*</INSTRUCTIONS>)"
_SKILL = r"(?is)^\s*<skill>.*</skill>"
_INTERNAL = r"(?is)^(?:\s*<(codex_internal_context|goal_context)(?:>|\s[^>]*>).*?</\1>)+\s*$"
# Generated kinds of the third producer, by the bit they need.
_KINDS = {
    "directory_rules": PROJECT_DOCS, "checkpoint": AGENT, "agent_message": AGENT, "error": TOOL_RESULT, "task_canceled": TOOL_RESULT, "task_finished": TOOL_RESULT, "task_stalled": TOOL_RESULT,
    "subagent_error": TOOL_RESULT, "task_reminder": INTERNAL_CONTEXT, "restart_notice": INTERNAL_CONTEXT, "hook_feedback": INTERNAL_CONTEXT,
}


def is_project_docs(text: Column) -> Column:
    return text.rlike(_DOCS)


def is_skill(text: Column) -> Column:
    return text.rlike(_SKILL)


def is_internal(text: Column) -> Column:
    """A message that is made of generated context blocks only."""
    return text.rlike(_INTERNAL)


def is_task_notification(text: Column) -> Column:
    return text.rlike(r"(?s)^\s*<task-notification>.*</task-notification>\s*$")


def message_mask(role: Column, text: Column, compact_summary: Column, kind: Column | None = None, notification: Column | None = None) -> Column:
    """Bits a message needs.  A user's: a compact summary counts as context beside the user, a notification as a tool result, documents, skills and
    context blocks as such beside the user.  ``kind``: the generated kind of system messages of the third producer.  Other system messages
    and summaries need no bit; documents that the system gives need theirs alone."""
    t, user = F.coalesce(text, F.lit("")), F.coalesce(role == "user", F.lit(False))
    told = notification if notification is not None else is_task_notification(t)
    out = F.when(user & F.coalesce(compact_summary, F.lit(False)), USER | INTERNAL_CONTEXT).when(user & told, TOOL_RESULT)
    if kind is not None:
        for name, bit in _KINDS.items():
            out = out.when(role.isin("system", "summary") & (kind == name), bit)
    return (
        out.when(user & is_project_docs(t), USER | PROJECT_DOCS).when((role == "system") & is_project_docs(t), PROJECT_DOCS).when(user & is_skill(t), USER | SKILL)
        .when(user & is_internal(t), USER | INTERNAL_CONTEXT).when(user, USER).when(role.isin("assistant", "agent"), AGENT)
        .when(role == "tool_call", TOOL_CALL).when(role == "tool_result", TOOL_RESULT).when(role == "thinking", AGENT_THINKING).otherwise(0)
    )


def block_mask(kind: Column, role: Column) -> Column:
    return (
        F.when(kind == "thinking", AGENT_THINKING).when(kind == "tool_use", TOOL_CALL).when(kind == "tool_result", TOOL_RESULT)
        .when(role == "user", USER).otherwise(AGENT)
    )


def masks() -> list[int]:
    """The masks that segments can have; each is a search field of its own."""
    return [
        0, USER, AGENT, AGENT_THINKING, TOOL_CALL, TOOL_RESULT, TOOL_CALL | TOOL_RESULT, PROJECT_DOCS, INTERNAL_CONTEXT, AGENT | INTERNAL_CONTEXT, USER | PROJECT_DOCS, USER | SKILL,
        USER | INTERNAL_CONTEXT, USER_TOOL_CALL, USER_TOOL_CALL | USER_TOOL_RESULT,
    ]


def default_masks(mode: str, display: Display) -> list[int]:
    """Masks searched without a field prefix: all, those visible, or exactly the others."""
    hidden = display.hidden()
    return [m for m in masks() if mode == "all" or ((m & hidden) == 0) == (mode == "visible")]


def segments(rows: DataFrame) -> DataFrame:
    """(row_id, session, part, kind, mask, text) of the blocks of nested lines; blank parts are left out."""
    role = F.coalesce("message.role", "type")
    blocks = rows.select("row_id", F.lower("sessionId").alias("session"), role.alias("role"), F.posexplode("message.content").alias("part", "b")).where("b IS NOT NULL")
    kind = F.coalesce("b.type", F.lit("text"))
    result = F.array_join(F.filter(F.transform("b.content", lambda c: c["text"]), lambda x: x.isNotNull()), "\n\n")
    named = lambda name, text: F.struct(F.lit(name).alias("name"), text.alias("text"))
    parts = F.array(named("text", F.coalesce("b.text", "b.thinking")), named("name", F.col("b.name")), named("input", F.col("b.input")), named("output", result))
    out = blocks.select("row_id", "session", "part", kind.alias("kind"), block_mask(kind, F.col("role")).alias("mask"), F.inline(parts))
    return out.where("text IS NOT NULL AND trim(text) <> ''")


def search_fields(rows: DataFrame, size: int = PART) -> DataFrame:
    """(session, mask, part, text): the text of each session by mask, joined in delivery order with blank lines.  A part holds the session's
    rows of one stretch of ``size`` row ids, so a session of any length is built by many tasks; parts follow each other by number."""
    s = segments(rows).where("session IS NOT NULL")
    grouped = s.groupBy("session", "mask", F.floor(F.col("row_id") / size).cast("bigint").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("row_id", "part", "name", "text"))).alias("t"))
    return grouped.select("session", "mask", F.col("chunk").alias("part"), F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))


def preview(first_user: Column, first: Column, last: Column) -> Column:
    """The text by which a session is listed."""
    blank = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return F.coalesce(blank(first_user), blank(first), blank(last))


def citation_footer(text: Column) -> Column:
    """struct(body, footer): a complete citation block at the end, unless a code fence is left open before it."""
    pattern = r"(?s)\s*(<oai-mem-citation>.*</oai-mem-citation>)\s*$"
    body = F.regexp_replace(text, pattern, "")
    has = text.rlike(pattern) & (F.regexp_count(body, F.lit("(?m)^\\s*```")) % 2 == 0)
    return F.struct(F.when(has, body).otherwise(text).alias("body"), F.when(has, F.regexp_extract(text, pattern, 1)).alias("footer"))
