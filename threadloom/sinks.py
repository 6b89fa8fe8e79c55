"""Outputs: JSON lines, Markdown and plain text, file names, and the search history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import compact
from threadloom.operators.projection import PART

CAP = 512


def full_json(hits: DataFrame) -> DataFrame:
    """One JSON text for each hit, with all its columns."""
    return hits.select(F.to_json(F.struct("*")).alias("value"))


def compact_json(hits: DataFrame) -> DataFrame:
    """One JSON text for each hit, texts collapsed and cut at 512 characters."""
    texts = {f.name for f in hits.schema.fields if f.dataType.simpleString() == "string"}
    return hits.select(F.to_json(F.struct(*[compact(F.col(c), CAP).alias(c) if c in texts else F.col(c) for c in hits.columns])).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def file_stem(created: Column, agent: Column, session_id: Column, title: Column) -> Column:
    """'DATE-agent-id8[-title]': the title in lower case, other characters to '-', at most 48 of it."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(clean, 1, 48), "-+$", "")
    return F.concat_ws("-", F.date_format(created, "yyyy-MM-dd"), agent, F.substring(F.regexp_replace(session_id, r"[^\w-]", ""), 1, 8), F.nullif(cut, F.lit("")))


def file_names(sessions: DataFrame, key: str, suffix: str = ".md") -> DataFrame:
    """(key, file_name): stems with '-1', '-2', … where several sessions share one, in key order.  sessions: key, stem."""
    n = F.row_number().over(Window.partitionBy("stem").orderBy(key)) - 1
    return sessions.select(key, F.concat("stem", F.when(n > 0, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), F.lit(suffix)).alias("file_name"))


def fence(text: Column) -> Column:
    """A code fence longer than any run of back ticks in the text."""
    runs = F.regexp_extract_all(text, F.lit("(`{3,})"), 1)
    longest = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(2))
    return F.repeat(F.lit("`"), longest + 1)


def _joined(turns: DataFrame, key: str, line: Column, between: str, size: int) -> DataFrame:
    """(key, part, n, text): lines of each session joined in the order of ``turn_no``.  A part holds the turns of one stretch of ``size`` numbers, so a
    session of any length is written by many tasks; parts follow each other by number."""
    of = F.floor(F.col("turn_no") / size).cast("bigint")
    parts = turns.select(key, of.alias("part"), F.struct("turn_no", line.alias("t")).alias("s")).groupBy(key, "part")
    return parts.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["t"]), between).alias("text"))


def markdown(turns: DataFrame, key: str = "session_id", size: int = PART) -> DataFrame:
    """(key, part, text): a Markdown document of each session, in parts that follow each other.  turns: key, turn_no, speaker, content,
    timestamp.  What tools were told and said stands in a fence longer than any in it."""
    content = F.coalesce("content", F.lit(""))
    mark = fence(content)
    shown = F.when(F.col("speaker").startswith("tool"), F.concat(mark, F.lit("\n"), content, F.lit("\n"), mark)).otherwise(content)
    block = F.concat(F.lit("## "), F.initcap("speaker"), F.coalesce(F.concat(F.lit(" · "), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")), F.lit("")), F.lit("\n\n"), shown, F.lit("\n"))
    head = F.concat(F.lit("# Session "), F.col(key), F.lit("\n\n- turns: "), F.col("n").cast("string"), F.lit("\n\n"))
    parts = _joined(turns, key, block, "\n", size)
    whole = parts.groupBy(key).agg(F.min("part").alias("first"), F.sum("n").alias("n"))  # one small row for each part
    return parts.drop("n").join(whole, key).select(key, "part", F.concat(F.when(F.col("part") == F.col("first"), head).otherwise(""), F.col("text")).alias("text"))


def plain_text(turns: DataFrame, key: str = "session_id", size: int = PART) -> DataFrame:
    """(key, part, text): '[role time] text' lines of each session."""
    line = F.concat(F.lit("["), F.col("speaker"), F.coalesce(F.concat(F.lit(" "), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit("")), F.lit("] "), F.coalesce("content", F.lit("")))
    return _joined(turns, key, line, "\n", size).select(key, "part", "text")


def history_updated(history: DataFrame, fresh: DataFrame, limit: int) -> DataFrame:
    """Search history with new entries: the latest of each query, newest first (then by query), at most ``limit``."""
    every = history.select("query", "saved_at").unionByName(fresh.select("query", "saved_at"))
    return every.groupBy("query").agg(F.max("saved_at").alias("saved_at")).orderBy(F.desc("saved_at"), "query").limit(limit)


def fuzzy_recall(history: DataFrame, typed: str, limit: int = 20) -> DataFrame:
    """Entries that hold the typed characters in order, best first: the shortest stretch that holds them, then newest, then by query.

    Letter case counts only if a capital was typed.
    """
    smart = any(c.isupper() for c in typed)
    text = F.col("query") if smart else F.lower("query")
    wanted = [c for c in (typed if smart else typed.lower()) if not c.isspace()]
    quoted = [c if c.isalnum() else "\\" + c for c in wanted]
    span = F.length(F.regexp_extract(text, ".*?".join(quoted) or "$", 0))
    hits = history.where(text.rlike(".*?".join(quoted) or "")).select("query", "saved_at", span.alias("span"))
    return hits.orderBy("span", F.desc("saved_at"), "query").limit(limit)
