"""Text functions as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_TOKEN_BYTES = 40
#: Stands for a token that is too long to be indexed, so that the positions of the others stay.
GAP = "\u0001"


def tokens(text: Column) -> Column:
    """The analyzer: runs of letters and digits, in lower case, without tokens of 40 bytes or more; null gives an empty array."""
    return F.filter(words(text), lambda t: F.octet_length(t) < LONG_TOKEN_BYTES)


def words(text: Column) -> Column:
    return F.transform(F.coalesce(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), 0), F.array().cast("array<string>")), F.lower)


def raw_form(text: Column) -> Column:
    """' t1 t2 … ' of all words of the text in lower case: one replacement, no arrays.  ' ' for a text without words."""
    return F.lower(F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), r"[^\p{L}\p{N}]++", " "))


def with_gaps(raw: Column, text: Column) -> Column:
    """The raw form with long words replaced by a gap; only texts that may hold one go through the array form."""
    extra = F.octet_length(raw) - F.length(raw)  # bytes beyond one for each character
    may_be_long = raw.rlike(" [^ ]{40}") | F.when(extra == 0, False).when(extra < 20, raw.rlike(" [^ ]{20}")).otherwise(raw.rlike(" [^ ]{10}"))
    kept = F.transform(words(text), lambda t: F.when(F.octet_length(t) < LONG_TOKEN_BYTES, t).otherwise(F.lit(GAP)))
    return F.when(may_be_long, F.concat(F.lit(" "), F.array_join(kept, " "), F.lit(" "))).otherwise(raw)


def normal_form(text: Column) -> Column:
    """' t1 t2 … ' of the analyzed text, so that terms and phrases are plain substring searches; long tokens leave a gap."""
    return with_gaps(raw_form(text), text)


def token_count(norm: Column) -> Column:
    """Number of indexed tokens of a normal form."""
    spaces = F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit("")))
    gaps = F.length(norm) - F.length(F.replace(norm, F.lit(GAP), F.lit("")))
    return (spaces - 1 - gaps).cast("bigint")


def compact(text: Column, limit: int) -> Column:
    """White space collapsed, at most ``limit`` characters with a closing ellipsis where cut."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def path_suffixes(path: Column) -> Column:
    """Every suffix of a path at a component boundary; back slashes count as slashes, trailing slashes are dropped."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+$", ""), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return F.filter(suffixes, lambda s: s != "")


def normal_path(path: Column) -> Column:
    """Path by components: repeated, trailing and '.' components dropped, '..' kept, without letter case."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    kept = F.filter(parts, lambda p: (p != "") & (p != "."))
    return F.lower(F.concat(F.when(F.regexp_replace(path, r"\\", "/").startswith("/"), "/").otherwise(""), F.array_join(kept, "/")))


# The wrapper tags of command messages.
WRAPPER_TAGS = (
    "command-name", "command-message", "command-args", "local-command-stdout", "local-command-stderr", "local-command-caveat",
    "bash-input", "bash-stdout", "bash-stderr",
)


def strip_wrappers(text: Column) -> Column:
    """Text that consists of known tags only loses the tags and collapses its white space; other text stays."""
    tag = "|".join(WRAPPER_TAGS)
    only = text.rlike(rf"(?s)^\s*(?:<({tag})>.*?</\1>\s*)+$")
    return F.when(only, F.trim(F.regexp_replace(F.regexp_replace(text, rf"</?(?:{tag})>", " "), r"\s+", " "))).otherwise(text)


def reasoning_header(text: Column) -> Column:
    """struct(header, body) of '**Header**' and the text after a blank line; header is null without one."""
    has = text.rlike(r"(?s)^\*\*[^*\n]+\*\*\s*\n\n")
    header = F.when(has, F.trim(F.regexp_extract(text, r"^\*\*([^*\n]+)\*\*", 1)))
    return F.struct(header.alias("header"), F.when(has, F.regexp_replace(text, r"(?s)^\*\*[^*\n]+\*\*\s*\n\n", "")).otherwise(text).alias("body"))


def exec_output(text: Column) -> Column:
    """struct(exit_code, wall_seconds, output) of the text form of a finished command."""
    code = F.coalesce(F.nullif(F.regexp_extract(text, r"(?m)^Exit code: (-?\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"Process exited with code (-?\d+)", 1), F.lit("")))
    wall = F.nullif(F.regexp_extract(text, r"(?m)^Wall time: ([0-9.]+)", 1), F.lit(""))
    body = F.when(text.rlike(r"(?m)^Output:"), F.regexp_replace(text, r"(?s)^.*?(?m:^Output:)[ ]?\n?", "")).otherwise(text)
    return F.struct(code.try_cast("int").alias("exit_code"), wall.try_cast("double").alias("wall_seconds"), body.alias("output"))


def shell_command(text: Column) -> Column:
    """struct(command, exit_code, duration_ms, stdout) of a user's shell command envelope; null for other text."""
    inner = lambda tag: F.nullif(F.regexp_extract(text, rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1), F.lit(""))
    result = inner("result")
    duration = F.regexp_extract(result, r"Duration: ([0-9.]+) seconds", 1).try_cast("double")
    return F.when(
        text.rlike(r"(?s)^\s*<user_shell_command>.*</user_shell_command>\s*$"),
        F.struct(
            inner("command").alias("command"), F.regexp_extract(result, r"Exit code: (-?\d+)", 1).try_cast("int").alias("exit_code"),
            F.round(duration * 1000).cast("bigint").alias("duration_ms"), F.nullif(F.regexp_extract(result, r"(?s)Output:\s*(.*)$", 1), F.lit("")).alias("stdout"),
        ),
    )


def model_from_settings(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, r"(?s)\bto\s+(.*?)\. ", 1)), F.lit(""))


# Labels under which tools are listed, by their names in lower case with hyphens as underscores.
TOOL_LABELS = {
    "bash": "bash", "exec_command": "bash", "shell": "bash", "shell_command": "bash", "execute": "bash", "terminal": "bash", "read": "read", "readfile": "read", "read_file": "read",
    "write": "write", "writefile": "write", "write_file": "write", "edit": "edit", "editfile": "edit", "edit_file": "edit", "glob": "glob", "grep": "grep", "apply_patch": "patch", "patch": "patch",
    "agent": "agent", "web_search": "search", "websearch": "search", "web_fetch": "fetch", "webfetch": "fetch",
}


def label_of(name: str | None) -> str:
    """The label of a tool name, or the name itself, trimmed."""
    return TOOL_LABELS.get((name or "").strip().lower().replace("-", "_"), (name or "").strip())


def tool_label(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TOOL_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.translate(F.lower(F.trim(name)), "-", "_")), F.trim(name))


def derivation(path: Column, sidechain: Column) -> Column:
    """sub_agent, trimmed, continued, rollover or original, by the path and the side-thread flag."""
    p = F.lower(path)
    return (
        F.when(F.coalesce(sidechain, F.lit(False)) | p.rlike(r"(^|/)subagents(/|$)"), "sub_agent")
        .when(p.contains("trimmed"), "trimmed").when(p.contains("continued"), "continued").when(p.contains("rollover"), "rollover").otherwise("original")
    )


def session_id_from_path(path: Column) -> Column:
    stem = F.trim(F.regexp_extract(path, r"([^/\\]+?)(?:\.jsonl(?:\.zst)?|\.[^./\\]*)?$", 1))
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit("unknown-session"))


def decode_project_dir(name: Column) -> Column:
    """'-home-dev-x' to '/home/dev/x', 'C--work-x' to 'C:/work/x'."""
    drive = F.concat(F.substring(name, 1, 1), F.lit(":/"), F.regexp_replace(F.substring(name, 4, 1 << 20), "-", "/"))
    return F.when(name.rlike("^[A-Za-z]--"), drive).otherwise(F.regexp_replace(name, "-", "/"))


def line_fingerprint(text: Column) -> Column:
    """SHA-256 of the multiset of a text's lines: empty lines dropped, the others sorted by their bytes, each with its length as eight bytes,
    the lowest first, before it."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    kept = F.array_sort(F.filter(lines, lambda x: x != ""))

    def sized(x: Column) -> Column:
        size = F.lpad(F.hex(F.octet_length(x).cast("bigint")), 16, "0")
        return F.concat(*[F.substring(size, k, 2) for k in range(15, 0, -2)], F.hex(F.encode(x, "utf-8")))

    return F.sha2(F.unhex(F.array_join(F.transform(kept, sized), "")), 256)


def signature(*columns: Column) -> Column:
    """First 8 bytes, in hex, of the SHA-256 of canonical JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 16)


def merged_ranges(ranges: Column) -> Column:
    """Array of struct(start, end) with overlapping or touching ranges joined."""
    kind = "array<struct<start:int,end:int>>"
    ordered = F.array_sort(ranges.cast(kind))
    return F.aggregate(
        ordered, F.array().cast(kind),
        lambda out, r: F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["end"] >= r["start"]),
            F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(out, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(out, F.lit(-1))["end"], r["end"]).alias("end"))).cast(kind)))
        .otherwise(F.concat(out, F.array(r).cast(kind))),
    )
