"""Tool calls and generated texts: summaries, readable text, captured paths, question-and-answer turns, pairing without ids.

What is a walk over JSON of any shape runs as one Arrow-batched function over a column; everything else is column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import label_of
from threadloom.operators import sessions, structure


def _value(text: str) -> tuple[bool, object]:
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):  # no JSON, or deeper or with longer numbers than the decoder takes: the index tells
        return structure.value(text) if text.lstrip()[:1] in ("{", "[") else (False, None)


def loads(text: object) -> object:
    """A JSON value, or the text itself where it is none."""
    if not isinstance(text, str):
        return text
    good, value = _value(text)
    return value if good else text


def decoded(value: object) -> object:
    """JSON within strings within JSON, decoded all the way down."""
    root = [value]
    left: list[tuple[list | dict, object]] = [(root, 0)]
    while left:
        owner, at = left.pop()
        v = owner[at]
        while isinstance(v, str) and v.lstrip()[:1] in ("{", "["):
            good, inner = _value(v)
            if not good:
                break
            v = inner
        if isinstance(v, list):
            v = list(v)
            left += [(v, k) for k in range(len(v))]
        elif isinstance(v, dict):
            v = dict(v)
            left += [(v, k) for k in v]
        owner[at] = v
    return root[0]


def canonical(key: str) -> str:
    return re.sub(r"[^a-z0-9]", "", key.lower())


def pick(record: dict, *wanted: str) -> object:
    """Value of the first wanted key, letter case aside."""
    have = {k.lower(): v for k, v in reversed(list(record.items()))}
    return next((have[w.lower()] for w in wanted if w.lower() in have), None)


def cut(text: str, size: int) -> str:
    """At most ``size`` bytes of UTF-8, ended at a character."""
    return text.encode()[:size].decode("utf-8", "ignore")


def _brief(value: object) -> str:
    return cut(json.dumps(value, separators=(",", ":"), ensure_ascii=False), 200)


def call_summary(name: str | None, arguments: str | None) -> str:
    """What a call does, in a line: its command, path, pattern or patch, else its first four plain arguments."""
    value = loads(arguments)
    label = label_of(name)
    args = value if isinstance(value, dict) else {}
    text = lambda *keys: next((args[k].strip() for k in keys if isinstance(args.get(k), str) and args[k].strip()), None)
    found = None
    if label == "bash":
        found = text("command", "cmd") or (value.strip() if isinstance(value, str) else None)
    elif label in ("read", "write", "edit"):
        found = text("file_path") if "file_path" in args else text("path")
    elif label in ("glob", "grep") and text("pattern"):
        found = f"{args['pattern']} in {text('path')}" if text("path") else text("pattern")
    elif label == "patch":
        patch = value if isinstance(value, str) else args.get("input")
        if isinstance(patch, str):
            found = next((x.strip() for x in patch.splitlines() if re.match(r"\s*\*\*\* (?:Update|Add) File:", x)), "(patch)")
    if found:
        return found
    plain = [(k, v) for k, v in args.items() if isinstance(v, int | float) or isinstance(v, str) and v.strip()]
    shown = [f"{k}: {cut(v.strip(), 100) if isinstance(v, str) else json.dumps(v)}" for k, v in plain[:4]]
    return ", ".join(shown) if shown else _brief(value)


# Keys whose values are not for reading.
OPAQUE = {"meta", "metadata", "callid", "signature", "thinkingsignature", "encryptedcontent", "base64", "imageurl", "audiourl", "mimetype"}


def readable(value: object) -> str:
    """The plain values of a JSON value, depth first, one a line; media and opaque keys left out, repeated neighbours once."""
    lines: list[str] = []
    left = [value]
    while left:
        v = left.pop()
        if isinstance(v, str):
            t = v.strip()
            inner = loads(t) if t[:1] in ("{", "[") else t
            if not isinstance(inner, str):
                left.append(inner)
            elif t and not re.match(r"data:(?:image|audio)/", t, re.I) and (not lines or lines[-1] != t):
                lines.append(t)
        elif isinstance(v, list):
            left += reversed(v)
        elif isinstance(v, dict):
            if not re.search("image|audio", canonical(v["type"]) if isinstance(v.get("type"), str) else ""):
                left += [x for k, x in reversed(v.items()) if canonical(k) not in OPAQUE]
        elif v is not None:
            left.append(json.dumps(v))
    return "\n".join(lines)


# Keys under which directories, files and paths of either kind are written.
DIRECTORY_KEYS = set(
    "cwd workdir workingdir originalcwd relocatedcwd directory directorypath appdatadir artifactdirectorypath outputdir projectpath searchdirectory realparentdir transcriptdir "
    "trustedworkspaces unaccountedtopleveldirs writableroot writableroots workspaceroot workspaceroots workspacedirs workspacepaths workspaceuri workspaceuris worktreepath".split()
)
FILE_KEYS = set(
    "file files filepath filepaths filename configfilepath difffiles displaypath hotfiles targetfile trackingpath savepath planfilepath scriptpath outpath outputfile "
    "persistedoutputpath backupfilename movepath scopefiles transcriptpath".split()
)
PATH_KEYS = {"absolutepath", "fullpath", "originalpath", "outputpath", "searchpath", "paths"}
FILE_KINDS, FILE_CONTEXTS = {"localimage", "skill", "imageview"}, {"memorycitation", "parsedcmd"}
PATH_CONTEXTS = {"filesystem", "filesystemsandboxpolicy", "permissionprofile", "input", "arguments", "args"}
KEYED_MAPS = {"transcript": "trackedfilebackups", "rollout": "changes"}


def clean_path(raw: str) -> str | None:
    text = raw.strip()
    if text.startswith("file:"):
        text = unquote(urlparse(text).path)
    text = text.replace("\\", "/")
    return text if re.fullmatch(r"/|[A-Za-z]:/", text) else text.rstrip("/") or None


def captured(value: object, agent: str = "transcript") -> dict[str, list[str]]:
    """{'dirs', 'files', 'paths'}: paths written in a JSON value, by the keys they stand under; paths holds them all."""
    found: dict[str, set[str]] = {"dirs": set(), "files": set(), "paths": set()}

    def add(kind: str, texts: object) -> None:
        for t in texts if isinstance(texts, list) else [texts]:
            if isinstance(t, str) and (p := clean_path(t)):
                found[kind].add(p)
                found["paths"].add(p)

    def kind_of(key: str, owner: dict, above: tuple[str, ...]) -> str | None:
        if key in DIRECTORY_KEYS or key == "workspace" and agent == "bundle":
            return "dirs"
        if key in FILE_KEYS:
            return "files"
        if key in PATH_KEYS:
            return "paths"
        if key != "path":
            return None
        kind = canonical(owner["type"]) if isinstance(owner.get("type"), str) else ""
        if kind == "directory":
            return "dirs"
        if kind in FILE_KINDS or FILE_CONTEXTS & set(above):
            return "files"
        return "paths" if PATH_CONTEXTS & set(above) else None

    stack: list[tuple[object, tuple[str, ...]]] = [(value, ())]
    while stack:
        v, above = stack.pop()
        if isinstance(v, str) and v.strip()[:1] in ("{", "["):
            v = loads(v)
        if isinstance(v, list):
            stack += [(x, above) for x in v]
        elif isinstance(v, dict):
            for raw, x in v.items():
                key = canonical(raw)
                if key == KEYED_MAPS.get(agent) and isinstance(x, dict):
                    add("files", list(x))
                if kind := kind_of(key, v, (*above, key)):
                    add(kind, x)
                elif key == "uri":
                    add("paths", [t for t in (x if isinstance(x, list) else [x]) if isinstance(t, str) and t.lstrip().startswith("file:")])
                stack.append((x, (*above, key)))
    return {k: sorted(s) for k, s in found.items()}


# Blocks that tools put before a user's own words.
_LEADING = re.compile(
    r"\s*(?:(?:# )?(?:AGENTS|CLAUDE)\.md instructions(?: for [^\n]*)?[ \t]*\n\s*(?=<INSTRUCTIONS>)|<INSTRUCTIONS>.*?</INSTRUCTIONS>"
    r"|<(environment_context|skill|user_shell_command|turn_aborted|subagent_notification|recommended_plugins|goal_context|permissions instructions|collaboration_mode|external_[^>]*)>.*?(?i:</\1>)"
    r"|(?i:<codex_internal_context)[^>]*>.*?(?i:</codex_internal_context>)|## My request for Codex:)",
    re.S,
)


def authored(text: str | None) -> str | None:
    """A user's own words: leading generated blocks taken off as often as they come; None if nothing is left."""
    rest = (text or "").strip()
    while m := _LEADING.match(rest):
        rest = rest[m.end() :].lstrip()
    return rest.strip() or None


def over(function: Callable, kind: str, *columns: Column) -> Column:
    """``function`` of the columns' values, batch by batch."""

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([function(*row) for row in zip(*series)], dtype=object)

    run.__annotations__ = {"series": pd.Series, "return": pd.Series}  # the real types, not their names
    return F.pandas_udf(run, kind)(*columns)


def with_summaries(calls: DataFrame, name: str = "name", arguments: str = "arguments") -> DataFrame:
    return calls.withColumn("summary", over(call_summary, "string", F.col(name), F.col(arguments)))


def with_paths(rows: DataFrame, column: str, agent: str) -> DataFrame:
    kind = "struct<dirs:array<string>,files:array<string>,paths:array<string>>"

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in frames:
            yield pd.DataFrame([captured(loads(v), agent) for v in s], columns=["dirs", "files", "paths"])

    run.__annotations__ = {"frames": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return rows.withColumn("captured", F.pandas_udf(run, kind)(F.col(column)))


_PREAMBLE = "The following is a <SYSTEM_MESSAGE> not actually sent by the user. It is provided by the system as important information to pay attention to."  # fixed value
_UUID = "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"


def generated_kind(source: Column, step: Column, content: Column) -> Column:
    """Which of eleven kinds a generated message of the third producer is; null for messages of people and unknown ones."""
    text = F.coalesce(content, F.lit(""))
    wrapped = rf"(?s)^\s*\Q{_PREAMBLE}\E\s*<SYSTEM_MESSAGE>\s*(.*?)\s*</SYSTEM_MESSAGE>\s*$"
    body = F.regexp_extract(text, wrapped, 1)
    message = rf"(?s)^\[Message\] timestamp=(\S+) sender=(\S+) priority=MESSAGE_PRIORITY_[A-Z_]+ content=(.*\S.*)$"
    stamp, sender, payload = (F.regexp_extract(body, message, k) for k in (1, 2, 3))
    task = sender.rlike(f"^{_UUID}/task-[0-9]+$")
    named = F.concat(F.lit('Task id "'), sender, F.lit('"'))
    told = (
        F.when(task & payload.startswith(F.concat(named, F.lit(" was canceled with result:"))), "task_canceled")
        .when(task & payload.startswith(F.concat(named, F.lit(" finished with result:"))), "task_finished")
        .when(task & payload.startswith("Check "), "task_reminder").when(task & payload.startswith("The command output has stabilized for "), "task_stalled")
        .when((sender == "system") & payload.startswith("[Notice] All your subagents and background tasks have been stopped due to server restart."), "restart_notice")
        .when((sender == "system") & payload.startswith("The subagent ") & payload.contains(" encountered an error and has either stopped or failed to start execution:"), "subagent_error")
        .when(sender.rlike(f"^{_UUID}$"), "agent_message")
    )
    system = F.when(body.startswith("Stop hook blocked termination:"), "hook_feedback").when(stamp.try_cast("timestamp").isNotNull(), told)
    return F.when((source == "SYSTEM") & (F.trim(text) != ""), F.when(step == "DIRECTORY_RULES", "directory_rules").when(step == "CHECKPOINT", "checkpoint").when(step == "ERROR_MESSAGE", "error").when(step == "SYSTEM_MESSAGE", system))


def paired_in_order(steps: DataFrame) -> DataFrame:
    """(session, call_step, result_step, name): results of the third producer, which carry no id, with the calls they answer.

    A result takes the oldest pending call of its name, else the oldest of any; without one it stands for a call of its own (null call_step).
    steps: session, step, kind ('call' or 'result'), name.  The queue depends on order, so a session's calls and results (ids and names only)
    are read in order by one task.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        pending: list[tuple[int, str]] = []
        out = []
        for r in frame.sort_values("step", kind="stable").itertuples():
            name = canonical(r.name or "")
            if r.kind == "call":
                pending.append((r.step, name))
                continue
            k = next((i for i, p in enumerate(pending) if p[1] == name), 0 if pending else None)
            call = None if k is None else pending.pop(k)[0]
            out.append((r.session, call, r.step, r.name))
        out += [(frame["session"].iloc[0], s, None, n) for s, n in pending]
        return pd.DataFrame(out, columns=["session", "call_step", "result_step", "name"]).astype({"call_step": "Int64", "result_step": "Int64"})

    return steps.select("session", F.col("step").cast("bigint").alias("step"), "kind", "name").groupBy("session").applyInPandas(run, "session string, call_step bigint, result_step bigint, name string")


def _asked(arguments: str | None) -> list[dict]:
    value = loads(arguments)
    questions = value.get("questions") if isinstance(value, dict) else None
    return [q for q in questions if isinstance(q, dict) and isinstance(q.get("question"), str)] if isinstance(questions, list) else []


def question_text(arguments: str | None) -> str | None:
    """Questions put to the user, as the agent's words."""
    out = []
    for q in _asked(arguments):
        options = [o.get("label") if isinstance(o, dict) else o for o in q.get("options") or []]
        out.append("\n".join([q["question"], *[f"- {o}" for o in options if isinstance(o, str)]]))
    return "\n\n".join(out) or None


def answer_text(arguments: str | None, output: str | None, asynchronous: bool) -> str | None:
    """The user's answers, secrets masked; None for a mere receipt."""
    value = loads(output)
    if not isinstance(value, dict) or asynchronous and value.get("accepted") is True:
        return None
    answers, out = value.get("answers") if isinstance(value.get("answers"), dict) else {}, []
    for q in _asked(arguments):
        given = answers.get(q.get("id"))
        given = given.get("answers") if isinstance(given, dict) else given
        given = [x for x in (given if isinstance(given, list) else [given]) if isinstance(x, str) and x.strip()]
        if given:
            out.append(f"{q['question']}\n" + ("[secret]" if q.get("isSecret") or q.get("is_secret") else ", ".join(given)))
    return "\n\n".join(out) or None


def questions(rows: DataFrame) -> DataFrame:
    """(file_id, line_no, role, text): calls that ask the user as the agent's turns, their outputs as the user's."""
    asks = F.regexp_extract(F.coalesce("name", F.lit("")), r"([^.]*)$", 1).isin("request_user_input", "request_user_input_async")
    pairs = sessions.paired_calls(rows).where(asks)
    agent = pairs.select("file_id", F.col("call_line").alias("line_no"), F.lit("assistant").alias("role"), over(question_text, "string", F.col("arguments")).alias("text"))
    user = pairs.where("output_line IS NOT NULL").select("file_id", F.col("output_line").alias("line_no"), F.lit("user").alias("role"), over(answer_text, "string", F.col("arguments"), F.col("output"), F.col("name").endswith("_async")).alias("text"))
    return agent.unionByName(user).where("text IS NOT NULL")
