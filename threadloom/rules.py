"""User rules over sessions: Python callables that propose to trash or restore a session.

A rule sees one session with its turns.  What can be decided without the callable (turn bounds, filters, protection, known results) is
decided by column expressions before any context is built; callables run in ``mapInPandas`` over one row for each session left.
"""

from __future__ import annotations

import json
import signal
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.search import Filters, filter_condition, scope_condition

ACTIONS = ("nothing", "trash", "untrash")


@dataclass(frozen=True)
class Rule:
    name: str
    call: Callable
    at_startup: bool = True
    min_turns: int | None = None
    max_turns: int | None = None
    dependency_policy: str = "include"


@dataclass
class Rules:
    rules: list[Rule] = field(default_factory=list)

    def rule(self, name: str, **config):
        """Decorator: ``@rules.rule('name', min_turns=1)``."""
        if not isinstance(name, str) or not name.strip():
            raise ValueError("a rule needs a name")
        if any(r.name == name for r in self.rules):
            raise ValueError(f"the rule {name} exists already")
        unknown = set(config) - {"at_startup", "min_turns", "max_turns", "dependency_policy"}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        for k in ("min_turns", "max_turns"):
            if config.get(k) is not None and (not isinstance(config[k], int) or isinstance(config[k], bool) or config[k] < 0):
                raise ValueError(f"{k} is a number of turns")
        if config.get("min_turns") is not None and config.get("max_turns") is not None and config["min_turns"] > config["max_turns"]:
            raise ValueError("min_turns is above max_turns")
        if config.get("dependency_policy", "include") not in ("include", "skip"):
            raise ValueError("dependency_policy is include or skip")

        def add(call: Callable) -> Callable:
            self.rules.append(Rule(name, call, **config))
            return call

        return add


def nothing(reason: str | None = None) -> dict:
    return {"action": "nothing", "reason": reason}


def trash(reason: str | None = None) -> dict:
    return {"action": "trash", "reason": reason}


def untrash(reason: str | None = None) -> dict:
    return {"action": "untrash", "reason": reason}


class Text(str):
    """A turn's text; ``limit(n)`` cuts it to n bytes of UTF-8 at a character's edge and marks the cut."""

    def limit(self, n: int = 1_000_000_000, mark: str = "…") -> str:
        raw = self.encode()
        return str(self) if len(raw) <= n else raw[:n].decode("utf-8", "ignore") + mark


def outcomes(result: object) -> list[dict]:
    """Checks what a rule returned: an action, a list of actions, or None."""
    items = result if isinstance(result, list) else [] if result is None else [result]
    out = []
    for x in items:
        if not isinstance(x, dict) or x.get("action") not in ACTIONS:
            raise ValueError(f"unsupported action: {x!r}")
        if x["action"] == "nothing" and not (x.get("reason") or "").strip():
            continue
        out.append({"action": x["action"], "reason": x.get("reason")})
    return out


def contexts(messages: DataFrame) -> DataFrame:
    """(session_id, user_turns, turns): one row for each session.  messages: session_id, turn_no, speaker, content, timestamp."""
    turn = F.struct(F.col("turn_no").alias("index"), F.col("speaker").alias("role"), F.col("content").alias("text"))
    return messages.groupBy("session_id").agg(F.count_if(F.col("speaker") == "user").alias("user_turns"), F.sort_array(F.collect_list(turn)).alias("turns"))


def eligible(messages: DataFrame, rules: Rules, startup: bool = False) -> DataFrame:
    """Session ids with a number of user turns that some rule takes: a small aggregation before contexts are built."""
    turns = messages.groupBy("session_id").agg(F.count_if(F.col("speaker") == "user").alias("user_turns"))
    c = F.lit(False)
    for r in rules.rules:
        if startup and not r.at_startup:
            continue
        c = c | ((F.lit(True) if r.min_turns is None else F.col("user_turns") >= r.min_turns) & (F.lit(True) if r.max_turns is None else F.col("user_turns") <= r.max_turns))
    return turns.where(c)


_RESULT = "rule string, session_id string, action string, reason string, dependency_policy string, error string"


#: Seconds that a rule may take for one session.
SECONDS = 30.0


@contextmanager
def limited(seconds: float) -> Iterator[None]:
    """Ends what runs longer with a TimeoutError; where no timer can be set (outside a main thread) it runs on."""

    def stop(*_: object) -> None:
        raise TimeoutError(f"longer than {seconds} seconds")

    try:
        before = signal.signal(signal.SIGALRM, stop)
    except ValueError:
        yield
        return
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def evaluate(
    sessions: DataFrame, messages: DataFrame, rules: Rules, startup: bool = False, protected: DataFrame | None = None, known: DataFrame | None = None,
    filters: Filters | None = None, scope: str | None = None, seconds: float = SECONDS,
) -> DataFrame:
    """(rule, session_id, action, reason, dependency_policy, error): all outcomes; an error in a rule is a row, not a failure.

    protected: session ids that must not be touched.  known: (session_id, fingerprint) of results that still hold.  filters, scope: as for a search,
    over the columns of sessions.  A rule that takes more than ``seconds`` for a session, or recurses without end, is such an error.
    """
    if filters is not None:
        sessions = sessions.where(filter_condition(filters, sessions.columns))
    if scope is not None:
        sessions = sessions.where(scope_condition(scope, sessions.columns))
    wanted = eligible(messages, rules, startup).select("session_id")
    if filters is not None or scope is not None:
        wanted = wanted.join(sessions.select("session_id"), "session_id", "left_semi")
    if protected is not None:
        wanted = wanted.join(protected.select("session_id"), "session_id", "left_anti")
    if known is not None:
        wanted = wanted.join(sessions.join(known, ["session_id", "fingerprint"], "left_semi").select("session_id"), "session_id", "left_anti")
    rows = contexts(messages.join(wanted, "session_id", "left_semi")).join(sessions, "session_id")
    about = [c for c in sessions.columns if c != "fingerprint"]
    packed = rows.select("session_id", "user_turns", F.to_json(F.struct(*about)).alias("session"), F.to_json("turns").alias("turns"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                session = json.loads(row.session)
                turns = [{**t, "text": Text(t.get("text") or "")} for t in json.loads(row.turns)]
                for r in rules.rules:
                    if startup and not r.at_startup or r.min_turns is not None and row.user_turns < r.min_turns or r.max_turns is not None and row.user_turns > r.max_turns:
                        continue
                    try:
                        with limited(seconds):
                            result = r.call({"session": session, "turns": turns, "user_turns": row.user_turns})
                        out += [(r.name, row.session_id, x["action"], x["reason"], r.dependency_policy, None) for x in outcomes(result)]
                    except Exception as e:  # noqa: BLE001
                        out.append((r.name, row.session_id, None, None, r.dependency_policy, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["rule", "session_id", "action", "reason", "dependency_policy", "error"])

    return packed.mapInPandas(run, _RESULT)


def report(results: DataFrame) -> dict[str, DataFrame]:
    """Proposals, remarks and errors, one table for each."""
    return {
        "proposals": results.where("action IN ('trash', 'untrash')").drop("error").distinct(),
        "remarks": results.where("action = 'nothing'").drop("error"),
        "errors": results.where("error IS NOT NULL").select("rule", "session_id", "error"),
    }


def rechecked(proposals: DataFrame, protected: DataFrame, before: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proposals that may be carried out, in the order of their sessions; (rule, session_id, skipped)): a session that has come under
    protection since, or whose fingerprint is another one or gone, is left alone.  before, now: session_id, fingerprint."""
    state = proposals.join(protected.select("session_id").distinct().withColumn("__held", F.lit(True)), "session_id", "left")
    same = before.join(now, ["session_id", "fingerprint"], "left_semi").select("session_id").distinct().withColumn("__same", F.lit(True))
    state = state.join(same, "session_id", "left").withColumn("skipped", F.when(F.col("__held"), "in use").when(F.col("__same").isNull(), "changed"))
    return state.where("skipped IS NULL").select(proposals.columns).orderBy("session_id", "rule"), state.where("skipped IS NOT NULL").select("rule", "session_id", "skipped")


def exported(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, json): what a rule would see, with all text."""
    return contexts(messages).join(sessions, "session_id").select("session_id", F.to_json(F.struct("*")).alias("json"))
