"""Chat rows to ordered conversations, without those that are broken, empty or lack a reply.

Rows are laid out by conversation and, within it, in sequence: each message right after the replies that hang on it.  A finite-state
automaton reads that sequence; its alphabet are replies and messages (asking or not, blank or not, rooted or not), its states what has been
seen of the conversation (something said, a broken link, a question without reply) and whether the message that comes next has a reply.
A conversation may hold a third of all rows, so the layout is a range partition and no task needs a whole conversation: a task runs
the automaton over its stretch for all states at once, as a member of the automaton's transition monoid, and the stretches' functions,
one for each task at most, are composed in order.

Two things are settled before, over ids and flags only: whether a message leads up to a true root (:func:`hierarchy.rooted`), and where replies
lead that hang on system and meta rows (pointer doubling over those few rows).  Texts join last, for the turns that are kept.

Turns are ordered by the reply tree, a branch at a time (the entries of Euler tours), trees by their first turn; regenerated and edited turns
are branches of their own, and ``active`` marks the branch that leads to the tree's last turn.

Defined results: ids compare without letter case and come out in lower case; rows without sessionId belong to no conversation; repeated rows
(one uuid) count once, the first delivered; a message without a uuid is a message on which nothing can hang, and is ordered behind the one
it hangs on; the role of a message is user or assistant, any other role gives way to the row's type; null timestamps count as earliest
where the last turn of a tree is sought and latest where trees are ordered; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.hierarchy import followed, hierarchy, rooted
from threadloom.util import checkpoint, numbered, shuffle_partitions

# Of a conversation: what has been seen; REPLIED: the message that comes next has a reply.
SAID, BROKEN, UNANSWERED, REPLIED = 1, 2, 4, 8
STATES = 16
# The alphabet: nothing (the conversation exists), a reply, or MESSAGE with its traits.
NOTHING, REPLY, MESSAGE = 0, 1, 2
ASKS, SAYS, LOST = 1, 2, 4
_FRESH = 16  # added to a symbol that begins another place: an earlier reply is none to it
_PART = "session string, part int, becomes array<int>"


def step(state: int, symbol: int) -> int:
    """The state after a symbol."""
    if symbol >= _FRESH:
        state, symbol = state & ~REPLIED, symbol - _FRESH
    if symbol == REPLY:
        return state | REPLIED
    if symbol < MESSAGE:
        return state
    traits = symbol - MESSAGE
    missing = bool(traits & ASKS) and not state & REPLIED
    return (state & ~REPLIED) | (SAID if traits & SAYS else 0) | (BROKEN if traits & LOST else 0) | (UNANSWERED if missing else 0)


class Monoid:
    """Functions of states that sequences of symbols make, numbered as they are met; 0 is the function of the empty sequence."""

    def __init__(self) -> None:
        self.functions = [tuple(range(STATES))]
        self.numbers = {self.functions[0]: 0}
        self.moves: dict[int, int] = {}

    def after(self, function: int, symbol: int) -> int:
        key = function * 64 + symbol
        if key not in self.moves:
            new = tuple(step(s, symbol) for s in self.functions[function])
            if new not in self.numbers:
                self.numbers[new] = len(self.functions)
                self.functions.append(new)
            self.moves[key] = self.numbers[new]
        return self.moves[key]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(session, part, becomes): the function of the stretch of each conversation that lies in this task."""
    monoid, part = Monoid(), TaskContext.get().partitionId()
    session, place, function = None, None, 0
    done: list[tuple[str, int]] = []

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in done], pa.string()), pa.array([part] * len(done), pa.int32()), pa.array([list(monoid.functions[f]) for _, f in done], pa.list_(pa.int32()))], names=["session", "part", "becomes"]
        )
        done.clear()
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        sessions, places = batch["session"], batch["place"]
        changed = lambda x: pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
        other = np.r_[sessions[0].as_py() != session, changed(sessions)]
        fresh = other | np.r_[places[0].as_py() != place, changed(places)]
        symbols = (batch["symbol"].to_numpy() + np.where(fresh, _FRESH, 0)).tolist()
        edges = sorted({0, *np.flatnonzero(other).tolist(), len(symbols)})
        for a, b in zip(edges[:-1], edges[1:]):
            if other[a]:
                if session is not None:
                    done.append((session, function))
                session, function = sessions[a].as_py(), 0
            for symbol in symbols[a:b]:
                function = monoid.after(function, symbol)
        place = places[-1].as_py()
        if len(done) > 10_000:
            yield flushed()
    if session is not None:
        done.append((session, function))
    yield flushed()


def _blank(content: Column) -> Column:
    kept = F.regexp_replace(content, r"^[\s ]+|[\s ]+$", "")
    return content.isNull() | kept.isin("", "[]", '""')


def _rows(table: DataFrame) -> DataFrame:
    false = F.lit(False)
    return table.select(
        "row_id", F.lower("sessionId").alias("session"), F.lower("uuid").alias("uuid"), F.lower("parentUuid").alias("parent"), "timestamp",
        F.coalesce("isSidechain", false).alias("side"), F.coalesce("isMeta", false).alias("meta"), "type",
        F.when(F.col("message.role").isin("user", "assistant"), F.col("message.role")).otherwise(F.col("type")).alias("role"), F.col("message.content").alias("content"),
    )


def messages(table: DataFrame) -> DataFrame:
    """One row of each message, without its text: (row_id, session, uuid, parent, timestamp, role, blank)."""
    rows = _rows(table).where("session IS NOT NULL AND type IN ('user', 'assistant') AND NOT side AND NOT meta").withColumn("blank", _blank(F.col("content")))
    columns = ["row_id", "session", "parent", "timestamp", "role", "blank"]
    once = rows.where("uuid IS NOT NULL").groupBy("uuid").agg(F.min_by(F.struct(*columns), "row_id").alias("m")).select("uuid", "m.*")
    return once.unionByName(rows.where("uuid IS NULL").select("uuid", *columns))


def _replies(said: DataFrame, table: DataFrame) -> DataFrame:
    """(session, uuid): what assistant messages that are not blank hang on, directly or through system and meta rows."""
    through = _rows(table).where("uuid IS NOT NULL AND session IS NOT NULL AND NOT side AND (type = 'system' OR meta)")
    through = checkpoint(through.groupBy("uuid").agg(F.min_by(F.struct("session", "parent"), "row_id").alias("t")).select("uuid", "t.session", F.col("t.parent").alias("up")).where("up IS NOT NULL"))
    # Where each such row leads, past all others of its session; rows in a loop lead nowhere.
    ends = followed(through.select(F.struct("session", "uuid").alias("v"), F.struct(F.col("session"), F.col("up").alias("uuid")).alias("to"))).where("last IS NOT NULL")
    done = ends.select(F.col("v.session").alias("session"), F.col("v.uuid").alias("uuid"), F.col("last.uuid").alias("up"))
    hung = said.where("role = 'assistant' AND NOT blank AND parent IS NOT NULL").select("session", F.col("parent").alias("on")).distinct()
    past = hung.join(done.select(F.col("uuid").alias("on"), "session", "up"), ["on", "session"], "left")
    return past.select("session", F.coalesce("up", "on").alias("uuid")).distinct()


def judged(table: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """(session_id, state) of every conversation: the state in which the automaton ends."""
    said = checkpoint(messages(table)) if said is None else said
    sound = rooted(table)
    named = said.where("uuid IS NOT NULL").join(sound, "uuid").select("session", F.col("uuid").alias("place"), "role", "blank", (~F.col("sound")).alias("lost"))
    bare = said.where("uuid IS NULL").join(sound.select(F.col("uuid").alias("parent"), "sound"), "parent", "left")
    lost = F.col("parent").isNotNull() & ~F.coalesce("sound", F.lit(False))
    bare = bare.select("session", F.concat(F.lit("row "), "row_id").alias("place"), "role", "blank", lost.alias("lost"))
    trait = lambda c, bit: F.when(c, bit).otherwise(0)
    symbol = MESSAGE + trait(F.col("role") == "user", ASKS) + trait(~F.col("blank"), SAYS) + trait(F.col("lost"), LOST)
    read = named.unionByName(bare).select("session", "place", symbol.alias("symbol"))
    replies = _replies(said, table).select("session", F.col("uuid").alias("place"), F.lit(REPLY).alias("symbol"))
    exist = table.select(F.lower("sessionId").alias("session")).where("session IS NOT NULL").distinct().select("session", F.lit("").alias("place"), F.lit(NOTHING).alias("symbol"))
    every = read.unionByName(replies).unionByName(exist)
    # A place has one message and one reply at most, so equal (session, place) keep to one task and the ranges stay even.
    laid = every.repartitionByRange(shuffle_partitions(table.sparkSession), "session", "place").sortWithinPartitions("session", "place", "symbol")
    parts = laid.mapInArrow(_run, _PART).groupBy("session").agg(F.sort_array(F.collect_list(F.struct("part", "becomes"))).alias("parts"))
    end = F.aggregate("parts", F.lit(0), lambda state, x: F.get(x["becomes"], state))
    return parts.select(F.col("session").alias("session_id"), end.alias("state"))


def fault(state: Column) -> Column:
    return F.when(state.bitwiseAND(SAID) == 0, "empty").when(state.bitwiseAND(BROKEN) != 0, "broken").when(state.bitwiseAND(UNANSWERED) != 0, "no_reply")


def faults(table: DataFrame) -> DataFrame:
    """(session_id, fault): the conversations to drop, with the first fault that holds."""
    return judged(table).select("session_id", fault(F.col("state")).alias("fault")).where("fault IS NOT NULL")


def conversations(table: DataFrame) -> DataFrame:
    """(session_id, turn_no, active, speaker, row_id, uuid, timestamp, content): the turns, in order, of the conversations kept."""
    said = checkpoint(messages(table))
    kept = judged(table, said).where(fault(F.col("state")).isNull()).select(F.col("session_id").alias("session"))
    turns = said.where("NOT blank").join(kept, "session", "left_semi")
    tree = hierarchy(table).select("uuid", "root_uuid", "entry", "exit")
    at = turns.withColumn("bare", F.col("uuid").isNull()).withColumn("node", F.coalesce("uuid", "parent"))
    placed = at.where("node IS NOT NULL").join(tree.withColumnRenamed("uuid", "node"), "node")
    alone = at.where("node IS NULL").select(*at.columns, F.concat(F.lit("row "), "row_id").alias("root_uuid"), F.lit(0).cast("bigint").alias("entry"), F.lit(0).cast("bigint").alias("exit"))
    placed = checkpoint(placed.unionByName(alone).select("session", "root_uuid", "entry", "exit", "bare", "row_id", "timestamp", "role", "uuid"))
    trees = placed.groupBy("session", "root_uuid").agg(
        F.min(F.struct(F.col("timestamp").isNull().alias("n"), "timestamp", "row_id")).alias("first"), F.max_by(F.struct("entry", "exit"), F.struct("timestamp", "row_id")).alias("last")
    )
    ranged = placed.join(trees, ["session", "root_uuid"]).withColumn("active", (F.col("entry") <= F.col("last.entry")) & (F.col("exit") >= F.col("last.exit")))
    order = ["session", "first.n", "first.timestamp", "first.row_id", "root_uuid", "entry", "bare", "row_id"]
    in_order = numbered(ranged.select("session", "first", "root_uuid", "entry", "bare", "row_id", "timestamp", "role", "uuid", "active"), order, "place")
    first = in_order.groupBy("session").agg(F.min("place").alias("begin"))
    texts = table.select("row_id", F.col("message.content").alias("content"))
    named = in_order.join(first, "session").join(texts, "row_id")
    return named.select(F.col("session").alias("session_id"), (F.col("place") - F.col("begin") + 1).alias("turn_no"), "active", F.col("role").alias("speaker"), "row_id", "uuid", "timestamp", "content")
