"""Forked sessions: which ones others supersede, families, and what must move together.

Relations between a fork and its parent are array algebra over event ids; families are connected components by label propagation with
pointer jumping; successors and closures are followed by pointer doubling.  Every loop is checkpointed and ends by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.hierarchy import followed
from threadloom.util import checkpoint


def fork_edges(sessions: DataFrame) -> DataFrame:
    """(child, parent): children that are indexed, kept and whose history is safe, with every session of a parent's id."""
    children = sessions.where("NOT coalesce(trashed, false) AND coalesce(safe, true)").select(F.col("key").alias("child"), "agent", F.explode("fork_parents").alias("session_id"))
    parents = sessions.where("session_id IS NOT NULL").select(F.col("key").alias("parent"), "agent", "session_id")
    return children.join(parents, ["agent", "session_id"]).where("child <> parent").select("child", "parent").distinct()


def _sub(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b))


def copied_relation(parent_events: Column, inherited: Column, own: Column) -> Column:
    """Producer whose forks copy their parent's events: all parent events inherited; own events decide."""
    return F.when(_sub(parent_events, inherited) > 0, "unrelated").when(own > 0, "supersedes").when(_sub(inherited, parent_events) == 0, "equivalent").otherwise("unrelated")


def rollout_relation(parent: Column, child: Column) -> Column:
    """Producer whose forks hold event ids; structs with events, activity, aborted struct<events, active, lines>, turns array<struct<lines, last>>."""
    missing = F.array_except(parent["events"], child["events"])
    new = F.array_except(child["events"], parent["events"])
    aborted = parent["aborted"]
    n_child, n_parent = F.size(F.array_distinct(child["events"])), F.size(F.array_distinct(parent["events"]))
    whole = F.when(n_child > n_parent, "supersedes").when(n_child == n_parent, "equivalent").otherwise("unrelated")
    only_empty = ~aborted["active"] & (F.size(missing) == F.size(F.array_distinct(aborted["events"])))
    retried = (aborted["lines"] != "") & F.exists(child["turns"], lambda t: (t["lines"] == aborted["lines"]) & F.array_contains(new, t["last"]))
    active = F.size(F.array_intersect(child["activity"], new)) > 0
    return (
        F.when(F.size(missing) == 0, whole)
        .when(aborted.isNull() | (_sub(missing, aborted["events"]) > 0), "unrelated")
        .when(only_empty & (F.size(new) == 0), "equivalent")
        .when(active & (only_empty | F.coalesce(retried, F.lit(False))), "supersedes")
        .otherwise("unrelated")
    )


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, root): the least vertex of each connected component.  edges: (a, b).

    A round takes the least label among neighbours and then the label's label, so labels travel twice as far each time.
    """
    both = checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = checkpoint(vertices.select("v").distinct().withColumn("root", F.col("v")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("v")).agg(F.min("r").alias("r"))
        step = labels.join(near, "v", "left").select("v", F.col("root").alias("old"), F.least("root", F.coalesce("r", "root")).alias("root"))
        jump = step.join(step.select(F.col("v").alias("root"), F.col("root").alias("r2")), "root", "left").select("v", "old", F.least("root", F.coalesce("r2", "root")).alias("root"))
        new = checkpoint(jump)
        labels = new.select("v", "root")
        if new.where("root <> old").isEmpty():
            return labels


def equivalence_key(sessions: DataFrame) -> Column:
    """Sorted event set without an aborted last turn that did nothing; for copied forks the inherited events too."""
    idle = F.coalesce(~F.col("aborted.active"), F.lit(False))
    kept = F.when(idle, F.array_except("events", F.coalesce("aborted.events", F.array().cast("array<string>")))).otherwise(F.array_distinct("events"))
    copied = F.array_union(F.coalesce("inherited", F.array().cast("array<string>")), "events")
    return F.array_sort(F.when(F.col("agent") == "rollout", kept).when(F.col("agent") == "transcript", copied).otherwise(F.array().cast("array<string>")))


def superseded(sessions: DataFrame) -> DataFrame:
    """(key, superseded_by) of the sessions that another stands for.

    sessions: key, agent, session_id, fork_parents, trashed, safe, modified, events, inherited, own, activity, aborted, turns.
    """
    state = checkpoint(sessions)
    edges = fork_edges(state)
    side = ["events", "inherited", "own", "activity", "aborted", "turns"]
    p = state.select(F.col("key").alias("parent"), "agent", F.struct(*side).alias("p"), F.coalesce("safe", F.lit(True)).alias("p_safe"))
    c = state.select(F.col("key").alias("child"), F.struct(*side).alias("c"))
    relation = F.when(F.col("agent") == "rollout", rollout_relation(F.col("p"), F.col("c"))).when(F.col("agent") == "transcript", copied_relation(F.col("p.events"), F.col("c.inherited"), F.col("c.own"))).otherwise("unrelated")
    related = checkpoint(edges.join(p, "parent").join(c, "child").select("child", "parent", "p_safe", relation.alias("relation")))
    family = components(state.select(F.col("key").alias("v")), edges.select(F.col("child").alias("a"), F.col("parent").alias("b")))
    keyed = state.where("NOT coalesce(trashed, false) AND coalesce(safe, true)").withColumn("same", equivalence_key(state)).where(F.size("same") > 0)
    keyed = keyed.join(family.select(F.col("v").alias("key"), "root"), "key").select("key", "agent", "session_id", "modified", "root", F.sha2(F.to_json("same"), 256).alias("same"))
    alone = family.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    keyed = keyed.join(alone, "root", "left_semi")
    parents = related.where("relation = 'equivalent'").select(F.col("parent").alias("key")).distinct().withColumn("is_parent", F.lit(1))
    ranked = keyed.join(parents, "key", "left").groupBy("root", "agent", "same").agg(
        F.max_by(F.struct("key", "session_id"), F.struct(F.coalesce(-F.col("is_parent"), F.lit(0)), "modified", F.coalesce("session_id", F.lit("")), "key")).alias("w"), F.count(F.lit(1)).alias("n")
    )
    groups = keyed.join(ranked.where("n > 1"), ["root", "agent", "same"]).select("key", F.col("w.key").alias("keeper"), F.coalesce("w.session_id", "w.key").alias("keeper_id"))
    groups = checkpoint(groups)
    stands = lambda name: groups.select(F.col("key").alias(name), F.col("keeper").alias(f"{name}_keeper"))
    strict = related.where("relation = 'supersedes' AND p_safe").join(stands("parent"), "parent", "left").join(stands("child"), "child", "left")
    strict = strict.select(F.coalesce("parent_keeper", "parent").alias("source"), F.coalesce("child_keeper", "child").alias("key")).where("source <> key")
    targets = state.select("key", "session_id", "modified", F.size(F.array_distinct("events")).alias("n"))
    best = strict.join(targets, "key").groupBy("source").agg(F.max_by(F.coalesce("session_id", "key"), F.struct("n", "modified", F.coalesce("session_id", F.lit("")), "key")).alias("superseded_by"))
    best = checkpoint(best)
    hidden = groups.where("key <> keeper").join(best.select(F.col("source").alias("key")), "key", "left_anti").select("key", F.col("keeper_id").alias("superseded_by"))
    direct = checkpoint(hidden.unionByName(best.select(F.col("source").alias("key"), "superseded_by")))
    # A successor may itself be superseded: the chain is followed to the session that is kept; a chain that runs in a loop keeps all.
    names = state.select("key", "agent", F.coalesce("session_id", "key").alias("id"))
    by_id = names.groupBy("agent", "id").agg(F.max("key").alias("next"))
    on = direct.join(names.select("key", "agent"), "key").join(by_id.withColumnRenamed("id", "superseded_by"), ["agent", "superseded_by"])
    ends = followed(on.select(F.col("key").alias("v"), F.col("next").alias("to")))
    followed_ = ends.join(names.select(F.col("key").alias("last"), "id"), "last", "left").select(F.col("v").alias("key"), F.col("last").isNotNull().alias("ends"), F.col("id").alias("end"))
    out = direct.join(followed_, "key", "left").where("coalesce(ends, true)")
    return out.select("key", F.coalesce("end", "superseded_by").alias("superseded_by"))


def ambiguous_ids(members: DataFrame) -> DataFrame:
    """Rollout ids that more than one path claims."""
    return members.where("rollout_id IS NOT NULL").groupBy("rollout_id").agg(F.countDistinct("path").alias("paths")).where("paths > 1")


def dependencies(members: DataFrame) -> DataFrame:
    """(a, b, why): b is of a's thread, b needs a's history, or b was forked from a.  members: path, agent, thread_id, rollout_id, history_base, fork_parent.

    A thread's members are tied to its first one, both ways, and not each to each: what is reached from any of them is the same.  Members in
    the trash are tied to the first of theirs, and the two first ones to each other, so that those in the trash reach each other by themselves.
    """
    m = members.where("agent = 'rollout'")
    l, r = m.alias("l"), m.alias("r")
    pick = lambda why: [F.col("l.path").alias("a"), F.col("r.path").alias("b"), F.lit(why).alias("why")]
    away = F.coalesce("trashed", F.lit(False)) if "trashed" in members.columns else F.lit(False)
    placed = m.where("thread_id IS NOT NULL").select("thread_id", "path", away.alias("away"))
    hubs = placed.groupBy("thread_id", "away").agg(F.min("path").alias("hub"))
    spokes = placed.join(hubs, ["thread_id", "away"]).where("path <> hub").select(F.col("path").alias("a"), F.col("hub").alias("b"), F.lit("same_thread").alias("why"))
    between = hubs.groupBy("thread_id").agg(F.min("hub").alias("a"), F.max("hub").alias("b")).where("a <> b").select("a", "b", F.lit("same_thread").alias("why"))
    spokes = spokes.unionByName(between)
    thread = spokes.unionByName(spokes.select(F.col("b").alias("a"), F.col("a").alias("b"), "why"))
    needs = l.join(r, F.col("l.rollout_id") == F.col("r.history_base")).where("l.path <> r.path").select(*pick("requires"))
    a, b = members.alias("l"), members.alias("r")
    forks = a.join(b, (F.col("l.agent") == F.col("r.agent")) & (F.col("l.thread_id") == F.col("r.fork_parent"))).where("l.path <> r.path").select(*pick("fork"))
    return thread.unionByName(needs).unionByName(forks).distinct()


def related(members: DataFrame, seeds: DataFrame) -> DataFrame:
    """(path) of everything connected to the seeds by any dependency."""
    family = components(members.select(F.col("path").alias("v")), dependencies(members).select("a", "b"))
    wanted = family.join(seeds.select(F.col("path").alias("v")), "v", "left_semi").select("root").distinct()
    return family.join(wanted, "root", "left_semi").select(F.col("v").alias("path"))


def plan(members: DataFrame, seeds: DataFrame, operation: str, live: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((path, reason) of all members an operation moves, (path, blocker)); operation: trash, delete or restore.

    From the seeds on, threads are taken whole.  Trash and delete go on to what depends on a member; members that lie in the trash already pass
    this on but are not moved.  Restore goes back to the history a member needs, where that lies in the trash and no copy outside it stands in.
    """
    graph = checkpoint(dependencies(members).where("why <> 'fork'"))
    flags = members.select("path", "trashed")
    eligible = F.lit(True) if operation == "delete" else F.col("trashed") if operation == "restore" else ~F.col("trashed")
    chosen = seeds.select("path").distinct().join(flags, "path", "left")
    good = chosen.where(F.coalesce(eligible, F.lit(False)))
    blockers = chosen.where(~F.coalesce(eligible, F.lit(False))).select("path", F.when(F.col("trashed").isNull(), "seed is not known").otherwise(f"seed cannot be taken by {operation}").alias("blocker"))
    if operation == "restore":
        active = members.where("NOT trashed").select(F.col("rollout_id").alias("r")).distinct()
        provided = graph.where("why = 'requires'").join(members.select(F.col("path").alias("a"), "rollout_id"), "a").join(active, F.col("rollout_id") == F.col("r"), "left_semi").select("a", "b")
        needs = graph.where("why = 'requires'").join(provided, ["a", "b"], "left_anti")
        steps = graph.where("why = 'same_thread'").select(F.col("a").alias("x"), F.col("b").alias("y"), "why").unionByName(needs.select(F.col("b").alias("x"), F.col("a").alias("y"), "why"))
        missing = members.where("history_base IS NOT NULL").join(members.select(F.col("rollout_id").alias("history_base")).distinct(), "history_base", "left_anti")
    else:
        steps = graph.select(F.col("a").alias("x"), F.col("b").alias("y"), "why")
        missing = None
    steps = checkpoint(steps)
    reached = checkpoint(good.select("path", F.lit("selected").alias("reason")))
    edge = reached
    while True:  # breadth first: each round adds the members next to those of the last; ends when a round adds none
        new = steps.join(edge.select(F.col("path").alias("x")), "x").groupBy(F.col("y").alias("path")).agg(F.min(F.concat_ws(" ", "why", "x")).alias("reason"))
        new = new.join(reached.select("path"), "path", "left_anti")
        if operation == "restore":
            new = new.join(flags.where("trashed"), "path", "left_semi")
        edge = checkpoint(new)
        if edge.isEmpty():
            break
        reached = checkpoint(reached.unionByName(edge))
    moved = reached.join(flags, "path").where(eligible).select("path", "reason")
    if missing is not None:
        blockers = blockers.unionByName(moved.join(missing.select("path"), "path", "left_semi").select("path", F.lit("history it needs is gone").alias("blocker")))
    if live is not None:
        known = members.select("path", "agent", F.col("thread_id").alias("session_id"))
        held = moved.join(known, "path").join(live, ["agent", "session_id"]).select("path", F.concat(F.lit("in use: "), "protection").alias("blocker"))
        blockers = blockers.unionByName(held)
    return moved, blockers.distinct()


def merged_groups(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((group, merged) of overlapping groups of one operation, members that opposite operations touch).  groups: group, op, member."""
    first = groups.groupBy("op", "member").agg(F.min("group").alias("b"))  # all groups of a member are tied to its first one
    shared = groups.join(first, ["op", "member"]).where("`group` <> b").select(F.col("group").alias("a"), "b").distinct()
    merged = components(groups.select(F.col("group").alias("v")), shared).select(F.col("v").alias("group"), F.col("root").alias("merged"))
    clash = groups.groupBy("member").agg(F.countDistinct("op").alias("ops")).where("ops > 1").select("member")
    return merged, clash


def skipped_groups(groups: DataFrame, policies: DataFrame) -> DataFrame:
    """(group, member): members that a group's policy 'skip' forbids to add to those chosen; such a group is not carried out.  groups: group,
    member, chosen (named by the rule itself).  policies: group, policy ('include' or 'skip')."""
    return groups.where("NOT chosen").join(policies.where("policy = 'skip'").select("group"), "group", "left_semi").select("group", "member")
