"""Logical histories of rollouts: which file is a thread's current version, and the chain of bounded segments it continues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import normal_path
from threadloom.operators import scans
from threadloom.operators.sessions import first_value
from threadloom.util import checkpoint


def headers(records: DataFrame) -> DataFrame:
    """(path, thread_id, base_id, base_end_ordinal, base_end_byte, mode, branch) from the first meta record of each file.

    records: path, line_no, line.  A bare first line with an id counts as a meta record.
    """
    v = F.try_parse_json("line")
    get = lambda p, t="string": F.try_variant_get(v, p, t)
    meta = records.select(
        "path", "line_no", get("$.type").alias("type"), F.coalesce(get("$.payload.id"), F.when(F.col("line_no") == 1, get("$.id"))).alias("thread_id"),
        get("$.payload.history_base.thread_id").alias("base_id"), get("$.payload.history_base.end_ordinal_exclusive", "bigint").alias("base_end_ordinal"),
        get("$.payload.history_base.end_byte_offset", "bigint").alias("base_end_byte"), get("$.payload.history_mode").alias("mode"), get("$.payload.git.branch").alias("branch"),
    ).where("thread_id IS NOT NULL AND (type = 'session_meta' OR type IS NULL)")
    return meta.groupBy("path").agg(F.min_by(F.struct("thread_id", "base_id", "base_end_ordinal", "base_end_byte", "mode", "branch"), "line_no").alias("h")).select("path", "h.*")


def branch(paginated: Column, has_column: Column, selected: Column, header: Column) -> Column:
    """A paginated thread takes the database's value even if null; others the first that is not null."""
    return F.when(paginated & has_column, selected).otherwise(F.coalesce(selected, header))


def tips(members: DataFrame, selections: DataFrame | None = None) -> DataFrame:
    """(thread_id, path, status): the current version of each thread.

    members: thread_id, rollout_id, path, base_id, trashed.  selections: thread_id, selected_path, paginated.  The selected file by path identity
    (a ``.zst`` ending aside), else the members no sibling continues, else (in a loop) all; several, or a selected paginated file that
    is missing, are ambiguous.
    """
    m = members.withColumn("identity", F.regexp_replace(normal_path(F.col("path")), r"\.zst$", ""))
    if selections is not None:
        s = selections.select("thread_id", F.regexp_replace(normal_path(F.col("selected_path")), r"\.zst$", "").alias("wanted"), "paginated")
        m = m.join(s, "thread_id", "left")
    else:
        m = m.withColumn("wanted", F.lit(None).cast("string")).withColumn("paginated", F.lit(False))
    m = checkpoint(m.withColumn("is_selected", F.coalesce(F.col("identity") == F.col("wanted"), F.lit(False))))
    continued = m.where("base_id IS NOT NULL").select("thread_id", F.col("base_id").alias("rollout_id"), F.col("path").alias("by"))
    ancestors = m.join(continued, ["thread_id", "rollout_id"]).where("path <> by").select("thread_id", "path").distinct().withColumn("is_base", F.lit(True))
    m = m.join(ancestors, ["thread_id", "path"], "left").withColumn("is_base", F.coalesce("is_base", F.lit(False)))
    per = m.groupBy("thread_id").agg(F.bool_or("is_selected").alias("any_selected"), F.bool_or(~F.col("is_base")).alias("any_leaf"), F.bool_or(F.coalesce("paginated", F.lit(False))).alias("authoritative"))
    chosen = m.join(per, "thread_id").where(F.when(F.col("any_selected"), F.col("is_selected")).when(F.col("any_leaf"), ~F.col("is_base")).otherwise(True))
    chosen = chosen.groupBy("thread_id", "identity").agg(F.min_by(F.struct("path", "rollout_id", "any_selected", "authoritative"), F.struct("trashed", "path")).alias("t")).select("thread_id", "t.*")
    count = chosen.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"))
    missing = F.col("authoritative") & ~F.col("any_selected")
    return chosen.join(count, "thread_id").select("thread_id", "path", "rollout_id", F.when((F.col("n") > 1) | missing, "ambiguous").otherwise("complete").alias("status"))


def chains(members: DataFrame, tip: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, seg, rollout_id, segment_path, end_ordinal, end_byte), (path, issue)): each tip's ancestors from the oldest on, with cutoffs.

    Follows history bases a level a round, all tips together; a round's rows are at most the tips.  A base met before is a loop and ends
    its chain, a missing or ambiguous base ends it with an issue.
    """
    by_id = checkpoint(members.groupBy("rollout_id").agg(F.min_by(F.struct("path", "base_id", "base_end_ordinal", "base_end_byte", "trashed"), F.struct("trashed", "path")).alias("m"), F.countDistinct("path").alias("paths")))
    own = members.select("path", "rollout_id", "base_id", "base_end_ordinal", "base_end_byte")
    at = tip.select("path").join(own, "path").select("path", "rollout_id", F.col("path").alias("segment_path"), F.lit(None).cast("bigint").alias("end_ordinal"), F.lit(None).cast("bigint").alias("end_byte"), "base_id", "base_end_ordinal", "base_end_byte", F.array("rollout_id").alias("seen"))
    level = checkpoint(at.withColumn("level", F.lit(0)))
    segments, issues, k = level, None, 0
    while True:
        k += 1
        step = level.where("base_id IS NOT NULL").select("path", F.col("base_id").alias("rollout_id"), F.col("base_end_ordinal").alias("end_ordinal"), F.col("base_end_byte").alias("end_byte"), "seen")
        found = checkpoint(step.join(by_id, "rollout_id", "left").withColumn("issue", F.when(F.array_contains("seen", F.col("rollout_id")), "cyclic history").when(F.col("m").isNull(), "missing history").when(F.col("paths") > 1, "ambiguous history").when(F.col("m.trashed"), "trashed history").when(F.coalesce(F.col("end_ordinal"), F.lit(0)) < 0, "bad cutoff")))
        if found.isEmpty():
            break
        bad = found.where("issue IS NOT NULL").select("path", "issue")
        issues = bad if issues is None else issues.unionByName(bad)
        level = checkpoint(
            found.where("issue IS NULL OR issue = 'trashed history'")
            .select("path", "rollout_id", F.col("m.path").alias("segment_path"), "end_ordinal", "end_byte", "m.base_id", "m.base_end_ordinal", "m.base_end_byte", F.concat("seen", F.array("rollout_id")).alias("seen"), F.lit(k).alias("level"))
        )
        segments = segments.unionByName(level)
    order = Window.partitionBy("path").orderBy(F.desc("level"))
    out = segments.select("path", F.row_number().over(order).alias("seg"), "rollout_id", "segment_path", "end_ordinal", "end_byte")
    none = members.sparkSession.createDataFrame([], "path string, issue string")
    return out, issues if issues is not None else none


def bounded(records: DataFrame, segments: DataFrame) -> DataFrame:
    """(path, seg, line_no, line, flaw): the records of each history in order, cut at each segment's byte and ordinal.

    records: path, line_no, line.  flaw: malformed, missing ordinal where its file has ordinals, or an ordinal that goes back.
    """
    v = F.try_parse_json("line")
    sized = scans.running_sum(records, "path", ["line_no"], F.octet_length("line") + 1, "byte_end").withColumn("ordinal", F.try_variant_get(v, "$.ordinal", "bigint")).withColumn("good", v.isNotNull())
    sized = scans.running_max(sized, "path", ["line_no"], "ordinal", "highest")
    paged = sized.groupBy("path").agg((F.count("ordinal") > 0).alias("paginated"))
    s = segments.select(F.col("path").alias("history"), "seg", F.col("segment_path").alias("path"), "end_ordinal", "end_byte")
    rows = s.join(sized, "path").join(paged, "path")
    inside = (F.col("end_byte").isNull() | (F.col("byte_end") <= F.col("end_byte"))) & (F.col("end_ordinal").isNull() | F.col("ordinal").isNull() | (F.col("ordinal") < F.col("end_ordinal")))
    flaw = F.when(~F.col("good"), "malformed").when(F.col("paginated") & F.col("ordinal").isNull(), "missing ordinal").when(F.col("ordinal") <= F.col("highest"), "ordinal regression")
    return rows.where(inside).select(F.col("history").alias("path"), "seg", "line_no", "line", flaw.alias("flaw"))


def statuses(tip: DataFrame, issues: DataFrame) -> DataFrame:
    """(path, status, issues): ambiguous, incomplete or complete, with at most 16 different issues."""
    per = issues.groupBy("path").agg(F.slice(F.array_sort(F.collect_set("issue")), 1, 16).alias("issues"))
    out = tip.join(per, "path", "left")
    status = F.when(F.col("status") == "ambiguous", "ambiguous").when(F.col("issues").isNotNull(), "incomplete").otherwise("complete")
    return out.select("path", status.alias("status"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))


def thread_names(index: DataFrame) -> DataFrame:
    """(id, thread_name): the last name given in file order.  index: id, thread_name, line_no."""
    return index.where("id IS NOT NULL").groupBy("id").agg(F.max_by("thread_name", "line_no").alias("thread_name"))


def first_headers(records: DataFrame) -> DataFrame:
    """The first record of each file, whatever its kind."""
    return records.groupBy("path").agg(first_value(F.col("line"), F.col("line_no")).alias("line"))
