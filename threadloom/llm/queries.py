"""Queries of the operators on texts over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import conversations, leakage, packing, pii, reading
from threadloom.util import table


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return pii.texts(table(spark, sf, "basic_session"), table(spark, sf, "new_format"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.tagged(_texts(spark, sf)).select("src_table", "row_id", F.explode("types").alias("pii_type"))


def p5_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with typed placeholders for what was found."""
    return pii.tagged(_texts(spark, sf), redacted=True).select("src_table", "row_id", F.array_join("types", ",").alias("types"), "text")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.faults(table(spark, sf, "basic_session"))


def p6_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of the conversations kept, in order."""
    return conversations.conversations(table(spark, sf, "basic_session"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that take more than one container: those with a part after the first."""
    packed = packing.pack(packing.sizes(table(spark, sf, "documents")))
    return packed.where("part > 0").select("doc_id").distinct()


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every document and part."""
    return packing.pack(packing.sizes(table(spark, sf, "documents")))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers by how full they are, in hundredths of the capacity."""
    packed = packing.pack(packing.sizes(table(spark, sf, "documents")))
    return packed.groupBy("container").agg(F.sum("tokens").alias("tokens")).groupBy(F.floor(F.col("tokens") * 100 / packing.CAPACITY).alias("percent")).agg(F.count(F.lit(1)).alias("containers"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """For each test item, the number of documents that hold it."""
    hits = leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.when(F.col("errors") == 0, 1).otherwise(0)).alias("exact"))


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading.levels(table(spark, sf, "documents"), table(spark, sf, "level_ratings"), table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).where("english AND level >= 3.5").select("doc_id")


def p9_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The level of every English document with prose."""
    return _levels(spark, sf).where("english AND level IS NOT NULL").select("doc_id", "n_words", F.round("level", 2).alias("level"))


QUERIES = {f.__name__: f for f in (p5_found, p5_redacted, p6_found, p6_conversations, p7_found, p7_containers, p7_fill, p8_found, p8_items, p9_found, p9_levels)}

_SESSIONS = r"""
WITH RECURSIVE r AS (
  SELECT row_id, lower(sessionId) AS session, lower(uuid) AS uuid, lower(parentUuid) AS p, coalesce(isSidechain, false) AS side, coalesce(isMeta, false) AS meta,
         type, CASE WHEN message.role IN ('user', 'assistant') THEN message.role ELSE type END AS role, message.content AS content, timestamp FROM basic_session
), n AS (SELECT uuid, arg_min(coalesce(p, ''), row_id) AS p, min(row_id) AS o FROM r WHERE uuid IS NOT NULL GROUP BY 1),
good AS (SELECT uuid FROM n WHERE p = '' UNION ALL SELECT n.uuid FROM n JOIN good ON n.p = good.uuid),
m AS (
  SELECT DISTINCT ON (uuid) uuid, session, p, role, row_id, timestamp, content,
         (content IS NULL OR regexp_replace(content, '^\s+|\s+$', '', 'g') IN ('', '[]', '""')) AS blank
  FROM r WHERE session IS NOT NULL AND uuid IS NOT NULL AND type IN ('user', 'assistant') AND NOT side AND NOT meta ORDER BY uuid, row_id
), th AS (SELECT DISTINCT ON (uuid) uuid, session, p FROM r WHERE uuid IS NOT NULL AND session IS NOT NULL AND NOT side AND (type = 'system' OR meta) ORDER BY uuid, row_id),
hung AS (
  SELECT session, p AS uuid FROM m WHERE role = 'assistant' AND NOT blank AND p IS NOT NULL
  UNION SELECT th.session, th.p FROM hung JOIN th ON hung.uuid = th.uuid AND hung.session = th.session WHERE th.p IS NOT NULL
), s AS (
  SELECT x.session, coalesce(bool_or(NOT m.blank), false) AS said, coalesce(bool_or(m.uuid NOT IN (SELECT uuid FROM good)), false) AS broken,
         coalesce(bool_or(m.role = 'user' AND (m.session, m.uuid) NOT IN (SELECT session, uuid FROM hung)), false) AS unanswered
  FROM (SELECT DISTINCT session FROM r WHERE session IS NOT NULL) x LEFT JOIN m ON m.session = x.session GROUP BY 1
)"""

ORACLE = {
    # Words and marks are fewer than subword tokens; between them and a container's size lies a wide gap, so they give the same list.
    "p7_found": r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) > 2048",
    "p6_found": f"{_SESSIONS} SELECT session AS session_id, CASE WHEN NOT said THEN 'empty' WHEN broken THEN 'broken' ELSE 'no_reply' END AS fault FROM s WHERE NOT said OR broken OR unanswered",
    # A turn's way from the root, as the delivery places of the rows on it: ways in order are the tree a branch at a time.
    "p6_conversations": f"""{_SESSIONS},
w AS (SELECT uuid, uuid AS root, [o] AS way FROM n WHERE p = '' OR p NOT IN (SELECT uuid FROM n) UNION ALL SELECT n.uuid, w.root, list_append(w.way, n.o) FROM n JOIN w ON n.p = w.uuid),
t AS (SELECT m.*, w.root, w.way FROM m JOIN w ON m.uuid = w.uuid WHERE NOT m.blank AND m.session IN (SELECT session FROM s WHERE said AND NOT broken AND NOT unanswered)),
g AS (SELECT session, root, min(coalesce(timestamp, TIMESTAMP '9999-01-01')) AS began, arg_max(way, (coalesce(timestamp, TIMESTAMP '0001-01-01'), row_id)) AS last, arg_min(row_id, (coalesce(timestamp, TIMESTAMP '9999-01-01'), row_id)) AS lead FROM t GROUP BY 1, 2)
SELECT t.session AS session_id, row_number() OVER (PARTITION BY t.session ORDER BY began, lead, t.root, way) AS turn_no, way = last[1:len(way)] AS active, role AS speaker, row_id, uuid, timestamp, content
FROM t JOIN g ON t.session = g.session AND t.root = g.root""",
}
