"""Queries of the general training-data operators over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import delivery, drift, flatten, hierarchy
from threadloom.util import checkpoint, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, sf, "basic_session")).select("uuid", "root_uuid", "depth")


def p1_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Every node with its number of descendants, read from its interval (0 on or below loops)."""
    tree = hierarchy.hierarchy(table(spark, sf, "basic_session"))
    return tree.select("uuid", "root_uuid", "depth", F.when(F.col("depth") >= 0, ((F.col("exit") - F.col("entry") - 1) / 2).cast("bigint")).otherwise(0).alias("n_descendants"))


def p1_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The full path of every leaf of a side thread."""
    rows = table(spark, sf, "basic_session")
    tree = checkpoint(hierarchy.hierarchy(rows))
    leaves = tree.where("exit = entry + 1").join(rows.where("isSidechain").select(F.lower("uuid").alias("uuid")).distinct(), "uuid", "left_semi")
    found = hierarchy.paths(tree, leaves.select("uuid"))
    return found.select("uuid", F.array_join("path", "/").alias("path"))


def p1_all_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The full path of every node ('' on or below loops)."""
    found = hierarchy.all_paths(hierarchy.hierarchy(table(spark, sf, "basic_session")))
    return found.select("uuid", F.array_join("path", "/").alias("path"))


def p1_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every descendant of every node, with its distance."""
    return hierarchy.all_descendants(hierarchy.hierarchy(table(spark, sf, "basic_session")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The repeated groups that the operator ranks, each with the one row that is kept."""
    return delivery.ranked(table(spark, sf, "rich_content")).where("kept.row_id IS NOT NULL").select("ident", "id_kind")


def p2_once(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that remain, one of each message."""
    return delivery.once(table(spark, sf, "rich_content")).select("row_id", "batch_id", "type", F.col("message.id").alias("message_id"), F.col("messageId").alias("snapshot_id"), "isSnapshotUpdate")


def p2_deliver(spark: SparkSession, sf: str) -> DataFrame:
    """The first half of the batches as stored, and the rows of the second half that are appended to it."""
    rows = table(spark, sf, "rich_content")
    half = rows.agg(F.floor(F.max("batch_id") / 2).alias("half")).first()["half"] or 0
    stored = delivery.once(rows.where(F.col("batch_id") <= half))
    appended = delivery.deliver(stored, rows.where(F.col("batch_id") > half))
    return stored.select("row_id", "batch_id", F.lit(False).alias("appended")).unionByName(appended.select("row_id", "batch_id", F.lit(True).alias("appended")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.changes(table(spark, sf, "rollout_raw"))


def _all_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "rollout_raw").select(F.lit("rollout_raw").alias("src_table"), "file_id", "line_no", "line")
    for name in ("old_format", "new_format", "latest_format"):
        lines = lines.unionByName(drift.as_lines(table(spark, sf, name), name))
    return lines


def p3_unified(spark: SparkSession, sf: str) -> DataFrame:
    """Every record of all formats in one table."""
    return drift.unified(_all_lines(spark, sf))


def p3_branches(spark: SparkSession, sf: str) -> DataFrame:
    """Of the unified table: kinds, and the typed branches of two fields whose type drifts, one inside an object."""
    wide = drift.unified(_all_lines(spark, sf), {"arguments": ("object", "string"), "sandbox_policy.network_access": ("boolean", "string")})
    names = ("arguments", "arguments__object", "arguments__string", "sandbox_policy.network_access", "sandbox_policy.network_access__boolean", "sandbox_policy.network_access__string")
    columns = [(F.col(f"`{c}`") if c in wide.columns else F.lit(None)).cast("string").alias(c.replace("sandbox_policy.", "")) for c in names]
    return wide.select("src_table", "src_file_id", "src_line_no", "record_kind", *columns)


def p3_fused(spark: SparkSession, sf: str) -> DataFrame:
    """The union schema of all formats, with every alternative type of a field."""
    return drift.fused(_all_lines(spark, sf).withColumn("producer", F.col("src_table")).withColumn("file_seq", F.lit(0)))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return flatten.nodes(table(spark, sf, "rich_content"), body=False).select("row_id", "node_path", "parent_path")


def p4_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every object with its text."""
    return flatten.nodes(table(spark, sf, "rich_content"))


def p4_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The typed block table."""
    return flatten.blocks(table(spark, sf, "rich_content"))


QUERIES = {f.__name__: f for f in (p1_found, p1_intervals, p1_paths, p1_all_paths, p1_descendants, p2_found, p2_once, p2_deliver, p3_found, p3_unified, p3_branches, p3_fused, p4_found, p4_nodes, p4_blocks)}

_TREE = """
WITH RECURSIVE n AS (
  SELECT lower(uuid) AS uuid, lower(arg_min(parentUuid, row_id)) AS p FROM basic_session WHERE uuid IS NOT NULL GROUP BY 1
), n2 AS (
  SELECT n.uuid, CASE WHEN q.uuid IS NULL THEN NULL ELSE n.p END AS p FROM n LEFT JOIN n q ON n.p = q.uuid
), t AS (
  SELECT uuid, uuid AS root_uuid, 0 AS depth FROM n2 WHERE p IS NULL
  UNION ALL SELECT n2.uuid, t.root_uuid, t.depth + 1 FROM n2 JOIN t ON n2.p = t.uuid
)"""

_IDENTS = r"""
WITH i AS (
  SELECT lower(regexp_replace(message.id, '^\s+|\s+$', '', 'g')) AS ident, 'message' AS id_kind, row_id FROM rich_content
  UNION ALL
  SELECT lower(regexp_replace(messageId, '^\s+|\s+$', '', 'g')), CASE WHEN coalesce(isSnapshotUpdate, false) THEN 'snapshot_update' ELSE 'snapshot' END, row_id
  FROM rich_content
)"""

ORACLE = {
    "p1_found": _TREE + " SELECT uuid, root_uuid, depth FROM t UNION ALL SELECT uuid, '' AS root_uuid, -1 AS depth FROM n2 WHERE uuid NOT IN (SELECT uuid FROM t)",
    "p1_intervals": _TREE
    + """, up AS (
  SELECT uuid, p FROM n2 WHERE uuid IN (SELECT uuid FROM t) AND p IS NOT NULL
  UNION ALL SELECT up.uuid, n2.p FROM up JOIN n2 ON up.p = n2.uuid WHERE n2.p IS NOT NULL
), d AS (SELECT p AS uuid, count(*) AS k FROM up GROUP BY 1)
SELECT t.uuid, root_uuid, depth, CAST(coalesce(k, 0) AS BIGINT) AS n_descendants FROM t LEFT JOIN d ON t.uuid = d.uuid
UNION ALL SELECT uuid, '' AS root_uuid, -1 AS depth, CAST(0 AS BIGINT) AS n_descendants FROM n2 WHERE uuid NOT IN (SELECT uuid FROM t)""",
    "p1_paths": _TREE
    + """, k AS (SELECT DISTINCT p FROM n2 WHERE p IS NOT NULL), leaves AS (
  SELECT DISTINCT lower(uuid) AS uuid FROM basic_session WHERE isSidechain AND uuid IS NOT NULL AND lower(uuid) IN (SELECT uuid FROM t) AND lower(uuid) NOT IN (SELECT p FROM k)
), w AS (
  SELECT uuid, uuid AS at, uuid AS path FROM leaves
  UNION ALL SELECT w.uuid, n2.p, n2.p || '/' || w.path FROM w JOIN n2 ON w.at = n2.uuid WHERE n2.p IS NOT NULL
)
SELECT uuid, arg_max(path, length(path)) AS path FROM w GROUP BY 1""",
    "p1_all_paths": _TREE
    + """, w AS (
  SELECT uuid, uuid AS path FROM n2 WHERE p IS NULL
  UNION ALL SELECT n2.uuid, w.path || '/' || n2.uuid FROM n2 JOIN w ON n2.p = w.uuid
)
SELECT uuid, path FROM w UNION ALL SELECT uuid, '' AS path FROM n2 WHERE uuid NOT IN (SELECT uuid FROM w)""",
    "p1_descendants": _TREE
    + """, up AS (
  SELECT uuid AS descendant, p AS uuid, 1 AS distance FROM n2 WHERE uuid IN (SELECT uuid FROM t) AND p IS NOT NULL
  UNION ALL SELECT up.descendant, n2.p, up.distance + 1 FROM up JOIN n2 ON up.uuid = n2.uuid WHERE n2.p IS NOT NULL
)
SELECT uuid, descendant, distance FROM up""",
    "p2_found": _IDENTS + " SELECT ident, id_kind FROM i WHERE ident <> '' GROUP BY 1, 2 HAVING count(*) > 1",
    "p2_once": r"""
WITH k AS (SELECT row_id, batch_id, type, message.id AS message_id, messageId AS snapshot_id, isSnapshotUpdate, ingested_at,
    nullif(lower(regexp_replace(message.id, '^\s+|\s+$', '', 'g')), '') AS m, nullif(lower(regexp_replace(messageId, '^\s+|\s+$', '', 'g')), '') AS s, coalesce(isSnapshotUpdate, false) AS u FROM rich_content),
f AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY ingested_at NULLS FIRST, row_id) AS a, row_number() OVER (PARTITION BY s, u ORDER BY ingested_at NULLS FIRST, row_id) AS b FROM k)
SELECT row_id, batch_id, type, message_id, snapshot_id, isSnapshotUpdate FROM f WHERE m IS NULL AND s IS NULL OR m IS NOT NULL AND a = 1 OR s IS NOT NULL AND b = 1""",
    "p2_deliver": r"""
WITH r AS (
  SELECT row_id, batch_id, ingested_at, batch_id > (SELECT floor(max(batch_id) / 2) FROM rich_content) AS appended,
    nullif(lower(regexp_replace(message.id, '^\s+|\s+$', '', 'g')), '') AS m, nullif(lower(regexp_replace(messageId, '^\s+|\s+$', '', 'g')), '') AS s, coalesce(isSnapshotUpdate, false) AS u FROM rich_content
), k AS (SELECT *, CASE WHEN m IS NOT NULL THEN 'message' WHEN u THEN 'snapshot_update' ELSE 'snapshot' END AS kind, coalesce(m, s) AS ident FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY kind, ident, appended ORDER BY ingested_at NULLS FIRST, row_id) AS place FROM k)
SELECT row_id, batch_id, appended FROM f WHERE ident IS NULL
  OR place = 1 AND NOT (appended AND EXISTS (SELECT 1 FROM k x WHERE NOT x.appended AND x.kind = f.kind AND x.ident = f.ident))""",
    "p4_blocks": """
SELECT row_id, 'content[' || (place - 1) || ']' AS node_path, CAST(place - 1 AS INT) AS place, b.type AS type, b.text AS text, b.thinking AS thinking, b.name AS name, b.id AS id,
       b.tool_use_id AS tool_use_id, b.is_error AS is_error, b.input AS input
FROM (SELECT row_id, unnest(message.content) AS b, unnest(range(1, len(message.content) + 1)) AS place FROM rich_content) WHERE b IS NOT NULL""",
    "p4_found": r"""
WITH e AS (SELECT row_id, unnest(message.content) AS b, unnest(range(len(message.content))) AS i FROM rich_content),
k AS (SELECT * FROM e WHERE b IS NOT NULL),
c AS (SELECT row_id, i, unnest(range(len(b.content))) AS j, unnest(b.content) AS x FROM k),
o AS (SELECT row_id, i, t.fullkey AS f FROM (SELECT row_id, i, b.input AS raw FROM k WHERE json_valid(b.input)) v, json_tree(v.raw) t WHERE t.type = 'OBJECT' AND t.fullkey LIKE '%]'),
q AS (SELECT row_id, i, substr(f, 2) AS f, substr(regexp_extract(regexp_replace(f, '\[\d+\]$', ''), '^(.*\])', 1), 2) AS up FROM o)
SELECT row_id, 'content[' || i || ']' AS node_path, '' AS parent_path FROM k
UNION ALL SELECT row_id, 'content[' || i || '].content[' || j || ']', 'content[' || i || ']' FROM c WHERE x IS NOT NULL
UNION ALL SELECT row_id, 'content[' || i || '].input' || f, 'content[' || i || ']' || CASE WHEN up = '' THEN '' ELSE '.input' || up END FROM q""",
    "p3_branches": r"""
WITH l AS (
  SELECT 'rollout_raw' AS src, file_id, line_no, CAST(line AS JSON) AS j FROM rollout_raw WHERE json_valid(line)
  UNION ALL SELECT 'old_format', file_id, line_no, to_json(struct_pack(record_type, type, arguments)) FROM old_format
  UNION ALL SELECT 'new_format', file_id, line_no, to_json(struct_pack(type, payload)) FROM new_format
  UNION ALL SELECT 'latest_format', file_id, line_no, to_json(struct_pack(type, payload)) FROM latest_format
), r AS (SELECT src, file_id, line_no, coalesce(nullif(j ->> '$.payload.type', ''), nullif(j ->> '$.type', ''), nullif(j ->> '$.record_type', ''), 'session_meta') AS kind,
  CASE WHEN json_type(j, '$.payload') = 'OBJECT' THEN j -> '$.payload' ELSE j END AS b FROM l WHERE json_type(j) = 'OBJECT'),
v AS (SELECT *, b ->> '$.arguments' AS a, json_type(b, '$.arguments') AS ty, b ->> '$.sandbox_policy.network_access' AS n, json_type(b, '$.sandbox_policy.network_access') AS nt FROM r)
SELECT src AS src_table, file_id AS src_file_id, line_no AS src_line_no, kind AS record_kind, a AS arguments, CASE WHEN ty = 'OBJECT' THEN a END AS arguments__object, CASE WHEN ty = 'VARCHAR' THEN a END AS arguments__string,
  n AS network_access, CASE WHEN nt = 'BOOLEAN' THEN n END AS network_access__boolean, CASE WHEN nt = 'VARCHAR' THEN n END AS network_access__string FROM v""",
    "p3_fused": r"""
WITH l AS (
  SELECT 'rollout_raw' AS src, file_id, CAST(line AS JSON) AS j FROM rollout_raw WHERE json_valid(line)
  UNION ALL SELECT 'old_format', file_id, to_json(struct_pack(record_type, type, id, timestamp, instructions, role, content, summary, encrypted_content, name, arguments, call_id, output)) FROM old_format
  UNION ALL SELECT 'new_format', file_id, to_json(struct_pack(timestamp, type, payload)) FROM new_format
  UNION ALL SELECT 'latest_format', file_id, to_json(struct_pack(timestamp, type, ordinal, payload)) FROM latest_format
),
r AS (SELECT src, file_id, coalesce(nullif(j ->> '$.payload.type', ''), nullif(j ->> '$.type', ''), nullif(j ->> '$.record_type', ''), 'session_meta') AS kind,
  CASE WHEN json_type(j, '$.payload') = 'OBJECT' THEN j -> '$.payload' ELSE j END AS body FROM l WHERE json_type(j) = 'OBJECT'),
g AS (SELECT DISTINCT src, file_id, kind, substr(t.fullkey, 3) AS f,
  CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS ty
  FROM r, json_tree(r.body) t WHERE t.fullkey <> '$' AND t.fullkey NOT LIKE '%[%' AND t.type <> 'NULL' AND t.fullkey NOT IN ('$.type', '$.record_type'))
SELECT kind AS record_kind, f AS field_path, list_sort(list(DISTINCT ty)) AS types, count(DISTINCT (src, file_id)) AS files FROM g GROUP BY 1, 2""",
    "p3_found": r"""
WITH l AS (SELECT file_id, producer, file_seq, CAST(line AS JSON) AS j FROM rollout_raw WHERE json_valid(line)),
r AS (SELECT file_id, producer, file_seq, coalesce(nullif(j ->> '$.payload.type', ''), nullif(j ->> '$.type', ''), nullif(j ->> '$.record_type', ''), 'session_meta') AS kind,
  CASE WHEN json_type(j, '$.payload') = 'OBJECT' THEN j -> '$.payload' ELSE j END AS body FROM l WHERE json_type(j) = 'OBJECT'),
g AS (SELECT DISTINCT r.file_id, r.kind, substr(t.fullkey, 3) AS f, regexp_replace(substr(t.fullkey, 3), '[^.]*$', '') AS up, t.atom AS v,
  CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS ty
  FROM r, json_tree(r.body) t WHERE t.fullkey <> '$' AND t.fullkey NOT LIKE '%[%' AND t.type <> 'NULL' AND t.fullkey NOT IN ('$.type', '$.record_type')),
fk AS (SELECT producer, kind, file_seq, max(file_id) AS file_id FROM r GROUP BY 1, 2, 3),
p AS (SELECT kind, file_id, lag(file_id) OVER (PARTITION BY producer, kind ORDER BY file_seq) AS before FROM fk),
d AS (SELECT file_id, kind, f, up, array_to_string(list_sort(list(DISTINCT ty)), ',') AS ty FROM g GROUP BY 1, 2, 3, 4),
m AS (SELECT coalesce(n.kind, o.kind) AS kind, coalesce(n.file_id, o.file_id) AS file_id, coalesce(n.before, o.before) AS before, coalesce(n.f, o.f) AS f, coalesce(n.up, o.up) AS up, n.ty AS nt, o.ty AS ot
  FROM (SELECT p.kind, p.file_id, p.before, d.f, d.up, d.ty FROM p JOIN d ON d.file_id = p.file_id AND d.kind = p.kind WHERE p.before IS NOT NULL) n
  FULL OUTER JOIN (SELECT p.kind, p.file_id, p.before, d.f, d.up, d.ty FROM p JOIN d ON d.file_id = p.before AND d.kind = p.kind) o ON n.kind = o.kind AND n.file_id = o.file_id AND n.f = o.f),
c AS (SELECT m.*, CASE WHEN ot IS NULL THEN 'added' WHEN nt IS NULL THEN 'removed' WHEN nt <> ot THEN 'retyped' END AS change FROM m
  WHERE up = '' OR EXISTS (SELECT 1 FROM m x WHERE x.kind = m.kind AND x.file_id = m.file_id AND x.f || '.' = m.up AND contains(x.nt, 'object') AND contains(x.ot, 'object'))),
s AS (SELECT a.kind, a.file_id, a.f AS new_f, b.f AS old_f, count(*) AS n FROM c a JOIN c b ON a.kind = b.kind AND a.file_id = b.file_id AND a.up = b.up AND a.change = 'added' AND b.change = 'removed'
  JOIN g x ON x.file_id = a.file_id AND x.kind = a.kind AND x.f = a.f JOIN g y ON y.file_id = a.before AND y.kind = a.kind AND y.f = b.f AND y.ty = x.ty AND y.v = x.v WHERE x.ty IN ('string', 'number') GROUP BY 1, 2, 3, 4),
w AS (SELECT *, row_number() OVER (PARTITION BY kind, file_id, new_f ORDER BY n DESC, old_f) AS i, row_number() OVER (PARTITION BY kind, file_id, old_f ORDER BY n DESC, new_f) AS k FROM s),
u AS (SELECT * FROM w WHERE i = 1 AND k = 1)
SELECT file_id, kind AS record_kind, f AS field_path, change FROM c WHERE change IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM u WHERE u.kind = c.kind AND u.file_id = c.file_id AND (u.new_f = c.f AND change = 'added' OR u.old_f = c.f AND change = 'removed'))
UNION ALL SELECT file_id, kind, new_f, 'renamed' FROM u""",
}
