"""Messages delivered at least once: keep exactly one copy of each.

Identifiers compare trimmed and without letter case.  One aggregation counts them; those held by one row pass, and only the (far fewer)
repeated groups are ranked.  Both parts come from one join of the rows with the repeated identifiers, so rows are shuffled
once.  The ranking is a ``min_by`` aggregation, not a window: a group of any size is reduced in every partition before the
shuffle, so a hot identifier is no hot task.

Defined results: a row may hold two identifiers (message.id, and messageId by isSnapshotUpdate, null counting as false), and stays if it is
the copy to be kept of either; so no message is lost, and an identifier stands in two rows only where each of them is needed for another one.
Rows without an identifier (null or blank) are no copies of each other and all stay; of equal copies exactly one stays, the first by
the order columns (nulls first), ties broken by the hash of the row; an empty table gives an empty result.  Internal
column names start with ``__tl_`` and cannot clash with columns of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ("ingested_at", "row_id")
_KEY = ["__tl_kind", "__tl_ident"]


def normal(ident: Column) -> Column:
    """Trimmed, in lower case; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(ident, r"^[\s ]+|[\s ]+$", "")), F.lit(""))


def identity(rows: DataFrame) -> Column:
    """array<struct<ident, id_kind>>: the identifiers of a row, none to two."""
    snapshot_kind = F.when(F.coalesce("isSnapshotUpdate", F.lit(False)), F.lit("snapshot_update")).otherwise(F.lit("snapshot"))
    both = F.array(
        F.struct(normal(F.col("message.id")).alias("ident"), F.lit("message").alias("id_kind")),
        F.struct(normal(F.col("messageId")).alias("ident"), snapshot_kind.alias("id_kind")),
    )
    return F.filter(both, lambda x: x["ident"].isNotNull())


def identities(rows: DataFrame) -> DataFrame:
    """(ident, id_kind) of every identifier of a row; a row that holds both kinds gives two."""
    return rows.select(F.inline(identity(rows)))


def repeated(rows: DataFrame) -> DataFrame:
    """(ident, id_kind, copies) of the identifiers held by more than one row: the frequency split, which ``once`` ranks by."""
    return identities(rows).groupBy("ident", "id_kind").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def _row(columns: list[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in columns])


def _rank(columns: list[str], order: tuple[str, ...]) -> Column:
    return F.struct(*[F.col(c) for c in order if c in columns], F.xxhash64(F.to_json(_row(columns))))


def _by_identity(rows: DataFrame) -> DataFrame:
    """A row for each identifier of a row, with (__tl_kind, __tl_ident) and whether the row holds two."""
    held = rows.withColumn("__tl_ids", identity(rows)).where(F.size("__tl_ids") > 0)
    named = held.withColumn("__tl_two", F.size("__tl_ids") > 1).withColumn("__tl_id", F.explode("__tl_ids"))
    return named.withColumn("__tl_kind", F.col("__tl_id.id_kind")).withColumn("__tl_ident", F.col("__tl_id.ident")).drop("__tl_ids", "__tl_id")


def _each_row_once(named: DataFrame, columns: list[str], order: tuple[str, ...]) -> DataFrame:
    """Rows that stand here for one identifier, each once though it may stand for two."""
    two = named.where("__tl_two").groupBy(_rank(columns, order).alias("__tl_rank")).agg(F.any_value(_row(columns)).alias("__tl_row")).select("__tl_row.*")
    return named.where("NOT __tl_two").select(columns).unionByName(two)


def _split(rows: DataFrame) -> DataFrame:
    """``_by_identity`` with ``__tl_copies``: null for identifiers that one row holds."""
    again = repeated(rows).select(F.col("id_kind").alias("__tl_kind"), F.col("ident").alias("__tl_ident"), F.col("copies").alias("__tl_copies"))
    return _by_identity(rows).join(again, _KEY, "left")


def _ranked(split: DataFrame, columns: list[str], order: tuple[str, ...]) -> DataFrame:
    kept = [*columns, "__tl_two"]
    groups = split.where("__tl_copies IS NOT NULL").groupBy(_KEY)
    return groups.agg(F.min_by(_row(kept), _rank(columns, order)).alias("__tl_row"), F.count(F.lit(1)).alias("__tl_copies"))


def ranked(rows: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """(ident, id_kind, copies, kept) of each repeated identifier: the row that is kept of its copies."""
    out = _ranked(_split(rows), rows.columns, order)
    return out.select(F.col("__tl_ident").alias("ident"), F.col("__tl_kind").alias("id_kind"), F.col("__tl_copies").alias("copies"), F.col("__tl_row").dropFields("__tl_two").alias("kept"))


def once(rows: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``rows`` with exactly one row of each message."""
    columns = rows.columns
    split = _split(rows)
    kept = [*columns, "__tl_two"]
    single = split.where("__tl_copies IS NULL").select(kept)
    first = _ranked(split, columns, order).select("__tl_row.*")
    return rows.where(F.size(identity(rows)) == 0).unionByName(_each_row_once(single.unionByName(first), columns, order))


def deliver(stored: DataFrame, batch: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The rows of ``batch`` to be appended to ``stored``: those kept of messages that ``stored`` does not hold yet."""
    return deliver_unless(identities(stored), batch, order)


def deliver_unless(held: DataFrame, batch: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``deliver`` against the identifiers (ident, id_kind) that are stored."""
    held = held.select(F.col("id_kind").alias("__tl_kind"), F.col("ident").alias("__tl_ident")).distinct()
    new = once(batch, order)
    fresh = _by_identity(new).join(held, _KEY, "left_anti")
    return new.where(F.size(identity(new)) == 0).unionByName(_each_row_once(fresh, batch.columns, order))
