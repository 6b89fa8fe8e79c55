"""Ordered scans over keyed rows without a task for a whole key.

A key may hold a third of all rows, so a window over a key alone would put these rows into one task.  Here rows are cut into chunks of at most
``size`` places of a numeric order column; windows run over (key, chunk), and a second window over one small row for each
chunk carries the state from chunk to chunk.  Results equal those of the plain window: rows with a null key are one key, and rows whose order
column is null are a chunk of their own and come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIZE = 100_000


def _chunk(order: str, size: int) -> Column:
    return F.floor(F.col(order) / size).cast("bigint")


def _joined(rows: DataFrame, states: DataFrame, by: str) -> DataFrame:
    """Rows with the state of their (key, chunk); null keys and chunks meet their like."""
    states = states.withColumnRenamed(by, "__by").withColumnRenamed("__chunk", "__of")
    return rows.join(states, F.col(by).eqNullSafe(F.col("__by")) & F.col("__chunk").eqNullSafe(F.col("__of"))).drop("__by", "__of")


def running_sum(rows: DataFrame, by: str, order: list[str], value: Column, name: str, size: int = SIZE) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the key up to this one; ``order[0]`` is a number."""
    known = rows.withColumn("__chunk", _chunk(order[0], size)).withColumn("__value", value)
    inside = Window.partitionBy(by, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = known.groupBy(by, "__chunk").agg(F.sum("__value").alias("__total")).select(by, "__chunk", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))
    joined = _joined(known.withColumn("__sum", F.sum("__value").over(inside)), totals, by)
    return joined.withColumn(name, F.coalesce("__sum", F.lit(0)) + F.col("__before")).drop("__chunk", "__value", "__sum", "__before")


def running_max(rows: DataFrame, by: str, order: list[str], value: str, name: str, size: int = SIZE) -> DataFrame:
    """Adds ``name``: the greatest ``value`` of the key before this row; null for its first."""
    known = rows.withColumn("__chunk", _chunk(order[0], size))
    inside = Window.partitionBy(by, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = known.groupBy(by, "__chunk").agg(F.max(value).alias("__top")).select(by, "__chunk", F.max("__top").over(earlier).alias("__before"))
    joined = _joined(known.withColumn("__max", F.max(value).over(inside)), totals, by)
    return joined.withColumn(name, F.greatest("__max", "__before")).drop("__chunk", "__max", "__before")


def running_last(rows: DataFrame, by: str, order: list[str], value: Column, name: str, size: int = SIZE, strict: bool = False) -> DataFrame:
    """Adds ``name``: the last ``value`` that is not null up to this row (``strict``: before it); null where there is none."""
    known = rows.withColumn("__chunk", _chunk(order[0], size)).withColumn("__value", value)
    inside = Window.partitionBy(by, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow)
    earlier = Window.partitionBy(by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = known.groupBy(by, "__chunk").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(*order))).alias("__end"))
    ends = ends.select(by, "__chunk", F.last("__end", ignorenulls=True).over(earlier).alias("__before"))
    joined = _joined(known.withColumn("__last", F.last("__value", ignorenulls=True).over(inside)), ends, by)
    return joined.withColumn(name, F.coalesce("__last", "__before")).drop("__chunk", "__value", "__last", "__before")
