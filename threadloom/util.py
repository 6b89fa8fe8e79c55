"""Helpers shared by the operators: table access, durable checkpoints and distributed numbering."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names in ``spark.checkpoint.dir``.  Only a session of one machine (master ``local``), as in tests, may
    leave it unset; on a cluster that is an error, since a folder of one machine would not outlive an executor."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or "file://" + os.path.join(tempfile.gettempdir(), "threadloom-checkpoints"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def dealt(df: DataFrame) -> DataFrame:
    """``df``, dealt out to as many tasks as the session asks for in ``spark.threadloom.scan.tasks``; as it is where that is unset.

    Meant for one small file of a single row group, which only one task can read.  A table of many files is not to be shuffled for it, so
    nothing is done by itself.  Rows are the same either way."""
    asked = int(df.sparkSession.conf.get("spark.threadloom.scan.tasks", "0"))
    return df.repartition(asked) if asked > 0 else df


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with consecutive numbers from 0 in a global order, without a single-task window.

    Rows are range-partitioned and sorted once and kept in a checkpoint; a row's number is its place in its partition plus the rows
    in the partitions before (one small row for each partition is broadcast: bounded by the number of partitions).
    The order must be total, else the numbers of ties depend on the run (they stay consecutive and unique).
    """
    spark = df.sparkSession
    laid = checkpoint(df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order))
    place = laid.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    counts = place.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).collect()
    before, offsets = 0, []
    for part, n in sorted((r["__part"], r["__n"]) for r in counts):
        offsets.append((part, before))
        before += n
    if not offsets:
        return laid.withColumn(name, F.lit(0).cast("bigint"))
    small = spark.createDataFrame(offsets, "__part bigint, __before bigint")
    return (
        place.join(F.broadcast(small), "__part")
        .withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__at", "__part", "__before")
    )
