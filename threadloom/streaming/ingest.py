"""Continuous ingestion: new transcript files as micro-batches, each message stored once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators import delivery


def stream_rows(spark: SparkSession, directory: str, schema: str) -> DataFrame:
    """Rows of Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(directory)


BUCKETS = 256


def store_once(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Stores the rows of each micro-batch whose message is not stored yet, as ``target/batch=<number>``; a batch run again after a failure
    takes the place of its first run.

    The identifiers stored are kept beside the target by a hash, so a batch reads the files of its own identifiers' buckets and
    not the messages stored so far.
    """
    spark, ids = rows.sparkSession, f"{target.rstrip('/')}-ids"

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        named = delivery.identities(batch).withColumn("bucket", F.pmod(F.xxhash64("id_kind", "ident"), F.lit(BUCKETS)).cast("int")).distinct()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ids)
        fresh = delivery.once(batch)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            touched = [r["bucket"] for r in named.select("bucket").distinct().collect()]  # at most BUCKETS numbers
            held = spark.read.option("basePath", ids).parquet(ids).where((F.col("batch") != number) & F.col("bucket").isin(*touched))
            fresh = delivery.deliver_unless(held, batch)
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")
        named.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{ids}/batch={number}")
        batch.unpersist()

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(rows: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Spans of activity of each session, closed after a gap; rows later than the watermark are left out."""
    return (
        rows.where("sessionId IS NOT NULL AND timestamp IS NOT NULL").withWatermark("timestamp", late)
        .groupBy(F.session_window("timestamp", gap).alias("w"), F.lower("sessionId").alias("session_id"))
        .agg(F.count(F.lit(1)).alias("rows")).select("session_id", "w.start", "w.end", "rows")
    )
