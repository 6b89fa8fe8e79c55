from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators import scans


def test_rows_with_null_keys_and_null_order_stay(spark):
    rows = [(k, o, v) for k in ("a", None) for o, v in ((None, 7), (1, 2), (2, None), (5, 4), (9, 1))]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    w = Window.partitionBy("k").orderBy("o")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select("*", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"), F.max("v").over(before).alias("m"), F.last("v", True).over(upto).alias("l"))
    chunked = scans.running_last(scans.running_max(scans.running_sum(df, "k", ["o"], F.col("v"), "s", 3), "k", ["o"], "v", "m", 3), "k", ["o"], F.col("v"), "l", 3)
    key = lambda r: (r.k or "", -1 if r.o is None else r.o)
    assert sorted(chunked.select(*plain.columns).collect(), key=key) == sorted(plain.collect(), key=key)


def test_a_cluster_needs_a_shared_checkpoint_folder():
    import pytest

    from threadloom.util import ensure_checkpoint_dir

    class Session:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="checkpoint"):
        ensure_checkpoint_dir(Session)
