"""Results kept by fingerprint: what was made before isn't made again.

A store is a folder of numbered snapshots, each the whole table (fingerprint, result, made_in). Spark's writer commits a
snapshot as a whole, so one that a job left unfinished has no _SUCCESS and is never read; its number is used up. The
newest finished one is the store's state. One driver writes a store at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshots(spark: SparkSession, store: str) -> tuple[list[int], int]:
    """(numbers of the finished snapshots, the highest number there is)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return [], 0
    names = [str(s.getPath().getName()) for s in fs.listStatus(path)]
    numbers = sorted(int(n) for n in names if n.isdigit())
    done = [n for n in numbers if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{n}/_SUCCESS"))]
    return done, max(numbers, default=0)


def results(wanted: DataFrame, make: Callable[[DataFrame], DataFrame], store: str) -> DataFrame:
    """wanted with result and reused. wanted has a fingerprint (string); make() turns rows of it into fingerprint and result (string).

    Rows of one fingerprint are made once. Results that nothing wants now are kept for later runs. A null fingerprint has
    no result. A second run over the same rows makes nothing and writes no snapshot.
    """
    spark = wanted.sparkSession
    done, highest = snapshots(spark, store)
    old = spark.read.parquet(f"{store}/{done[-1]}") if done else spark.createDataFrame([], "fingerprint string, result string, made_in long")
    missing = wanted.filter("fingerprint is not null").dropDuplicates(["fingerprint"]).join(old.select("fingerprint"), "fingerprint", "left_anti")
    number = highest + 1
    now = old
    if not done or not missing.isEmpty():
        made = make(missing).select("fingerprint", "result", F.lit(number).cast("long").alias("made_in"))
        old.unionByName(made).write.parquet(f"{store}/{number}")
        now = spark.read.parquet(f"{store}/{number}")
    return wanted.join(now, "fingerprint", "left").withColumn("reused", F.col("made_in") < number).drop("made_in")
