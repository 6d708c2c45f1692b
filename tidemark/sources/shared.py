"""Tables that driver and executors share."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder: under spark.checkpoint.dir of the session, or the warehouse where it names none."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written and read back: what follows starts from files, which outlive any executor."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to many tasks whatever its size. Spark sizes tasks by bytes, so that steps that are dear for each row,
    such as signatures over short rows, would all be one task's work."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of stored steps now: its cleaner acts when the driver collects garbage, which a
    driver with little to do may not do for half an hour. Nothing depends on it but disk; a session without a driver's JVM
    at hand, as in Spark Connect, goes on without."""
    for _ in range(2):
        gc.collect()
        if not hasattr(spark, "_jvm"):
            return
        spark._jvm.System.gc()
        time.sleep(0.3)
