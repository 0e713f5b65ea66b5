"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from preftable.session import scratch_table_path


def new_path(spark: SparkSession, name: str) -> str:
    """A folder that no other run uses."""
    return scratch_table_path(spark, f"llm-{name}-{uuid.uuid4().hex}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: lineage ends at the files, which lost executors reread."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files behind tables that are written.

    It does so when the driver collects its garbage; a plan just run is garbage only after the
    listeners have seen its end, hence the second turn.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)
