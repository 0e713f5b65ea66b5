"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_small_input(df: DataFrame, factor: int = 2) -> DataFrame:
    """Round-robin a small input over the cluster's cores before heavy per-row work.

    A small table stored as one Parquet row group is read by a single task, so tokenising it
    uses one core. When the input has fewer splits than ``factor`` × the default parallelism it
    is small by construction (splits are at most ``spark.sql.files.maxPartitionBytes``), so the
    extra shuffle is cheap; large inputs already have many splits and are left alone.

    Call it on a file scan (``spark.read...``): counting the splits of a scan is file listing
    only, whereas on a plan with shuffles it would run those stages.
    """
    try:
        target = df.sparkSession.sparkContext.defaultParallelism * factor
        splits = df.rdd.getNumPartitions()
    except Exception:  # e.g. Spark Connect sessions expose no RDD API: leave the input as is
        return df
    return df.repartition(target) if splits < target else df
