"""Global and per-group row numbering without a single-partition window.

``Window.orderBy(...)`` without ``partitionBy`` moves every row into one task. Here rows are
range-partitioned on the ordering key instead (so a hot group is spread over many partitions),
numbered inside each partition with ``monotonically_increasing_id`` (partition index in the upper
bits, local position in the lower 33 bits), and shifted by the row count of all preceding
partitions. The offsets table has one row per partition, so its size is bounded by the partition
count and broadcasting it is safe.

The range-partitioned, locally numbered rows are written once to a table in the shared checkpoint
folder (``spark.checkpoint.dir``) and read back: the per-partition counts and the final index then
come from the same stored rows (the upstream plan runs twice at most: range partitioning samples its
input first), and the lineage is cut, so a lost executor re-reads the table instead
of recomputing the pipeline.

The ordering key must be unique (append the row key as a tie breaker); then the numbering is
deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from preftable.session import scratch_table_path

_PID = "__pt_pid"
_MID = "__pt_mid"
_CNT = "__pt_cnt"
_OFF = "__pt_off"


def _as_cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _num_partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions is not None:
        return max(1, int(partitions))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, n)


def with_row_index(
    df: DataFrame,
    order_cols: Sequence[str | Column],
    name: str = "row_idx",
    partitions: int | None = None,
    materialize: bool = True,
) -> DataFrame:
    """Add a 0-based global row index ``name`` in the order of ``order_cols`` (must be unique).

    ``materialize=False`` skips the stored table (the upstream plan then runs twice); use it only
    for cheap inputs.
    """
    order = _as_cols(order_cols)
    if partitions is None and materialize:
        # Let Spark size the range partitions (AQE coalesces adjacent ranges, which keeps their
        # order). Partition ids and local positions are read back from the stored rows, so the
        # counts and the index always describe the same partitioning.
        repartitioned = df.repartitionByRange(*order)
    else:
        repartitioned = df.repartitionByRange(_num_partitions(df, partitions), *order)
    ranged = (
        repartitioned.sortWithinPartitions(*order)
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(_MID, F.monotonically_increasing_id())
    )
    if materialize:
        spark = df.sparkSession
        path = scratch_table_path(spark, f"row-index-{uuid.uuid4().hex}")
        ranged.write.mode("overwrite").parquet(path)
        ranged = spark.read.parquet(path)
    counts = ranged.groupBy(_PID).agg(F.count(F.lit(1)).alias(_CNT))
    # One row per range partition: a bounded table, so the frame without partitionBy is harmless.
    offsets = counts.select(
        _PID,
        F.coalesce(
            F.sum(_CNT).over(Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias(_OFF),
    )
    local = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    return (
        ranged.join(F.broadcast(offsets), _PID)
        .withColumn(name, (F.col(_OFF) + local).cast("long"))
        .drop(_PID, _MID, _OFF)
    )


def with_hash_index(df: DataFrame, hex_col: str, tie_cols: Sequence[str], name: str = "row_idx") -> DataFrame:
    """Add the 0-based index of each row in the order of ``hex_col`` (hexadecimal digits of a uniform hash).

    Rows are numbered inside bins of one four-digit prefix, and a histogram of the bins (at most 65,536
    rows, whatever the table) says how many rows come before each: no sampling, no range partitions.
    For narrow tables that are cheap to read, as they are read twice; ``tie_cols`` order rows of one hash.
    """
    binned = df.withColumn("__pt_bin", F.substring(hex_col, 1, 4))
    counts = binned.groupBy("__pt_bin").agg(F.count(F.lit(1)).alias(_CNT))
    before = Window.orderBy("__pt_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pt_bin", F.coalesce(F.sum(_CNT).over(before), F.lit(0)).alias(_OFF))
    own = F.row_number().over(Window.partitionBy("__pt_bin").orderBy(hex_col, *tie_cols))
    placed = binned.withColumn("__pt_rn", own).join(F.broadcast(offsets), "__pt_bin")
    return placed.withColumn(name, (F.col(_OFF) + F.col("__pt_rn") - 1).cast("long")).drop("__pt_bin", "__pt_rn", _OFF)


def with_group_row_number(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str | Column],
    name: str = "rn",
    partitions: int | None = None,
) -> DataFrame:
    """``row_number() OVER (PARTITION BY group ORDER BY order) - 1`` that tolerates huge groups.

    A plain window puts a whole group in one task; with few groups (a language, a split) that is
    a third of the table in one task. Numbering globally over (group, order) keeps the work spread
    over range partitions; the per-group start is one row per group, joined back on the group key
    (AQE turns it into a broadcast join when the group table is small, as measured at run time).
    """
    idx = "__pt_gidx"
    ranked = with_row_index(df, [*group_cols, *order_cols], name=idx, partitions=partitions)
    starts = ranked.groupBy(*group_cols).agg(F.min(idx).alias("__pt_gstart"))
    return (
        ranked.join(starts, list(group_cols))
        .withColumn(name, F.col(idx) - F.col("__pt_gstart"))
        .drop(idx, "__pt_gstart")
    )
