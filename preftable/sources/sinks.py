"""Sinks (§2.1): metric dictionaries, rollout buffers, materialised intermediate tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from preftable.session import scratch_table_path


def prune_raw_columns(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Keep only produced columns (Parquet scans prune the rest automatically)."""
    return df.select(*keep)


def materialise(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    reuse: bool = False,
    inputs: Sequence[str] = (),
    options: Mapping[str, object] | None = None,
) -> DataFrame:
    """Write once as Parquet and read back: cuts lineage and lets later jobs reuse the encoding.

    ``reuse=True`` reads the table at ``path`` if its manifest has the fingerprint of what would be
    written: the schema, the ``options`` it was made with and the files under ``inputs`` (path, length
    and time of change). Anything else there, also a table whose writing was cut off, is written
    anew. ``path`` should be a shared folder (for intermediates, under ``spark.checkpoint.dir``; see
    ``session.scratch_table_path``), never a machine-local temp folder.
    """
    spark = df.sparkSession
    print_ = fingerprint(spark, df.schema.json(), inputs, options or {})
    if reuse and _manifest(spark, path) == print_:
        return spark.read.schema(df.schema).parquet(path)
    df.write.mode(mode).parquet(path)
    # After the rows' commit; Parquet readers pass over names that begin with an underscore. Rows that
    # were added to others have no fingerprint.
    told = print_ if mode == "overwrite" else "appended"
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(_manifest_path(path))
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, schema: str, inputs: Sequence[str], options: Mapping[str, object]) -> str:
    """SHA-256 of schema, options and input files. Files are listed by a Spark scan that reads none of them."""
    files = [0, 0, 0]
    if inputs:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(inputs))
        one = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
        files = [int(x or 0) for x in listing.agg(F.count(F.lit(1)), F.sum("length"), F.sum(one)).first()]
    told = json.dumps({"schema": schema, "files": files, "options": options}, sort_keys=True, default=str)
    return hashlib.sha256(told.encode()).hexdigest()


def table_digest(df: DataFrame) -> str:
    """An order-free digest of a table's rows, to stand for it among the options of a fingerprint."""
    one = F.xxhash64(*df.columns).cast("decimal(38,0)")
    return str(tuple(df.agg(F.count(F.lit(1)), F.sum(one)).first()))


def _manifest_path(path: str) -> str:
    return path.rstrip("/") + "/_manifest"


def _manifest(spark: SparkSession, path: str) -> str | None:
    """The fingerprint of the table at ``path``; None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(_manifest_path(path)).first()
    except AnalysisException:
        return None
    return row[0] if row else None


def write_metrics(df: DataFrame, path: str) -> None:
    """Store metric rows as JSON lines."""
    df.write.mode("overwrite").json(path)


ROLLOUT_BUCKETS = 64


def write_rollouts(df: DataFrame, path: str, mode: str = "append", buckets: int = ROLLOUT_BUCKETS) -> None:
    """Write experience rows so that a buffer that is written again, as by a retried job, is there once.

    Buffers are dealt to ``buckets`` folders, so folders don't grow with their number. ``append`` merges:
    the folders that the new buffers fall in are rewritten from their other buffers' rows and the new
    ones, by dynamic partition overwrite, and no other folder is touched. The merged rows are staged
    first, so nothing that is replaced is still being read. Files are cut by ranges of (bucket, buffer),
    so their number is bounded by the shuffle partitions and the buckets, and a large bucket has several.
    """
    spark = df.sparkSession
    new = df.withColumn("bucket", _bucket(buckets))
    if mode == "append" and _has_rows(spark, path):
        old = spark.read.parquet(path)
        touched = new.select("bucket").distinct()
        again = new.select(F.col("buffer_id").alias("__again")).distinct()
        kept = old.join(touched, "bucket", "left_semi").join(again, F.col("buffer_id").eqNullSafe(F.col("__again")), "left_anti")
        new = new.unionByName(kept.select(*new.columns))
        new = materialise(new, scratch_table_path(spark, f"rollouts-{uuid.uuid4().hex}"))
    ordered = new.repartitionByRange("bucket", "buffer_id").sortWithinPartitions("bucket", "buffer_id")
    kind = "dynamic" if mode == "append" else "static"
    ordered.write.mode("overwrite").option("partitionOverwriteMode", kind).partitionBy("bucket").parquet(path)


def read_rollouts(spark: SparkSession, path: str, buffers: Sequence[int] | None = None, buckets: int = ROLLOUT_BUCKETS) -> DataFrame:
    """The rows of all buffers, or of some of them: then only their folders are read."""
    rows = spark.read.parquet(path)
    if buffers is not None:
        rows = rows.filter(F.col("bucket").isin(sorted({b % buckets for b in buffers})) & F.col("buffer_id").isin(list(buffers)))
    return rows.drop("bucket")


def _bucket(buckets: int) -> Column:
    return F.coalesce(F.pmod(F.col("buffer_id"), F.lit(buckets)), F.lit(0)).cast("int")


def _has_rows(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException:
        return False
