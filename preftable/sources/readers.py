"""Readers (§2.1): JSON directories, explicit train/validation files, text corpora, Parquet."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from preftable.operators.partitioning import spread_small_input

# Superset of the three record layouts. ``output`` is VARIANT so a scalar string and a list of
# strings can be told apart (see ``operators.normalise.normalise_output``).
RAW_SCHEMA = (
    "instruction STRING, input STRING, output VARIANT, prompt STRING, chosen STRING, rejected STRING"
)


def _has_files(spark: SparkSession, path: str, pattern: str) -> bool:
    """Whether the path's own file system (the default one, if it names none) has such files."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{pattern}")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def resolve_source(dataset_dir: str | None, train_file: str | None = None, valid_file: str | None = None) -> str:
    """A directory wins; otherwise both files; otherwise ``ValueError`` before any read."""
    if dataset_dir:
        return "dir"
    if train_file and valid_file:
        return "files"
    raise ValueError("give dataset_dir, or both train_file and validation_file")


def read_json_dir(
    spark: SparkSession, path: str, schema: str = RAW_SCHEMA, multi_line: bool = False, add_file: bool = True
) -> DataFrame:
    """Every ``*.json`` directly under ``path`` (not recursive), with the source file in ``file``."""
    if not _has_files(spark, path, "*.json"):
        raise ValueError(f"no *.json files under {path}")
    df = (
        spark.read.schema(schema)
        .option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", "false")
        .option("multiLine", str(multi_line).lower())
        .json(path)
    )
    return df.withColumn("file", F.col("_metadata.file_path")) if add_file else df


def read_split_files(
    spark: SparkSession, train: str, valid: str, schema: str = RAW_SCHEMA, multi_line: bool = False
) -> DataFrame:
    """Explicit train and validation files → one DataFrame tagged by ``split``."""
    reader = spark.read.schema(schema).option("multiLine", str(multi_line).lower())
    tr = reader.json(train).withColumn("split", F.lit("train")).withColumn("file", F.col("_metadata.file_path"))
    va = reader.json(valid).withColumn("split", F.lit("test")).withColumn("file", F.col("_metadata.file_path"))
    return tr.unionByName(va)


def read_text_dir(spark: SparkSession, path: str, broadcast_pieces: int = 200_000) -> DataFrame:
    """Every ``*.txt`` under ``path``, one row per line: ``(file, line_no, text)``.

    ``line_no`` counts a file's lines from 0 in byte order, however its bytes are split: the lines
    of each piece of a file that a task reads are counted, and a piece's first number is the sum of
    those before it. The text is scanned twice and never shuffled while the pieces (at most files +
    2 x splits) are no more than ``broadcast_pieces``; beyond, the join shuffles by piece.
    """
    if not _has_files(spark, path, "*.txt"):
        raise ValueError(f"no *.txt files under {path}")
    df = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "false").text(path)
    lines = df.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__piece"),
        F.monotonically_increasing_id().alias("__read"),
        F.col("value").alias("text"),
    )
    pieces = lines.groupBy("file", "__piece").agg(F.min("__read").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("file").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")
    pieces = pieces.select("file", "__piece", shift.alias("__shift"))
    if len(df.inputFiles()) + 2 * df.rdd.getNumPartitions() <= broadcast_pieces:
        pieces = F.broadcast(pieces)
    return lines.join(pieces, ["file", "__piece"]).select("file", (F.col("__read") + F.col("__shift")).alias("line_no"), "text")


def read_parquet_table(spark: SparkSession, base: str, name: str, spread: bool = False) -> DataFrame:
    """One driver fixture table (``{base}/{name}.parquet``).

    ``spread`` round-robins a table that has fewer splits than the cluster has cores (see
    ``operators.partitioning.spread_small_input``); large tables are returned as scanned.
    """
    df = spark.read.parquet(os.path.join(base, f"{name}.parquet"))
    return spread_small_input(df) if spread else df


def union_datasets(*dfs: DataFrame) -> DataFrame:
    """UNION ALL by column name; a single input passes through; none is an error."""
    if not dfs:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
