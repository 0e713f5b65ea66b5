"""Batch collation: padding to the batch's longest and attention masks (§2.6).

The longest length comes with the rows where ``batching.shuffled_batches`` made the batches (nothing is
shuffled then), else it is a window ``max`` over ``batch_id``. A batch holds ``batch_size`` rows by
construction, so the window partitions are bounded no matter how large the table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from preftable.config import IGNORE_INDEX, SpecialIds
from preftable.functions.arrays import attention_mask, left_pad, right_pad, unflatten_pair
from preftable.operators.batching import WIDTH


def _batch_max(df: DataFrame, col: str, batch_col: str) -> Column:
    known = WIDTH + col
    return F.col(known) if known in df.columns else F.max(F.size(col)).over(Window.partitionBy(batch_col))


def _widths(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(WIDTH)]


def collate_sft(
    df: DataFrame,
    batch_col: str = "batch_id",
    ids_col: str = "input_ids",
    labels_col: str = "label_ids",
    ids: SpecialIds = SpecialIds(),
    mask_mode: str = "by_pad",
) -> DataFrame:
    """Right-pad ids with pad and labels with -100 to the batch max; mask = ``id != pad``."""
    m = _batch_max(df, ids_col, batch_col)
    pad = ids.pad_id
    out = df.withColumn("__n", F.size(ids_col)).withColumn("__m", m)
    out = (
        out.withColumn("input_ids", right_pad(F.col(ids_col), F.col("__m"), pad))
        .withColumn("labels", right_pad(F.col(labels_col), F.col("__m"), IGNORE_INDEX))
    )
    out = out.withColumn("attention_mask", attention_mask(F.col("input_ids"), pad, mask_mode, F.col("__n")))
    drop = [c for c in (ids_col, labels_col) if c not in ("input_ids", "labels")]
    return out.drop("__n", "__m", *_widths(df), *drop)


def collate_pair(
    df: DataFrame,
    batch_col: str = "batch_id",
    ids: SpecialIds = SpecialIds(),
    flat: bool = True,
    mask_mode: str = "by_pad",
) -> DataFrame:
    """Unflatten (when ``flat``) then pad accepts and rejects separately, with two masks."""
    if flat:
        a_ids, r_ids = unflatten_pair(F.col("input_ids"))
        a_lab, r_lab = unflatten_pair(F.col("label_ids"))
        df = (
            df.withColumn("accepts_ids", a_ids)
            .withColumn("accepts_labels", a_lab)
            .withColumn("rejects_ids", r_ids)
            .withColumn("rejects_labels", r_lab)
            .drop("input_ids", "label_ids")
        )
    pad = ids.pad_id
    out = df
    for side in ("accepts", "rejects"):
        n = f"__n_{side}"
        m = f"__m_{side}"
        out = out.withColumn(n, F.size(f"{side}_ids")).withColumn(m, _batch_max(df, f"{side}_ids", batch_col))
        out = (
            out.withColumn(f"{side}_input_ids", right_pad(F.col(f"{side}_ids"), F.col(m), pad))
            .withColumn(f"{side}_labels", right_pad(F.col(f"{side}_labels"), F.col(m), IGNORE_INDEX))
        )
        out = out.withColumn(
            f"{side}_attention_mask", attention_mask(F.col(f"{side}_input_ids"), pad, mask_mode, F.col(n))
        ).drop(f"{side}_ids", n, m)
    return out.drop(*_widths(df))


def collate_prompts_left(
    df: DataFrame, batch_col: str = "batch_id", ids_col: str = "input_ids", ids: SpecialIds = SpecialIds()
) -> DataFrame:
    """Left-pad prompts to the batch max; mask = ``id != pad`` over the padded ids. Labels are not read."""
    pad = ids.pad_id
    out = df.withColumn("__m", _batch_max(df, ids_col, batch_col))
    out = out.withColumn("input_ids", left_pad(F.col(ids_col), F.col("__m"), pad))
    out = out.withColumn("attention_mask", attention_mask(F.col("input_ids"), pad))
    return out.drop("__m", *_widths(df), *([c for c in ("label_ids",) if c in out.columns]))


def collate_blocks(df: DataFrame, batch_col: str = "batch_id", ids_col: str = "input_ids") -> DataFrame:
    """Blocks stack without padding; rows of batches whose blocks differ in length are flagged."""
    w = Window.partitionBy(batch_col)
    return df.withColumn(
        "uniform_length", F.min(F.size(ids_col)).over(w) == F.max(F.size(ids_col)).over(w)
    )


def pad_across_shards(
    df: DataFrame,
    step_col: str = "step",
    ids_col: str = "input_ids",
    mask_col: str = "attention_mask",
    side: str = "right",
    ids: SpecialIds = SpecialIds(),
) -> DataFrame:
    """Pad ids (pad) and masks (0) to the longest over all ranks of a step, on ``side``."""
    pad_fn = {"right": right_pad, "left": left_pad}[side]
    m = F.max(F.size(ids_col)).over(Window.partitionBy(step_col))
    out = df.withColumn("__m", m)
    return (
        out.withColumn(ids_col, pad_fn(F.col(ids_col), F.col("__m"), ids.pad_id))
        .withColumn(mask_col, pad_fn(F.col(mask_col), F.col("__m"), 0))
        .drop("__m")
    )
