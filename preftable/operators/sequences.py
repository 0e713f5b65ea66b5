"""Labelled sequences, pairs and packed blocks (§2.4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from preftable.config import IGNORE_INDEX, SpecialIds
from preftable.functions.arrays import (
    build_sft_sequence,
    flatten_pair,
    mask_prompt_labels,
    right_pad,
    truncate_ids,
    unflatten_pair,
)
from preftable.operators.encode import packed, unpacked_ids


def build_sft_sequences(
    df: DataFrame,
    source: str = "prompt_ids",
    target: str = "response_ids",
    ids: SpecialIds = SpecialIds(),
    max_prompt_length: int = 256,
    max_response_length: int = 256,
    keep: Sequence[str] = ("example_id",),
) -> DataFrame:
    """Truncate, then ``input_ids = src + [bos] + tgt + [eos]``, labels mask the prompt with -100."""
    src = truncate_ids(F.col(source), max_prompt_length)
    tgt = truncate_ids(F.col(target), max_response_length)
    return df.select(
        *keep,
        build_sft_sequence(src, tgt, ids.bos, ids.eos).alias("input_ids"),
        mask_prompt_labels(src, tgt, ids.bos, ids.eos).alias("label_ids"),
    )


def build_ppo_prompts(
    df: DataFrame,
    source: str = "prompt_ids",
    target: str = "response_ids",
    ids: SpecialIds = SpecialIds(),
    max_prompt_length: int = 256,
    max_response_length: int = 256,
    keep: Sequence[str] = ("example_id",),
) -> DataFrame:
    """``input_ids = src + [bos]``; ``label_ids = tgt + [bos]`` (not aligned; the collator ignores labels)."""
    src = truncate_ids(F.col(source), max_prompt_length)
    tgt = truncate_ids(F.col(target), max_response_length)
    bos = F.array(F.lit(ids.bos))
    return df.select(*keep, F.concat(src, bos).alias("input_ids"), F.concat(tgt, bos).alias("label_ids"))


def build_pair_sequences(
    df: DataFrame,
    source: str = "prompt_ids",
    accepts: str = "chosen_ids",
    rejects: str = "rejected_ids",
    ids: SpecialIds = SpecialIds(),
    max_prompt_length: int = 256,
    max_response_length: int = 256,
    keep: Sequence[str] = ("example_id",),
) -> DataFrame:
    """Chosen and rejected sequences over one shared (truncated) source."""
    src = truncate_ids(F.col(source), max_prompt_length)
    acc = truncate_ids(F.col(accepts), max_response_length)
    rej = truncate_ids(F.col(rejects), max_response_length)
    return df.select(
        *keep,
        build_sft_sequence(src, acc, ids.bos, ids.eos).alias("accepts_ids"),
        mask_prompt_labels(src, acc, ids.bos, ids.eos).alias("accepts_labels"),
        build_sft_sequence(src, rej, ids.bos, ids.eos).alias("rejects_ids"),
        mask_prompt_labels(src, rej, ids.bos, ids.eos).alias("rejects_labels"),
    )


def pad_pair(df: DataFrame, ids: SpecialIds = SpecialIds()) -> DataFrame:
    """Right-pad both sides to the longer of the two: ids with pad, labels with -100."""
    m = F.greatest(F.size("accepts_ids"), F.size("rejects_ids"))
    pad = ids.pad_id
    return (
        df.withColumn("accepts_ids", right_pad(F.col("accepts_ids"), m, pad))
        .withColumn("accepts_labels", right_pad(F.col("accepts_labels"), m, IGNORE_INDEX))
        .withColumn("rejects_ids", right_pad(F.col("rejects_ids"), m, pad))
        .withColumn("rejects_labels", right_pad(F.col("rejects_labels"), m, IGNORE_INDEX))
    )


def flatten_pairs(df: DataFrame, keep: Sequence[str] = ("example_id",)) -> DataFrame:
    """Flat form: ``input_ids = accepts ++ rejects`` and the same for labels."""
    return df.select(
        *keep,
        flatten_pair(F.col("accepts_ids"), F.col("rejects_ids")).alias("input_ids"),
        flatten_pair(F.col("accepts_labels"), F.col("rejects_labels")).alias("label_ids"),
    )


def unflatten_pairs(df: DataFrame, keep: Sequence[str] = ("example_id",)) -> DataFrame:
    """Inverse of ``flatten_pairs`` (cut at ``len // 2``)."""
    a_ids, r_ids = unflatten_pair(F.col("input_ids"))
    a_lab, r_lab = unflatten_pair(F.col("label_ids"))
    keep = [c for c in keep if c not in ("accepts_ids", "accepts_labels", "rejects_ids", "rejects_labels")]
    return df.select(
        *keep,
        a_ids.alias("accepts_ids"),
        a_lab.alias("accepts_labels"),
        r_ids.alias("rejects_ids"),
        r_lab.alias("rejects_labels"),
    )


def pack_blocks(
    df: DataFrame,
    group_cols: Sequence[str],
    order_col: str,
    ids_col: str = "input_ids",
    block_size: int = 512,
) -> DataFrame:
    """Concatenate the ids of each group in ``order_col`` order and cut them into ``block_size`` blocks.

    If a group holds at least ``block_size`` ids the remainder is dropped, otherwise one short block
    stays. Each row is cut into the pieces that fall in each block (by prefix sums of lengths), and
    the pieces are regrouped per block: the shuffle moves pieces, never single tokens. A group is a
    bounded map batch (the reference packs batches of 1,000 rows), so the per-group window is small.
    """
    b = int(block_size)
    if b < 1:
        raise ValueError("block_size must be positive")
    g = list(group_cols)
    n = F.size(F.col(ids_col))
    before = Window.partitionBy(*g).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        df.select(*g, order_col, ids_col)
        .filter(n > 0)
        .withColumn("__st", F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long"))
        .withColumn("__tot", F.sum(n).over(Window.partitionBy(*g)).cast("long"))
        .withColumn("__en", F.col("__st") + n)
    )
    st, en, tot = F.col("__st"), F.col("__en"), F.col("__tot")

    def piece(k):
        lo = F.greatest(st, k * b)
        hi = F.least(en, (k + 1) * b)
        return F.struct(
            k.alias("block_id"),
            lo.alias("__lo"),
            F.slice(F.col(ids_col), (lo - st + 1).cast("int"), (hi - lo).cast("int")).alias("__piece"),
        )

    # Cut the pieces inside the row, then explode them: each emitted row carries only its slice
    # (exploding block ids next to the full array would copy the array once per block).
    blocks_of_row = F.transform(
        F.sequence(F.floor(st / b).cast("long"), F.floor((en - 1) / b).cast("long")), piece
    )
    kept = F.filter(blocks_of_row, lambda p: (tot < b) | (p["block_id"] < F.floor(tot / b)))
    pieces = rows.select(*g, F.inline(kept))
    blocks = pieces.groupBy(*g, "block_id").agg(F.array_sort(F.collect_list(F.struct("__lo", "__piece"))).alias("__p"))
    ids = F.flatten(F.transform(F.col("__p"), lambda x: x["__piece"]))
    return blocks.select(*g, "block_id", ids.alias("input_ids"), ids.alias("label_ids"))


def build_pair_sequence(df: DataFrame, source: str = "prompt_ids", accepts: str = "chosen_ids", rejects: str = "rejected_ids", ids: SpecialIds = SpecialIds(), **kw) -> DataFrame:
    """Survey name for ``build_pair_sequences``: chosen and rejected sequences over one source."""
    return build_pair_sequences(df, source, accepts, rejects, ids, **kw)


def build_ppo_prompt(df: DataFrame, source: str = "prompt_ids", target: str = "response_ids", ids: SpecialIds = SpecialIds(), **kw) -> DataFrame:
    """Survey name for ``build_ppo_prompts``: ``source + [bos]`` and ``target + [bos]``."""
    return build_ppo_prompts(df, source, target, ids, **kw)


def row_starts(lengths: DataFrame, group_cols: Sequence[str], order_col: str, length_col: str = "n_ids") -> DataFrame:
    """Each row's first position in its group's stream and the group's number of ids (``__st``, ``__tot``),
    from row lengths: prefix sums over the rows of a pack group (a bounded map batch)."""
    g = list(group_cols)
    before = Window.partitionBy(*g).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return lengths.select(
        *g,
        order_col,
        F.coalesce(F.sum(length_col).over(before), F.lit(0)).cast("long").alias("__st"),
        F.sum(length_col).over(Window.partitionBy(*g)).cast("long").alias("__tot"),
    )


def pack_blocks_long(
    tokens: DataFrame,
    group_cols: Sequence[str],
    order_col: str,
    pos_col: str = "pos",
    id_col: str = "id",
    block_size: int = 512,
    lengths: DataFrame | None = None,
    length_col: str = "n_ids",
    keep_rest: bool = False,
) -> DataFrame:
    """``pack_blocks`` over long-form tokens ``(group…, order, pos, id)``; same result. ``keep_rest`` keeps
    each group's last, short block as well.

    ``lengths`` (``group…, order, n_ids``), when the caller can compute row lengths cheaply from
    the source (``encode.token_count``), saves counting them from the token table. A caller that has
    the texts' rows joins ``row_starts`` to them and hands tokens with ``__st`` and ``__tot`` in: then
    tokens are shuffled once, by block, and not joined at all.

    Row lengths are a per-row count (map-side combined); each token gets its position in the group's
    stream from its row's start and is regrouped by block as one number (``encode.packed``). No task
    ever holds a whole row's ids, so a single huge text is spread over its blocks.
    """
    b = int(block_size)
    if b < 1:
        raise ValueError("block_size must be positive")
    g = list(group_cols)
    if {"__st", "__tot"} <= set(tokens.columns):
        t = tokens
    else:
        if lengths is None:
            lengths = tokens.groupBy(*g, order_col).agg(F.count(F.lit(1)).alias(length_col))
        t = tokens.join(row_starts(lengths, g, order_col, length_col), [*g, order_col])
    at = F.col("__st") + F.col(pos_col)
    if not keep_rest:
        t = t.filter((F.col("__tot") < b) | (at < F.floor(F.col("__tot") / b) * b))
    numbers = t.select(*g, F.floor(at / b).cast("long").alias("block_id"), packed(F.pmod(at, F.lit(b)), F.col(id_col)).alias("__tok"))
    blocks = numbers.groupBy(*g, "block_id").agg(unpacked_ids(F.collect_list("__tok")).alias("input_ids"))
    return blocks.select(*g, "block_id", "input_ids", F.col("input_ids").alias("label_ids"))
