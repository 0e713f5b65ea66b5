"""Token-sequence column functions (§2.4, §2.6). All run inside one row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from preftable.config import IGNORE_INDEX


def _int_array(*values: int) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def truncate_ids(ids: Column, n: int) -> Column:
    """Keep the first ``n - 1`` ids when the list is longer than that."""
    if n < 2:
        raise ValueError("max length must be at least 2")
    return F.slice(ids, 1, n - 1)


def repeat_int(value: int, times: Column) -> Column:
    """``array_repeat`` of an int literal with a non-negative count."""
    return F.array_repeat(F.lit(int(value)), F.greatest(times, F.lit(0)).cast("int"))


def build_sft_sequence(source: Column, target: Column, bos: int, eos: int) -> Column:
    """``source + [bos] + target + [eos]``."""
    return F.concat(source, _int_array(bos), target, _int_array(eos))


def mask_prompt_labels(source: Column, target: Column, bos: int, eos: int) -> Column:
    """``[-100] * len(source) + [bos] + target + [eos]``; BOS is a label."""
    return F.concat(repeat_int(IGNORE_INDEX, F.size(source)), _int_array(bos), target, _int_array(eos))


def right_pad(ids: Column, length: Column, value: int) -> Column:
    """Append ``value`` until the list has ``length`` elements."""
    return F.concat(ids, repeat_int(value, length - F.size(ids)))


def left_pad(ids: Column, length: Column, value: int) -> Column:
    """Prepend ``value`` until the list has ``length`` elements."""
    return F.concat(repeat_int(value, length - F.size(ids)), ids)


def flatten_pair(accepts: Column, rejects: Column) -> Column:
    return F.concat(accepts, rejects)


def unflatten_pair(flat: Column) -> tuple[Column, Column]:
    """Inverse of ``flatten_pair``: cut at ``len // 2``."""
    half = F.floor(F.size(flat) / 2).cast("int")
    return F.slice(flat, 1, half), F.slice(flat, half + 1, F.size(flat) - half)


def attention_mask(ids: Column, pad: int, mode: str = "by_pad", length: Column | None = None) -> Column:
    """1 where the id is not the pad id (reference behaviour), or by position when ``mode='by_length'``.

    With ``by_length`` the first ``length`` positions are 1 and the rest 0, so an unknown token
    that shares its id with pad is not masked.
    """
    if mode == "by_pad":
        return F.transform(ids, lambda x: F.when(x != F.lit(pad), 1).otherwise(0))
    if mode == "by_length":
        if length is None:
            raise ValueError("by_length needs the unpadded length")
        return F.transform(ids, lambda x, i: F.when(i < length, 1).otherwise(0))
    raise ValueError(f"unknown mask mode {mode!r}")


def count_not_pad(ids: Column, pad: int) -> Column:
    return F.size(F.filter(ids, lambda x: x != F.lit(pad)))


def ids_text(ids: Column, sep: str = " ") -> Column:
    """Render an id list as text (used by reports and oracle comparisons)."""
    return F.array_join(ids.cast("array<string>"), sep)
