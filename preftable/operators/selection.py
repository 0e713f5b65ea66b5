"""Selecting the n smallest rows by a 32-bit hash without sorting or moving them.

The threshold is found by radix: a histogram over the upper 16 bits tells in which of its bins the n-th
row lies, a second one over the lower 16 bits of that bin's rows tells the hash itself. Each histogram has
at most 65,536 rows, whatever the table; the table is read by its key column alone, and nothing of it is
shuffled but these counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin_with(counts: dict[int, int], n: int) -> tuple[int, int]:
    """The bin, in ascending order, in which the n-th row lies, and its place among the bin's rows."""
    for b in sorted(counts):
        if n <= counts[b]:
            return b, n
        n -= counts[b]
    raise ValueError("fewer rows than asked for")


def _histogram(df: DataFrame, digit: Column) -> dict[int, int]:
    return {r["d"]: r["n"] for r in df.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}


def smallest(df: DataFrame, key: str, hashed: Column, n_of: Callable[[int], int]) -> Column:
    """A condition that holds for ``n_of(rows)`` rows: those first in the order of (``hashed``, ``key``).

    ``hashed`` is a whole number from 0 to 2^32 - 1. Rows that share a key fall on one side together, so
    the number is exact where keys are unique. Of rows whose hash is the threshold's the smaller keys are
    taken; distinct keys with one 32-bit hash are few (rows / 2^32 on average) and listed on the driver.
    """
    keys = df.select(F.col(key).alias("k"), hashed.alias("h"))
    upper = _histogram(keys, F.shiftright("h", 16))
    n = n_of(sum(upper.values()))
    if n <= 0:
        return F.lit(False)
    top, left = _bin_with(upper, n)
    lower = _histogram(keys.filter(F.shiftright("h", 16) == top), F.col("h").bitwiseAND(F.lit(65535)))
    low, left = _bin_with(lower, left)
    at = (top << 16) | low
    if left == lower[low]:
        return hashed <= at
    taken = []
    for r in keys.filter(F.col("h") == at).groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("k").asc_nulls_first()).collect():
        if left <= 0:
            break
        taken.append(r["k"])
        left -= r["n"]
    tied = F.col(key).isin([k for k in taken if k is not None])
    if None in taken:
        tied = F.col(key).isNull() | F.coalesce(tied, F.lit(False))
    return (hashed < at) | ((hashed == at) & F.coalesce(tied, F.lit(False)))
