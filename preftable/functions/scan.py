"""Linear recurrences over arrays and tables as scans of affine maps.

``y_t = x_t + c·y_{t+1}`` is a suffix scan of the maps ``y -> x + c·y``; two in a row are one map again
(``(a, b)`` followed by ``(a', b')`` is ``(a·a', b + a·b')``), so pieces can be folded on their own and
joined by what the first element of each sends back.

Inside a row an array is cut from its end in blocks of ``BLOCK`` values. A fold over a block copies at
most ``BLOCK`` values a step, whatever the array's length; the values that the blocks send back are
scanned in the same way, with ``c`` to the power ``BLOCK`` (three levels hold 32,768 values), so the work
is linear. The last block of an array, which nothing follows, has exactly the plain recurrence's values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once, however often the body reads it (higher-order functions are not shared)."""
    return F.get(F.transform(F.array(value), body), 0)


def _fold(x: Column, c: float) -> Column:
    """``y_t = x_t + c·y_{t-1}`` by appending; for short arrays."""
    empty = F.array().cast("array<double>")
    return F.aggregate(x, empty, lambda acc, v: F.concat(acc, F.array(v + F.lit(c) * F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))))


def prefix_scan(x: Column, c: float, levels: int = 3) -> Column:
    """``y_t = x_t + c·y_{t-1}`` (``y_{-1} = 0``) over an ARRAY<DOUBLE>, in linear work."""
    if levels == 1:
        return _fold(x, c)

    def joined(blocks: Column, carries: Column) -> Column:
        def one(block: Column, k: Column) -> Column:
            carry = F.get(carries, k - 1)
            return F.when(k == 0, block).otherwise(F.transform(block, lambda v, i: v + F.pow(F.lit(c), (i + 1).cast("double")) * carry))

        return F.flatten(F.transform(blocks, one))

    def cut(whole: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(whole), F.lit(1)), F.lit(BLOCK))
        return F.transform(starts, lambda s: _fold(F.slice(whole, s, F.lit(BLOCK)), c))

    def sent(blocks: Column) -> Column:
        # Every block but the last is full, so one constant takes a value across a block.
        last = F.transform(blocks, lambda b: F.coalesce(F.try_element_at(b, F.lit(-1)), F.lit(0.0)))
        return prefix_scan(last, c**BLOCK, levels - 1)

    return let(x, lambda whole: let(cut(whole), lambda blocks: let(sent(blocks), lambda carries: joined(blocks, carries))))


def suffix_scan(x: Column, c: float) -> Column:
    """``y_t = x_t + c·y_{t+1}`` (0 past the end) over an ARRAY<DOUBLE>, in linear work."""
    return F.reverse(prefix_scan(F.reverse(x), c))


def suffix_carries(maps: DataFrame, key: str, at: str, a: str, b: str, out: str, fan: int = 1024, levels: int = 2) -> DataFrame:
    """``key, at, out``: the value that reaches each affine map ``y -> b + a·y`` of a key from the maps after it.

    ``at`` orders a key's maps. Runs of ``fan`` maps are composed to one, these again, ``levels`` times,
    and only what is left then (one in ``fan ** levels``) meets in one row of a key; the values are
    handed down the same way.
    """
    item = F.struct(F.col(at).alias("at"), F.col(a).alias("a"), F.col(b).alias("b"))
    if levels == 0:
        runs = maps.groupBy(F.col(key)).agg(F.array_sort(F.collect_list(item)).alias("__run")).withColumn("__in", F.lit(0.0))
    else:
        runs = maps.groupBy(F.col(key), F.floor(F.col(at) / fan).cast("long").alias("__up")).agg(F.array_sort(F.collect_list(item)).alias("__run"))
        whole = F.aggregate(
            F.reverse("__run"), F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")),
            lambda acc, m: F.struct((m["a"] * acc["a"]).alias("a"), (m["b"] + m["a"] * acc["b"]).alias("b")),
        )
        composed = runs.select(key, "__up", whole.alias("__m")).select(key, "__up", F.col("__m.a").alias("__a"), F.col("__m.b").alias("__b"))
        runs = runs.join(suffix_carries(composed, key, "__up", "__a", "__b", "__in", fan, levels - 1), [key, "__up"])
    entry = "array<struct<at:bigint,value:double>>"
    step = lambda acc, m: F.struct(
        F.concat(acc["out"], F.array(F.struct(m["at"].cast("long").alias("at"), acc["y"].alias("value")))).cast(entry).alias("out"),
        (m["b"] + m["a"] * acc["y"]).alias("y"),
    )
    handed = F.aggregate(F.reverse("__run"), F.struct(F.array().cast(entry).alias("out"), F.col("__in").alias("y")), step)["out"]
    return runs.select(key, F.inline(handed)).select(key, F.col("at").alias(at), F.col("value").alias(out))
