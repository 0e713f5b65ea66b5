"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Weights are whole units of a period of W slots (W is the sum of the units). A source with u units
owns u blocks of each period; its block j (from 0) may run from slot ``floor(j * W / u)`` and must
run before slot ``ceil((j + 1) * W / u)``. In every slot the released block with the earliest
deadline runs (ties: the first source by name). The windows make every prefix of the schedule hold
each source's share to within less than one block, and the schedule repeats every W slots: block b
of a source runs in slot ``(b div u) * W + slot(b mod u)``. W grows with the sources, so that each
has units enough for its share (``target_units``). A block is a row, and a period is halved by
deadline until a part fits one row (``schedule``).

Rows are dealt to blocks in md5 order of their id, a fixed shuffle within the source. Numbering a
source goes by the first digits of that hash, so a source with a third of all rows is spread over
4,096 splits. Every row keeps its place: a source that ends early leaves its later slots empty, and
the others go on in their own proportions. Nothing is repeated or dropped.

Defined cases: a null source is a source of its own; repeated rows get places one by one; null,
empty and very long texts are rows like others; a table without rows gives no rows; columns that
clash with the results are replaced, others pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from preftable.llm.scratch import staged

PERIOD = 1000  # units shared out among the sources, or more: see target_units
LEAST_UNITS = 20
PART = 1024  # blocks of a period that one row may hold
BLOCK_ROWS = 8
SPLIT_DIGITS = 3  # hash digits that split a source: 4,096 parts

RESULTS = ("block", "release", "deadline", "slot", "place")
WINDOW = "mix_window"


def _key(source: Column) -> Column:
    """Sources as non-null keys."""
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("null"))


def _quoted(names: list[str]) -> list[str]:
    return [f"`{c}`" for c in names]


def target_units(df: DataFrame, source_col: str = "source", period: int = PERIOD, power: float = 0.5) -> DataFrame:
    """``__k, units``: weights in proportion to ``rows ** power``, in whole units. They share out ``period``
    units, or as many more as give the smallest source ``LEAST_UNITS``: rounding down then changes a source's
    share of the slots by at most one part in ``LEAST_UNITS - 1``, however many sources there are."""
    sizes = df.groupBy(_key(F.col(source_col)).alias("__k")).agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(power)).alias("p"))
    every = Window.orderBy("__k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shares = sizes.withColumn("t", F.sum("p").over(every)).withColumn("low", F.min("p").over(every))  # a row for each source
    whole = F.greatest(F.lit(period).cast("double"), F.ceil(F.lit(LEAST_UNITS) * F.col("t") / F.col("low")).cast("double"))
    return shares.select("__k", F.floor(whole * F.col("p") / F.col("t")).cast("long").alias("units"))


def given_units(df: DataFrame, weights: DataFrame, source_col: str = "source") -> DataFrame:
    """``__k, units`` from a table ``source, units`` of whole target weights."""
    return weights.select(_key(F.col(source_col)).alias("__k"), F.col("units").cast("long").alias("units"))


def schedule(units: DataFrame) -> DataFrame:
    """One period: ``__k, units, period, __j, release, deadline, __slot`` for every block of every source.

    A block's rank is its place by (deadline, source). Running the earliest deadline of the released
    blocks in each slot gives every block the earliest slot from its release on that no block of a lower
    rank has. All slots of a period are used, so the lower half of the ranks uses as many slots as it has
    blocks; which ones, a running minimum over the releases tells. Both halves are then periods of their
    own, and so on until a part has at most ``PART`` blocks, which one row holds.
    """
    units = staged(units.filter("units > 0"), "mix-units")
    period = units.agg(F.sum("units")).first()[0] or 0
    blocks = units.withColumn("period", F.lit(period).cast("long")).withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)))
    blocks = blocks.withColumn("release", F.expr("__j * period div units")).withColumn("deadline", F.expr("((__j + 1) * period + units - 1) div units"))
    ranked = blocks.withColumn("__id", F.row_number().over(Window.orderBy("deadline", "__k")).cast("long") - 1)  # a row for each slot
    if period > PART:
        ranked = staged(ranked, "mix-blocks")
    # A part: its blocks (rank and release within it) and its slots (number within it), both at ``x``.
    block = ranked.select(F.lit(0).cast("long").alias("g"), F.lit(period).cast("long").alias("m"), F.col("release").alias("x"), F.col("__id").alias("rank"), F.col("__id").alias("who"))
    slot = F.lit(None).cast("long")
    slots = ranked.select("__id").select(F.lit(0).cast("long").alias("g"), F.lit(period).cast("long").alias("m"), F.col("__id").alias("x"), slot.alias("rank"), F.col("__id").alias("who"))
    rows, largest = block.unionByName(slots), period
    while largest > PART:
        low = F.col("rank") < F.expr("(m + 1) div 2")
        by = Window.partitionBy("g").orderBy("x")
        count = F.sum(F.when(low, 1).otherwise(0))
        # Lower blocks released before x and up to x; of the slots before x, those that they use.
        seen = rows.withColumn("before", F.coalesce(count.over(by.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        seen = seen.withColumn("upto", count.over(by.rangeBetween(Window.unboundedPreceding, 0)))
        least = F.min(F.col("before") - F.col("x")).over(by.rangeBetween(Window.unboundedPreceding, 0))
        seen = seen.withColumn("used", F.col("x") + least)
        seen = seen.withColumn("first", F.when(F.col("rank").isNull(), F.col("upto") > F.col("used")).otherwise(low))
        half = F.expr("(m + 1) div 2")
        rows = staged(
            seen.select(
                F.when(F.col("first"), 2 * F.col("g")).otherwise(2 * F.col("g") + 1).alias("g"),
                F.when(F.col("first"), half).otherwise(F.col("m") - half).alias("m"),
                F.when(F.col("first"), F.col("used")).otherwise(F.col("x") - F.col("used")).alias("x"),
                F.when(F.col("first"), F.col("rank")).otherwise(F.col("rank") - half).alias("rank"),
                "who",
            ),
            "mix-parts",
        )
        largest = -(-largest // 2)
    # In each part, by rank: the earliest free slot from the release on.
    of = lambda key, kind: F.sort_array(F.collect_list(F.when(F.col("rank").isNotNull() == kind, F.struct(key, "x", "who"))))
    parts = rows.groupBy("g").agg(of("rank", True).alias("blocks"), of("x", False).alias("slots"), F.max("m").alias("m"))

    def step(state: Column, b: Column) -> Column:
        at = F.array_min(F.filter(state["free"], lambda t: t >= b["x"]))
        return F.struct(F.array_remove(state["free"], at).alias("free"), F.concat(state["ran"], F.array(at)).alias("ran"))

    begin = F.struct(F.sequence(F.lit(0).cast("long"), F.col("m") - 1).alias("free"), F.expr("cast(array() as array<bigint>)").alias("ran"))
    ran = parts.select("blocks", "slots", F.posexplode(F.aggregate("blocks", begin, step)["ran"]).alias("i", "at"))
    found = ran.select(F.expr("blocks[i].who").alias("__id"), F.expr("slots[int(at)].who").alias("__slot"))
    return ranked.join(found, "__id").select("__k", "units", "period", "__j", "release", "deadline", "__slot")


def mix(
    df: DataFrame, units: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Every row of ``df`` with its source's ``block``, the block's ``release``, ``deadline`` and ``slot``,
    and the row's ``place`` in the block; reading by (slot, place) gives the mixture."""
    base = df.drop(*RESULTS)
    return _mixed(base, units, id_col, source_col, block_rows).select(*_quoted(base.columns), *RESULTS)


def _mixed(df: DataFrame, units: DataFrame | None, id_col: str, source_col: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The columns of ``df`` that aren't ``RESULTS``, ``RESULTS`` and ``mix_window``."""
    base = df.drop(*RESULTS)
    plan = staged(schedule(target_units(base, source_col) if units is None else units), "mix-plan")
    inner = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("__row"), F.col(id_col).alias("__i"), F.col(source_col).alias("__s"))
    units_of = plan.filter("__j = 0").select("__k", "units", "period")
    hashed = inner.withColumn("__k", _key(F.col("__s"))).withColumn("__m", F.md5(F.coalesce(F.col("__i").cast("string"), F.lit("")).cast("binary")))
    hashed = hashed.withColumn("__p", F.substring("__m", 1, SPLIT_DIGITS))
    before = Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = hashed.groupBy("__k", "__p").agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.select("__k", "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from")).join(units_of, "__k")
    own = F.row_number().over(Window.partitionBy("__k", "__p").orderBy("__m", "__i")) - 1
    ranked = hashed.withColumn("__own", own).join(starts, ["__k", "__p"]).withColumn("__rank", F.col("__from") + F.col("__own"))
    placed = ranked.withColumn("block", F.floor(F.col("__rank") / block_rows)).withColumn("__j", F.pmod("block", "units"))
    turn = F.floor(F.col("block") / F.col("units")) * F.col("period")
    slots = plan.select("__k", "__j", F.col("release").alias("__r"), F.col("deadline").alias("__d"), "__slot")
    out = placed.join(slots, ["__k", "__j"])  # a row for each slot of the period
    return out.select(
        *[F.col(f"__row.`{c}`").alias(c) for c in base.columns],
        "block",
        (turn + F.col("__r")).alias("release"),
        (turn + F.col("__d")).alias("deadline"),
        (turn + F.col("__slot")).alias("slot"),
        F.pmod("__rank", F.lit(block_rows)).alias("place"),
        F.floor(F.col("block") / F.col("units")).alias(WINDOW),
    )


def in_mixed_order(df: DataFrame, units: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows and columns of ``df``, sorted in the order of the mixture (kept when written)."""
    return mix(df, units, id_col, source_col).orderBy("slot", "place").select(*_quoted(df.columns))


def in_windows(df: DataFrame, units: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``in_mixed_order`` with ``mix_window``, the period (from 0) in which a row's block runs: a window holds
    every source in proportion to its units until the source ends."""
    base = df.drop(*RESULTS, WINDOW)
    return _mixed(base, units, id_col, source_col).orderBy("slot", "place").select(*_quoted(base.columns), WINDOW)
