"""Split, shuffle, shard, batch, buffer and replay (§2.5).

Randomness is a hash of (seed, key), never ``rand()``: a re-run, a retried task or a recomputed
partition after executor loss gives the same split and the same order.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from preftable.operators.indexing import with_hash_index, with_row_index
from preftable.operators.selection import smallest
from preftable.session import scratch_table_path

TWO_32 = float(2**32)


def hash_unit(*parts: Column | str) -> Column:
    """Deterministic uniform number in [0, 1) from the first 32 bits of md5 over ``parts``."""
    return hash_32(*parts) / F.lit(TWO_32)


def hash_32(*parts: Column | str) -> Column:
    """The first 32 bits of md5 over ``parts`` as a whole number."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_order(*parts: Column | str) -> Column:
    """Deterministic order key (full md5 hex) from ``parts``."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.md5(text)


def train_test_split(
    df: DataFrame, key: str, ratio: float = 0.05, seed: int = 42, exact: bool = False, name: str = "split"
) -> DataFrame:
    """Tag rows ``train`` / ``test``. Hash split by default; ``exact`` gives ``ceil(n·ratio)`` test rows,
    by a threshold found from histograms of the keys' hashes: rows aren't sorted, moved or copied."""
    u = hash_unit(F.lit(str(seed)), key)
    if not exact:
        return df.withColumn(name, F.when(u < F.lit(float(ratio)), "test").otherwise("train"))
    test = smallest(df, key, hash_32(F.lit(str(seed)), key), lambda n: math.ceil(n * ratio))
    return df.withColumn(name, F.when(test, "test").otherwise("train"))


def shuffle(df: DataFrame, key: str, seed: int = 42, epoch: int = 0, name: str = "shuffle_key") -> DataFrame:
    """Add a per-epoch random order key; ``assign_batches`` sorts on (key, row key)."""
    return df.withColumn(name, hash_order(F.lit(str(seed)), F.lit(str(epoch)), key))


def assign_batches(
    df: DataFrame,
    order_cols: Sequence[str | Column],
    batch_size: int,
    partitions: int | None = None,
) -> DataFrame:
    """Consecutive groups of ``batch_size`` in ``order_cols`` order; the last may be short.

    Adds ``row_idx``, ``batch_id`` and ``idx_in_batch``. Numbering is range-partitioned (no
    single-partition window).
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    idx = with_row_index(df, order_cols, name="row_idx", partitions=partitions)
    return idx.withColumn("batch_id", F.floor(F.col("row_idx") / batch_size).cast("long")).withColumn(
        "idx_in_batch", F.pmod(F.col("row_idx"), F.lit(batch_size)).cast("int")
    )


WIDTH = "__width_"  # columns with the widest value of a row's batch; the collators use them and drop them


def shuffled_batches(
    df: DataFrame, key: str, batch_size: int, seed: int = 42, epoch: int = 0, widths: Mapping[str, Column] | None = None
) -> DataFrame:
    """``shuffle`` and ``assign_batches`` for wide rows: only keys and widths are numbered.

    ``widths`` names sizes of a row (such as its ids); ``__width_<name>`` is the largest of its batch. The
    narrow table is written once to the shared scratch folder, numbered by a histogram of its hashes
    (``with_hash_index``) and joined to the rows by ``key``, which must be unique: the rows themselves
    are neither sorted, copied nor regrouped by batch.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    widths = widths or {}
    narrow = shuffle(df.select(key, *[w.cast("long").alias(WIDTH + n) for n, w in widths.items()]), key, seed, epoch)
    if df.columns != [key]:
        path = scratch_table_path(df.sparkSession, f"batch-keys-{uuid.uuid4().hex}")
        narrow.write.parquet(path)
        narrow = df.sparkSession.read.schema(narrow.schema).parquet(path)
    idx = with_hash_index(narrow, "shuffle_key", [key]).drop("shuffle_key")
    idx = idx.withColumn("batch_id", F.floor(F.col("row_idx") / batch_size).cast("long"))
    idx = idx.withColumn("idx_in_batch", F.pmod(F.col("row_idx"), F.lit(batch_size)).cast("int"))
    of_batch = Window.partitionBy("batch_id")
    idx = idx.withColumns({WIDTH + n: F.max(WIDTH + n).over(of_batch).cast("int") for n in widths}) if widths else idx
    return idx if df.columns == [key] else df.join(idx, key)


def shard_to_ranks(df: DataFrame, n_ranks: int, order_cols: Sequence[str | Column], repartition: bool = True) -> DataFrame:
    """Spread rows round-robin over ``n_ranks`` workers (``rank = row_idx mod n``)."""
    idx = df if "row_idx" in df.columns else with_row_index(df, order_cols, name="row_idx")
    out = idx.withColumn("rank", F.pmod(F.col("row_idx"), F.lit(n_ranks)).cast("int"))
    # By range: a rank's rows stay together in as many partitions as they need, however few ranks there are.
    return out.repartitionByRange("rank", "row_idx") if repartition else out


def zip_streams(
    main: DataFrame,
    extra: DataFrame,
    batch_col: str = "batch_id",
    idx_col: str = "idx_in_batch",
    prefix: str = "extra_",
) -> DataFrame:
    """The i-th main batch with the i-th extra batch, cut to the shorter stream.

    Rows pair up by position inside the batch (a full outer equi-join on (batch, index), one row
    per position, never all pairs of a batch); batches beyond the shorter stream are dropped.
    """
    renamed = extra.select(
        F.col(batch_col), F.col(idx_col), *[F.col(c).alias(prefix + c) for c in extra.columns if c not in (batch_col, idx_col)]
    )
    n_main = main.agg(F.max(batch_col)).first()[0]
    n_extra = extra.agg(F.max(batch_col)).first()[0]
    if n_main is None or n_extra is None:
        return main.join(renamed, [batch_col, idx_col], "inner")
    last = min(int(n_main), int(n_extra))
    return main.filter(F.col(batch_col) <= last).join(
        renamed.filter(F.col(batch_col) <= last), [batch_col, idx_col], "full_outer"
    )


def fill_buffer(df: DataFrame, n: int, batch_col: str = "batch_id") -> DataFrame:
    """``buffer_id = batch div n``; an incomplete last buffer is dropped (it is never trained on)."""
    n_batches = df.agg(F.max(batch_col)).first()[0]
    complete = 0 if n_batches is None else (int(n_batches) + 1) // n
    return df.withColumn("buffer_id", F.floor(F.col(batch_col) / n).cast("long")).filter(
        F.col("buffer_id") < F.lit(complete)
    )


def make_mini_batches(df: DataFrame, mini: int, idx_col: str = "idx_in_batch") -> DataFrame:
    """Slice each batch in pieces of ``mini`` rows; each batch uses its own row count."""
    return df.withColumn("mini_id", F.floor(F.col(idx_col) / mini).cast("long"))


def replay_epochs(
    df: DataFrame,
    epochs: int,
    seed: int = 42,
    buffer_col: str = "buffer_id",
    batch_col: str = "batch_id",
    mini_col: str = "mini_id",
) -> DataFrame:
    """Visit each buffer ``epochs`` times, reshuffling its mini-batches each pass; ``step`` counts visits.

    Rows are replicated with ``explode(sequence(0, epochs-1))`` (no join). The visit order of the
    mini-batches is numbered over the distinct (buffer, epoch, batch, mini) keys only, then joined
    back on those keys.
    """
    rep = df.withColumn("ppo_epoch", F.explode(F.sequence(F.lit(0), F.lit(int(epochs) - 1))))
    keys = [buffer_col, "ppo_epoch", batch_col, mini_col]
    visits = rep.select(*keys).distinct().withColumn(
        "__pt_v", hash_order(F.lit(str(seed)), buffer_col, "ppo_epoch", batch_col, mini_col)
    )
    steps = with_row_index(visits, [buffer_col, "ppo_epoch", "__pt_v", batch_col, mini_col], name="__pt_s")
    steps = steps.select(*keys, (F.col("__pt_s") + 1).alias("step"))
    return rep.join(steps, keys)


def update_schedule(
    df: DataFrame,
    batch_col: str,
    batch_size: int,
    mini_batch_size: int,
    ppo_epochs: int,
    accum: int,
    epochs: float,
    max_steps: int = -1,
) -> DataFrame:
    """One-row schedule from the number of distinct batches, as expressions over an aggregate."""
    nb = F.countDistinct(batch_col).cast("double")
    per_epoch = F.greatest(nb * F.lit(batch_size / mini_batch_size) * F.lit(ppo_epochs) / F.lit(accum), F.lit(1.0))
    agg = df.agg(nb.alias("n_batches"), per_epoch.alias("updates_per_epoch"))
    if max_steps > 0:
        total = F.lit(max_steps).cast("long")
        q = F.floor(F.lit(float(max_steps)) / F.col("updates_per_epoch"))
        rem = F.lit(float(max_steps)) - q * F.col("updates_per_epoch")
        train_epochs = (q + F.when(rem > 0, 1).otherwise(0)).cast("long")
    else:
        total = F.ceil(F.lit(float(epochs)) * F.col("updates_per_epoch")).cast("long")
        train_epochs = F.lit(math.ceil(epochs)).cast("long")
    return agg.select(
        F.col("n_batches").cast("long").alias("n_batches"),
        "updates_per_epoch",
        total.alias("total_updates"),
        (total * F.lit(accum)).cast("long").alias("micro_steps"),
        train_epochs.alias("train_epochs"),
    )
