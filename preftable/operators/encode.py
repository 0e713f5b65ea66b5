"""Text → token ids against a vocabulary table (§2.3), as a Spark job.

``encode`` explodes each text into ``(key, field, position, token)`` rows, looks tokens up with an
equi-join on the vocabulary and folds the ids back into one array per row. The fold is a
``collect_list`` grouped by the row key, of one number per token (``packed``): all tokens of a row are
produced in the same task, so the partial (map-side) aggregate already holds the whole list and the
shuffle moves one array per row, not one record per token.

Join strategy is chosen from a measured size: a vocabulary of at most ``broadcast_limit`` entries
(and at most ``BROADCAST_BYTES_LIMIT`` bytes of tokens) is broadcast. A larger one is split: its ``broadcast_limit`` most frequent entries (the lowest ids
of a frequency-ranked vocabulary such as ``build_vocab``'s) are broadcast, and the rest of the
vocabulary is joined to the distinct tokens that missed alone. That dictionary of the tokens really
needed is written once, with each one's rows, and broadcast in turn. Of one that is too large for it the
tokens with very many rows are broadcast and the others joined by shuffle, so no token, known or not,
piles up in one shuffle partition and the dictionary is never copied.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from preftable.config import TOKEN_PATTERN, SpecialIds
from preftable.operators.indexing import with_row_index
from preftable.session import scratch_table_path

DEFAULT_BROADCAST_LIMIT = 2_000_000


def tokens(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """Whitespace-style split; empty pieces are kept here and dropped by the callers."""
    return F.split(text, pattern)


def build_vocab(
    df: DataFrame,
    text_col: str = "text",
    ids: SpecialIds = SpecialIds(),
    min_count: int = 1,
    pattern: str = TOKEN_PATTERN,
) -> DataFrame:
    """``(token, count, id)``: ids by descending count then token, after the special ids.

    The count is a hash aggregate with map-side combine, so frequent tokens collapse to one row
    per task before the shuffle. Ranking uses range-partitioned numbering, not a global window.
    """
    counts = (
        df.select(F.explode(tokens(F.col(text_col), pattern)).alias("token"))
        .filter(F.col("token") != "")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("count"))
        .filter(F.col("count") >= min_count)
    )
    ranked = with_row_index(counts, [F.col("count").desc(), F.col("token")], name="rank")
    return ranked.select("token", "count", (F.col("rank") + F.lit(ids.first_free_id)).cast("int").alias("id"))


# Upper bound on the vocabulary bytes (token text plus id) sent to every executor.
BROADCAST_BYTES_LIMIT = 512 * 1024 * 1024


HEAVY_ROWS = 100_000  # rows from which a missed token is looked up by broadcast, so that it is no shuffle key


def _fits(table: DataFrame, broadcast_limit: int) -> tuple[bool, int, int]:
    """Whether a ``token`` table may be broadcast, its rows and its bytes, measured in one aggregation."""
    stats = table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("token") + F.lit(4)).alias("bytes")).first()
    size, nbytes = int(stats["n"]), int(stats["bytes"] or 0)
    return size <= broadcast_limit and nbytes <= BROADCAST_BYTES_LIMIT, size, nbytes


def _lookup(exploded: DataFrame, vocab: DataFrame, broadcast_limit: int, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    v = vocab.select("token", F.col("id").cast("int").alias("__pt_id"))
    fits, size, nbytes = _fits(v, broadcast_limit)
    if fits:
        return exploded.join(F.broadcast(v), "token", "left")
    floor = vocab.agg(F.min("id")).first()[0]
    # As many of the most frequent entries as fit both limits (average entry size).
    hot_rows = min(broadcast_limit, int(size * BROADCAST_BYTES_LIMIT / max(nbytes, 1)))
    hot = v.filter(F.col("__pt_id") < F.lit(floor + hot_rows))
    cold = v.filter(F.col("__pt_id") >= F.lit(floor + hot_rows))
    first = exploded.join(F.broadcast(hot), "token", "left")
    missed = F.col("__pt_id").isNull() & F.col("token").isNotNull() & (F.col("token") != "")
    # The vocabulary meets each missed token once, however often texts have it; of the unknown ones those
    # with many rows stay, without an id.
    found = first.filter(missed).groupBy("token").agg(F.count(F.lit(1)).alias("__pt_n"))
    found = found.join(cold.withColumnRenamed("__pt_id", "__pt_cold"), "token", "left")
    found = found.filter(F.col("__pt_cold").isNotNull() | (F.col("__pt_n") >= heavy_rows))
    spark = exploded.sparkSession
    path = scratch_table_path(spark, f"missed-tokens-{uuid.uuid4().hex}")
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    known = found.filter(F.col("__pt_cold").isNotNull()).drop("__pt_n")
    both = F.coalesce("__pt_id", "__pt_cold")
    if _fits(known, broadcast_limit)[0]:
        return first.join(F.broadcast(known), "token", "left").withColumn("__pt_id", both).drop("__pt_cold")
    # The few tokens with very many rows, known or not, are broadcast: there are at most rows / heavy_rows of
    # them. Each other known one has a bounded number of rows, and only their rows are shuffled by token.
    heavy = found.filter(F.col("__pt_n") >= heavy_rows).select("token", "__pt_cold", F.lit(True).alias("__pt_heavy"))
    light = known.join(heavy.select("token"), "token", "left_anti")
    first = first.join(F.broadcast(heavy), "token", "left").withColumn("__pt_id", both).drop("__pt_cold")
    missed = missed & F.col("__pt_heavy").isNull()
    got = first.filter(missed).drop("__pt_heavy").join(light, "token", "left").withColumn("__pt_id", both).drop("__pt_cold")
    return first.filter(~missed).drop("__pt_heavy").unionByName(got)


# A token's place and id as one number: shuffles and sorts move eight bytes for a token, not a struct.
_ID_SHIFT = 1 << 31


def packed(place: Column, token_id: Column) -> Column:
    """``place`` (0 to 2**31 - 1) and an int id in one long, ordered by place, then id; null if the id is."""
    return F.shiftleft(place.cast("long"), 32) + (token_id.cast("long") + F.lit(_ID_SHIFT))


def unpacked_ids(numbers: Column) -> Column:
    """The ids of an array of ``packed`` numbers, in the numbers' order."""
    return F.transform(F.sort_array(numbers), lambda x: (x.bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(_ID_SHIFT)).cast("int"))


def _pieces(df: DataFrame, cols: list[str], keys: list[str], pattern: str, max_ids: int | dict[str, int] | None) -> DataFrame:
    """``(keys…, f, pos, token)``: a row for each piece of each text, at least one for each text."""
    fields = F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("string").alias("t")) for i, c in enumerate(cols)])
    exploded = (
        df.select(*keys, F.inline(fields))
        .select(*keys, "f", tokens(F.col("t"), pattern).alias("__pieces"))
        .select(
            *keys,
            "f",
            (F.get(F.col("__pieces"), 0) == F.lit("")).cast("int").alias("__lead"),
            F.posexplode_outer("__pieces").alias("pos", "token"),
        )
    )
    if max_ids is not None:
        limits = max_ids if isinstance(max_ids, dict) else {c: max_ids for c in cols}
        limit = F.lit(None).cast("long")
        for i, c in enumerate(cols):
            if c in limits:
                limit = F.when(F.col("f") == i, F.lit(int(limits[c]))).otherwise(limit)
        # Empty pieces (first/last only) stay so every row survives; real tokens past the limit go.
        dense = F.col("pos") - F.coalesce(F.col("__lead"), F.lit(0))
        exploded = exploded.filter(
            limit.isNull() | F.col("token").isNull() | (F.col("token") == "") | (dense < limit)
        )
    return exploded.drop("__lead")


def _piece_id(ids: SpecialIds) -> Column:
    """A looked-up piece's id: the unknown token's without an entry, null for an empty piece."""
    empty = F.col("token").isNull() | (F.col("token") == "")
    return F.when(empty, F.lit(None).cast("int")).otherwise(F.coalesce(F.col("__pt_id"), F.lit(ids.unk)))


def encode(
    df: DataFrame,
    text_cols: str | Sequence[str],
    vocab: DataFrame,
    key_cols: Sequence[str],
    ids: SpecialIds = SpecialIds(),
    out_suffix: str = "_ids",
    passthrough: Sequence[str] = (),
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
    pattern: str = TOKEN_PATTERN,
    max_ids: int | dict[str, int] | None = None,
) -> DataFrame:
    """Encode each of ``text_cols`` into ``{col}{out_suffix}`` ARRAY<INT>; no special tokens.

    Unknown tokens map to ``ids.unk``; an empty or NULL text gives ``array()``. ``key_cols`` must be
    unique per row; ``passthrough`` columns ride along (constant per key). Returns
    ``key_cols + passthrough + encoded columns``.

    ``max_ids`` (one limit, or one per column) keeps only the first ids of each text, equal to
    encoding everything and truncating afterwards (each whitespace token maps to exactly one id):
    the whole text is still split, and tokens past the limit are dropped before the lookup and
    the per-row fold, so a huge text never becomes one huge array in one task.
    """
    cols = [text_cols] if isinstance(text_cols, str) else list(text_cols)
    keys = list(key_cols) + list(passthrough)
    exploded = _pieces(df, cols, keys, pattern, max_ids)
    joined = _lookup(exploded, vocab, broadcast_limit)
    # Only keys and numbers reach the fold, so its sorts hold no token text. An empty piece's number is
    # null: lists leave it out, its row stays.
    numbers = joined.select(*keys, "f", packed(F.col("pos"), _piece_id(ids)).alias("__pt_tok"))
    of_field = [F.col("__pt_tok") if len(cols) == 1 else F.when(F.col("f") == i, F.col("__pt_tok")) for i in range(len(cols))]
    grouped = numbers.groupBy(*keys).agg(*[F.collect_list(x).alias(f"__pt_toks_{i}") for i, x in enumerate(of_field)])
    return grouped.select(*keys, *[unpacked_ids(F.col(f"__pt_toks_{i}")).alias(f"{c}{out_suffix}") for i, c in enumerate(cols)])


# Upper bound on the vocabulary bytes that are written into a plan.
INLINE_BYTES_LIMIT = 64 * 1024 * 1024


def inline_vocabulary(vocab: DataFrame, bytes_limit: int = INLINE_BYTES_LIMIT) -> Callable[[Column], Column]:
    """A lookup ``token -> id`` (null if unknown) as an expression, for plans that can't join or regroup.

    The vocabulary becomes one constant of the plan: an array of small maps, by the token's hash, so
    a lookup compares a few entries. It reaches every task as a broadcast table would, and like one
    only after its bytes are measured; a larger vocabulary is refused (use ``encode``).
    """
    v = vocab.select("token", F.col("id").cast("int").alias("id"))
    size = v.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("token") + F.lit(4)).alias("bytes")).first()
    if (size["bytes"] or 0) > bytes_limit:
        raise ValueError(f"a vocabulary of {size['bytes']} bytes is over the limit of {bytes_limit}")
    buckets = 1 << max(0, int(size["n"]).bit_length() - 1)
    place = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")
    entries = F.to_json(F.map_from_entries(F.collect_list(F.struct("token", "id"))))
    filled = dict(v.groupBy(place.alias("p")).agg(entries.alias("m")).collect())
    text = "[" + ",".join(filled.get(p, "{}") for p in range(buckets)) + "]"
    table = F.from_json(F.lit(text), "array<map<string,int>>")  # folded to a constant when the plan is made
    return lambda token: F.try_element_at(F.get(table, F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")), token)


def encode_rows(
    df: DataFrame,
    text_cols: str | Sequence[str],
    lookup: Callable[[Column], Column],
    ids: SpecialIds = SpecialIds(),
    out_suffix: str = "_ids",
    pattern: str = TOKEN_PATTERN,
    max_ids: int | dict[str, int] | None = None,
) -> DataFrame:
    """``encode`` inside each row: no join, shuffle or key, so it runs on a stream, and rows with one id stay apart.

    Adds ``{col}{out_suffix}`` for each text column; null and empty texts give ``array()``, unknown
    tokens ``ids.unk``, and ``max_ids`` keeps a text's first ids.
    """
    cols = [text_cols] if isinstance(text_cols, str) else list(text_cols)
    out = df
    for c in cols:
        limit = max_ids.get(c) if isinstance(max_ids, dict) else max_ids
        pieces = F.filter(tokens(F.coalesce(F.col(c).cast("string"), F.lit("")), pattern), lambda t: t != "")
        pieces = pieces if limit is None else F.slice(pieces, 1, limit)
        out = out.withColumn(f"{c}{out_suffix}", F.transform(pieces, lambda t: F.coalesce(lookup(t), F.lit(ids.unk))))
    return out


def encode_stream(
    stream: DataFrame,
    text_cols: str | Sequence[str],
    vocab: DataFrame,
    passthrough: Sequence[str],
    ids: SpecialIds = SpecialIds(),
    out_suffix: str = "_ids",
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
    pattern: str = TOKEN_PATTERN,
    max_ids: int | dict[str, int] | None = None,
) -> DataFrame:
    """``encode`` on a stream, for a vocabulary of any size: ``passthrough`` and the encoded columns of each row.

    Tokens meet the vocabulary table in stream-static joins: up to ``broadcast_limit`` entries (and
    ``BROADCAST_BYTES_LIMIT`` bytes) are broadcast, the rest is joined by shuffle, so the vocabulary is
    neither a constant of the plan nor collected. Each row gets a name of its own and its ids are folded
    under it inside the micro-batch, without state; rows that share an id stay apart.
    """
    cols = [text_cols] if isinstance(text_cols, str) else list(text_cols)
    keys = ["__pt_row", *passthrough]
    rows = _pieces(stream.withColumn("__pt_row", F.uuid()), cols, keys, pattern, max_ids)
    v = vocab.select("token", F.col("id").cast("int").alias("__pt_id"))
    fits, size, nbytes = _fits(v, broadcast_limit)
    if fits:
        joined = rows.join(F.broadcast(v), "token", "left")
    else:
        last = vocab.agg(F.min("id")).first()[0] + min(broadcast_limit, int(size * BROADCAST_BYTES_LIMIT / max(nbytes, 1)))
        first = rows.join(F.broadcast(v.filter(F.col("__pt_id") < last)), "token", "left")
        # Tokens that were found are dealt evenly, under keys that no token has (none holds a line break).
        spread = F.concat(F.lit("\n"), F.pmod(F.xxhash64("__pt_row", "pos"), F.lit(4096)).cast("string"))
        key = F.when(F.col("__pt_id").isNull() & (F.col("token") != ""), F.col("token")).otherwise(spread)
        cold = v.filter(F.col("__pt_id") >= last).select(F.col("token").alias("__pt_key"), F.col("__pt_id").alias("__pt_cold"))
        joined = first.withColumn("__pt_key", key).join(cold, "__pt_key", "left")
        joined = joined.withColumn("__pt_id", F.coalesce("__pt_id", "__pt_cold"))
    numbers = joined.select(*keys, "f", packed(F.col("pos"), _piece_id(ids)).alias("__pt_tok"))
    names = [f"{c}{out_suffix}" for c in cols]
    schema = StructType([rows.schema[c] for c in passthrough] + [StructField(n, ArrayType(IntegerType())) for n in names])

    def fold(part: pa.Table) -> pa.Table:
        known = part.filter(pc.is_valid(part["__pt_tok"]))
        field, token = known["f"].to_numpy(), known["__pt_tok"].to_numpy()
        lists = [(np.sort(token[field == i]) & ((1 << 32) - 1)) - _ID_SHIFT for i in range(len(names))]
        out = {c: part[c].slice(0, 1) for c in passthrough}
        return pa.table(out | {n: pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for n, x in zip(names, lists, strict=True)})

    return numbers.groupBy("__pt_row").applyInArrow(fold, schema)


def encode_with_specials(
    df: DataFrame,
    text_col: str,
    vocab: DataFrame,
    key_cols: Sequence[str],
    ids: SpecialIds = SpecialIds(),
    out: str | None = None,
    passthrough: Sequence[str] = (),
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
) -> DataFrame:
    """Encode with the tokenizer's default specials: a BOS prefix."""
    name = out or f"{text_col}_ids"
    enc = encode(df, text_col, vocab, key_cols, ids, "__pt_enc", passthrough, broadcast_limit)
    return enc.select(
        *key_cols, *passthrough, F.concat(F.array(F.lit(ids.bos)), F.col(f"{text_col}__pt_enc")).alias(name)
    )


def encode_long(
    df: DataFrame,
    text_col: str,
    vocab: DataFrame,
    key_cols: Sequence[str],
    ids: SpecialIds = SpecialIds(),
    with_bos: bool = False,
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
    pattern: str = TOKEN_PATTERN,
) -> DataFrame:
    """Token ids in long form ``(keys…, pos, id)``: no regrouping, so no row is ever built whole.

    For texts of unbounded size (one document may hold a large share of a corpus). ``pos`` is
    dense (0, 1, …) over the non-empty tokens: the split pattern matches runs of separators, so an
    empty piece can only come first or last and the dense position is the piece index minus one
    when the text starts with a separator. ``with_bos`` puts the BOS id at position 0 (emitted by
    the same explode, so the text is scanned once).
    """
    keys = list(key_cols)
    # Split once into a column first: an expression over the text next to the generator would be
    # evaluated per emitted token (re-splitting the whole text each time).
    split = df.select(*keys, tokens(F.col(text_col), pattern).alias("__pieces"))
    pieces = F.col("__pieces")
    arr = F.concat(F.array(F.lit(None).cast("string")), pieces) if with_bos else pieces
    exploded = split.select(
        *keys,
        (F.get(pieces, 0) == F.lit("")).cast("int").alias("__lead"),
        F.posexplode(arr).alias("__i", "token"),
    ).filter(((F.col("__i") == 0) & F.lit(with_bos)) | (F.col("token") != ""))
    joined = _lookup(exploded, vocab, broadcast_limit)
    is_bos = (F.col("__i") == 0) & F.lit(with_bos)
    token_id = F.when(is_bos, F.lit(ids.bos)).otherwise(F.coalesce(F.col("__pt_id"), F.lit(ids.unk)))
    pos = F.when(is_bos, F.lit(0)).otherwise(F.col("__i") - F.col("__lead"))
    return joined.select(*keys, pos.cast("long").alias("pos"), token_id.cast("int").alias("id"))


def token_count(text: Column, with_bos: bool = False, pattern: str = TOKEN_PATTERN) -> Column:
    """Number of ids ``encode_long`` emits for a text (a split and a count, no explode)."""
    n = F.size(F.filter(tokens(text, pattern), lambda t: t != ""))
    return n + F.lit(1) if with_bos else n
