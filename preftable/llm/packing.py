"""Vector best-fit packing of documents into sequences.

A sequence has several capacities: tokens, number of documents and attention cost (the sum of
squared piece lengths). A piece goes to the open sequence in which it fits under *every* capacity
and whose weighted residual vector is best: ``residual_norm`` takes the least norm of what would
remain, ``dot_product`` the largest product of demand and residual.

All demands follow from a piece's length, so pieces of one length are alike and sequences with the
same residuals are alike. The packing is therefore decided on counts per length (at most
``max_tokens`` rows, whatever the corpus) and gives *placements*: the pieces of one length with
ranks ``[rank, rank + n)`` go to the sequences ``[bin, bin + n)`` at one offset. Spark numbers the
pieces within their length (split by hash, so that a length holding a third of all pieces stays
spread) and looks their placement up. Longest pieces first, as in best-fit decreasing.

With windows (``pack_windows``) each window is packed on its own, on its own counts, and its sequences
are numbered after those of the windows before it, so a mixture that decides a row's window decides its
sequence. A window's counts (at most ``max_tokens`` rows) are placed in a task each.

Defined cases: a null or empty text has its end id alone; a longer text is cut so that the first
piece takes the remainder and all others are full; repeated rows are packed one by one; a table
without rows gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from preftable.llm.scratch import staged
from preftable.llm.ship import ship_package
from preftable.llm.tokens import encoder

END_ID = 2
SPAN = 256  # pieces of one window and length that look their placements up together
SPLIT_PIECES = 100_000  # pieces of the table for each split that numbers those of one length
BROADCAST_PLACEMENTS = 100_000  # rows of 40 bytes; more are joined by span


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds, and how much each kind counts when sequences are compared."""

    max_tokens: int = 1024
    max_docs: int | None = None  # null: as many as there are tokens
    max_cost: int | None = None  # null: max_tokens squared, which the tokens imply
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)
    rule: str = "residual_norm"  # or "dot_product"

    @property
    def limits(self) -> tuple[int, int, int]:
        return (
            self.max_tokens,
            self.max_tokens if self.max_docs is None else self.max_docs,
            self.max_tokens**2 if self.max_cost is None else self.max_cost,
        )


def token_pieces(
    df: DataFrame,
    vocabulary: str,
    max_tokens: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id``, the columns ``keep``, ``piece, start, length, ids_crc32`` (and ``ids``, little-endian uint32) of
    every piece of every text."""
    ship_package(df.sparkSession)
    kept = [id_col, *keep]
    fields = [*(df.schema[c] for c in kept), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids
    names = [f.name for f in fields]
    end = np.asarray([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            row, piece, start, length, crc, parts = [], [], [], [], [], []
            for i, ids in enumerate(enc.column(batch.column(text_col))):
                ids += end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - at) % max_tokens or max_tokens if at == 0 else max_tokens
                    own = ids[4 * at : 4 * (at + size)]
                    row.append(i), piece.append(k), start.append(at), length.append(size), crc.append(zlib.crc32(own))
                    if with_ids:
                        parts.append(own)
                    at, k = at + size, k + 1
            cols = [*(batch.column(c).take(pa.array(row, pa.int64())) for c in kept), pa.array(piece, pa.int32())]
            cols += [pa.array(x, pa.int64()) for x in (start, length, crc)] + [pa.array(parts, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.select(*kept, text_col).mapInArrow(cut, T.StructType(fields))


def place(counts: dict[int, int], cap: Capacity = Capacity()) -> list[tuple[int, int, int, int, int]]:
    """Placements ``(length, rank, n, bin, offset)`` of ``counts[length]`` pieces of each length.

    The same sequences come out as if one piece after the other took the best sequence with room (ties:
    the least residual). Sequences that are alike are one entry with the ranges of their numbers, so the
    work depends on the number of lengths and not on the number of pieces. Raises if a piece fits no empty sequence.
    """
    limits, w = cap.limits, cap.weights
    open_: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    by_tokens: list[tuple[int, int, int]] = []  # the open residuals, sorted
    out: list[tuple[int, int, int, int, int]] = []
    made = 0

    def score(residual, demand) -> float:
        if cap.rule == "dot_product":
            return -sum(a * (r / c) * (d / c) for a, r, d, c in zip(w, residual, demand, limits))
        return sum(a * ((r - d) / c) ** 2 for a, r, d, c in zip(w, residual, demand, limits))

    def most(residual, demand) -> int:
        return min(a // d for a, d in zip(residual, demand))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        demand = (length, 1, length * length)
        if any(d > c for d, c in zip(demand, limits)):
            raise ValueError(f"a piece of {length} tokens fits no sequence of {limits}")
        rank, left = 0, counts[length]
        queue = [(score(r, demand), r) for r in by_tokens[bisect.bisect_left(by_tokens, (length,)) :] if all(a >= d for a, d in zip(r, demand))]
        heapq.heapify(queue)
        while left:
            if queue:
                _, residual = heapq.heappop(queue)
                if residual not in open_:  # queued twice and used up since
                    continue
                ranges = open_.pop(residual)
                by_tokens.pop(bisect.bisect_left(by_tokens, residual))
                # what a piece leaves has a smaller norm, so the next piece follows it; its product is smaller too
                each = most(residual, demand) if cap.rule == "residual_norm" else 1
            else:  # nothing open has room: a new sequence takes pieces until it is full, then the next
                residual, each = limits, most(limits, demand)
                n = -(-left // each)
                ranges = [(made, n)]
                made += n
            taken: dict[int, list[tuple[int, int]]] = {}
            while left and ranges:
                first, n = ranges.pop()
                use, own = (min(n, left // each), each) if left >= each else (1, left)
                for k in range(own):
                    out.append((length, rank, use, first, cap.max_tokens - residual[0] + k * length))
                    rank += use
                left -= use * own
                taken.setdefault(own, []).append((first, use))
                if use < n:
                    ranges.append((first + use, n - use))
            after = {tuple(a - own * d for a, d in zip(residual, demand)): firsts for own, firsts in taken.items()}
            for rest, firsts in [*after.items(), (residual, ranges)]:
                if not firsts or min(rest) <= 0:
                    continue
                if rest not in open_:
                    bisect.insort(by_tokens, rest)
                open_.setdefault(rest, []).extend(firsts)
                if left and all(a >= d for a, d in zip(rest, demand)):
                    heapq.heappush(queue, (score(rest, demand), rest))
    return out


def number_within(df: DataFrame, key: str | list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """``name``: 0, 1, ... within ``key``. Each key is split by a hash of ``order``: counts per split give
    where a split begins, so no task holds all rows of a key. The splits follow from ``rows``, the table's
    size, and so the numbers from the rows alone, whatever the session's settings."""
    key = [key] if isinstance(key, str) else key
    split = df.withColumn("__h", F.pmod(F.xxhash64(*order), F.lit(1 + rows // SPLIT_PIECES)))
    sizes = split.groupBy(*key, "__h").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*key).orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy(*key, "__h").orderBy(*order)) - 1
    return split.withColumn("__own", own).join(starts, [*key, "__h"]).withColumn(name, F.col("__from") + F.col("__own")).drop("__h", "__own", "__from")


def pack(pieces: DataFrame, cap: Capacity = Capacity(), id_col: str = "doc_id") -> DataFrame:
    """``pieces`` (with ``id``, ``piece``, ``start`` and ``length``) with ``sequence_id`` and ``offset``.

    ``pieces`` is read three times: give a written table. Only counts per length (at most
    ``max_tokens``) and their placements meet on the driver.
    """
    spark: SparkSession = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = place(counts, cap)
    placed = spark.createDataFrame(found, "length long, __rank long, __size long, __bin long, offset long")
    order = [id_col, "piece", "start", *(c for c in ("ids_crc32",) if c in pieces.columns)]
    ranked = number_within(pieces, "length", order, "__r", sum(counts.values()))
    joined = _looked_up(ranked, placed, ["length"], small=len(found) <= BROADCAST_PLACEMENTS)
    return joined.withColumn("sequence_id", F.col("__bin") + F.col("__r") - F.col("__rank")).drop("__r", "__rank", "__size", "__bin")


def _looked_up(ranked: DataFrame, placed: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Each ranked piece with its placement. Few placements are broadcast; else a placement goes to every span
    of ranks that it meets, so that pieces of one length, however many, stay spread."""
    if small:
        both = ranked.join(F.broadcast(placed), keys)
    else:
        span = lambda rank: F.floor(rank / SPAN)
        spread = placed.withColumn("__s", F.explode(F.sequence(span(F.col("__rank")), span(F.col("__rank") + F.col("__size") - 1))))
        both = ranked.withColumn("__s", span(F.col("__r"))).join(spread, [*keys, "__s"]).drop("__s")
    return both.filter((F.col("__r") >= F.col("__rank")) & (F.col("__r") < F.col("__rank") + F.col("__size")))


def pack_documents(df: DataFrame, vocabulary: str, cap: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every text: ``id, piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces = staged(token_pieces(df, vocabulary, cap.max_tokens, id_col, text_col), "pieces")
    names = pieces.columns
    return pack(pieces, cap, id_col).select(*names, "sequence_id", "offset")


def pack_windows(
    df: DataFrame, window_col: str, vocabulary: str, cap: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``pack_documents`` within each window: a window's sequences hold its pieces alone and come after those of
    all lower windows."""
    spark = df.sparkSession
    plain = df.withColumn("__w", F.col(window_col).cast("long"))
    pieces = staged(token_pieces(plain, vocabulary, cap.max_tokens, id_col, text_col, keep=("__w",)), "window-pieces")

    def placements(counts):
        own = place(dict(zip(counts["length"].tolist(), counts["n"].tolist())), cap)
        out = pd.DataFrame(own, columns=["length", "__rank", "__size", "__bin", "offset"], dtype="int64")
        out.insert(0, "__w", counts["__w"].iloc[0])
        return out

    counts = pieces.groupBy("__w", "length").agg(F.count(F.lit(1)).alias("n"))
    schema = "__w long, length long, __rank long, __size long, __bin long, offset long"
    placed = staged(counts.groupBy("__w").applyInPandas(placements, schema), "window-placements")
    sizes = placed.groupBy("__w").agg(F.max(F.col("__bin") + F.col("__size")).alias("__made"))
    before = Window.orderBy("__w").rowsBetween(Window.unboundedPreceding, -1)  # a row for each window
    firsts = sizes.select("__w", F.coalesce(F.sum("__made").over(before), F.lit(0)).alias("__first"))
    ranked = number_within(pieces, ["__w", "length"], [id_col, "piece", "start", "ids_crc32"], "__r", pieces.count())
    joined = _looked_up(ranked, placed.join(firsts, "__w"), ["__w", "length"], small=False)
    names = [c for c in pieces.columns if c != "__w"]
    return joined.select(*names, (F.col("__first") + F.col("__bin") + F.col("__r") - F.col("__rank")).alias("sequence_id"), "offset")
