"""Token ids in Simple-8b files: word-aligned coding with escapes and per-block offsets.

Every 64-bit word holds a 4-bit selector and as many ids as fit at the selector's width; the encoder
takes the selector with the most ids at each place. Ids of 2^60 and above are escapes: a word with
selector 0 stands for the next entry of the row's escape list. Ids are cut in blocks of
``BLOCK`` and words never cross a block, so each block is coded and decoded on its own: the encoder
walks all blocks of a row side by side, the decoder unpacks all words of one selector at once.

The file format is a Parquet table with one row for each run of whole documents (about ``ROW_IDS``
ids): ``shard`` and ``first`` (ids of the shard before the row) place it, ``doc_ids``/``doc_lens``
list its documents, ``words``/``escapes`` (little-endian uint64) and ``offsets`` (uint32: first word
of each block) hold the ids. Shards follow each other in ascending document order. Spark's writer
commits the files, so lost tasks leave nothing behind.

Defined cases: a null or empty text has its end id alone; repeated ids are ordered by their text's
hash; a table without rows gives a file without rows; other columns are ignored; a text of any
length stays in one row, in as many blocks as it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from preftable.llm.scratch import new_path
from preftable.llm.ship import ship_package
from preftable.llm.tokens import encoder

# Fixed values of the format: selector 1.. stands for (bits of an id, ids in a word); 0 is an escape.
PACKINGS = ((1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1))
WIDTH = np.array([0, *(w for w, _ in PACKINGS)], np.uint64)
HOLDS = np.array([1, *(n for _, n in PACKINGS)], np.int64)
BLOCK = 1024
ROW_IDS = 256 * BLOCK
END_ID = 2


def _selectors(kind: np.ndarray) -> np.ndarray:
    """The selector with the most ids at every place, if a word began there (past the end all fit)."""
    nb = len(kind)
    wide = np.zeros((nb, BLOCK + 64), np.int8)
    wide[:, :BLOCK] = kind
    most = {1: wide}  # by n: the widest of the n ids from each place on
    for n, half in ((2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 6), (8, 7), (10, 8), (12, 8), (15, 8), (20, 15), (30, 15), (60, 30)):
        ahead = np.zeros_like(wide)
        ahead[:, : half - n] = most[half][:, n - half :]
        most[n] = np.maximum(most[half], ahead)
    selector = np.zeros((nb, BLOCK), np.int8)
    for k in range(len(PACKINGS) - 1, -1, -1):
        selector[most[PACKINGS[k][1]][:, :BLOCK] <= k] = k + 1
    return selector


def pack_ids(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, escapes, offsets)`` of uint64 ``values``; offsets has the first word of each block."""
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    nb = -(-n // BLOCK)
    grid = np.zeros(nb * BLOCK, np.uint64)
    grid[:n] = values
    # The narrowest packing of each id (len(PACKINGS): an escape).
    kind = np.searchsorted(np.array([(1 << w) - 1 for w, _ in PACKINGS], np.uint64), grid).astype(np.int8).reshape(nb, BLOCK)
    selector = _selectors(kind)
    # Walk all blocks at once: a row of ``steps`` is the next place of every block.
    ends = np.full(nb, BLOCK)
    ends[-1] = n - (nb - 1) * BLOCK
    here, rows, steps = np.zeros(nb, np.int64), np.arange(nb), []
    while (here < ends).any():
        steps.append(np.where(here < ends, here, -1))
        here = np.where(here < ends, here + HOLDS[selector[rows, np.minimum(here, BLOCK - 1)]], here)
    walk = np.array(steps).T
    used = walk >= 0
    first = (walk + BLOCK * rows[:, None])[used]
    per_block = used.sum(axis=1)
    offsets = np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype(np.uint32)
    sel = selector.reshape(-1)[first]
    words = sel.astype(np.uint64) << np.uint64(60)
    stop = np.repeat(BLOCK * rows + ends, per_block)
    padded = np.concatenate([grid, np.zeros(64, np.uint64)])
    for s in np.unique(sel).tolist():
        if s == 0:
            continue
        own = np.flatnonzero(sel == s)
        span = np.arange(HOLDS[s])
        idx = first[own][:, None] + span
        vals = np.where(idx < stop[own][:, None], padded[idx], np.uint64(0)) << (span.astype(np.uint64) * WIDTH[s])
        words[own] |= np.bitwise_or.reduce(vals, axis=1)
    return words, grid[first[sel == 0]], offsets


def unpack_ids(words: np.ndarray, escapes: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids that ``pack_ids`` packed."""
    out = np.zeros(n, np.uint64)
    if n == 0:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    holds = HOLDS[sel]
    sizes = np.diff(np.append(offsets.astype(np.int64), len(words)))
    block = np.repeat(np.arange(len(offsets)), sizes)
    before = np.cumsum(holds) - holds
    first = before - before[offsets.astype(np.int64)][block] + BLOCK * block
    stop = np.minimum(BLOCK * (block + 1), n)
    for s in np.unique(sel).tolist():
        own = np.flatnonzero(sel == s)
        if s == 0:
            out[first[own]] = escapes
            continue
        span = np.arange(HOLDS[s])
        idx = first[own][:, None] + span
        vals = (words[own][:, None] >> (span.astype(np.uint64) * WIDTH[s])) & np.uint64((1 << int(WIDTH[s])) - 1)
        real = idx < stop[own][:, None]
        out[idx[real]] = vals[real]
    return out


def write_ids(df: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", row_ids: int = ROW_IDS) -> None:
    """Encode every whole text (with the end id) and write the files at ``path`` in ascending id order."""
    ship_package(df.sparkSession)
    kind = df.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("shard", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n_ids", T.LongType()),
         T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("doc_lens", T.ArrayType(T.LongType())),
         T.StructField("words", T.BinaryType()), T.StructField("escapes", T.BinaryType()), T.StructField("offsets", T.BinaryType())]
    )
    end = np.asarray([END_ID], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, before = encoder(vocabulary), TaskContext.get().partitionId(), 0
        docs: list[pa.Scalar] = []
        parts: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            nonlocal before, held
            values = np.frombuffer(b"".join(parts), "<u4").astype(np.uint64)
            words, escapes, offsets = pack_ids(values)
            ids = pa.array([docs], pa.list_(id_type))
            lens = pa.array([[len(p) // 4 for p in parts]], pa.list_(pa.int64()))
            got = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([len(values)], pa.int64()), ids, lens]
                + [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((words, "<u8"), (escapes, "<u8"), (offsets, "<u4"))],
                names=schema.names,
            )
            before, held = before + len(values), 0
            docs.clear(), parts.clear()
            return got

        for batch in batches:
            id_type = batch.schema.field(id_col).type
            for i, ids in zip(batch.column(id_col).to_pylist(), enc.column(batch.column(text_col))):
                own = ids + end
                docs.append(i), parts.append(own)
                held += len(own) // 4
                if held >= row_ids:
                    yield row()
        if docs:
            yield row()

    keys = [F.col(id_col), F.xxhash64(text_col)]
    ordered = df.select(id_col, text_col).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.mapInArrow(encode, schema).write.parquet(path)


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` (and ``ids``, little-endian uint32) of every document in the files."""
    ship_package(spark)
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType
    fields = [T.StructField(id_col, kind), T.StructField("shard", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("own_start", "n_tokens", "ids_crc32")]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids
    names = [f.name for f in fields]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, t: np.frombuffer(batch.column(c)[r].as_py(), t)
                values = unpack_ids(get("words", "<u8"), get("escapes", "<u8"), get("offsets", "<u4"), batch.column("n_ids")[r].as_py())
                raw = values.astype("<u4").tobytes()
                lens = np.asarray(batch.column("doc_lens")[r].as_py(), np.int64)
                at = np.cumsum(lens) - lens
                own = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), lens.tolist())]
                cols = [batch.column("doc_ids")[r].values, pa.array([batch.column("shard")[r].as_py()] * len(lens), pa.int32())]
                cols += [pa.array(at + batch.column("first")[r].as_py()), pa.array(lens), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(own, pa.binary())] * with_ids, names=names)

    needed = files.select("shard", "first", "n_ids", "doc_ids", "doc_lens", "words", "escapes", "offsets")
    docs = needed.mapInArrow(decode, T.StructType(fields))
    # One row per shard (as many as the writer had partitions): where it begins among all ids.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = docs.join(F.broadcast(shards), "shard").withColumn("start", F.col("base") + F.col("own_start"))
    return joined.select(id_col, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def write_and_read(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the files (at ``path`` or in the shared scratch folder) and read every document back."""
    path = path or new_path(df.sparkSession, "simple8b")
    write_ids(df, path, vocabulary, id_col, text_col)
    return read_ids(df.sparkSession, path, id_col)
