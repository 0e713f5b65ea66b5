"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

A document's set holds the 64-bit hashes of its five-word shingles (A-Z folded). Its sketch has
``T`` coordinates filled by rounds of bin placement: in round i < T every element goes to one hashed
bin with value (i, hash), in round T + j every element goes to bin j; a bin keeps its least value and
rounds end when every bin is full, so after 2T rounds at the latest no coordinate is empty. Equal
coordinates estimate the Jaccard similarity with the concentration of independent ones. ``BANDS``
bands of ``ROWS`` coordinates miss a link of similarity 0.75 with a probability of 2e-6.

Candidates are confirmed on the full sets. Equal sets are one class (its smallest doc_id stands for
it). In a bucket of any size, members are first compared with the bucket's most central member (the
one that shares most buckets with others), so a group of thousands of near copies takes about one
comparison for each member and bucket. Members of buckets that then still hold two components go
through an exact prefix filter (the rarest quarter of a set must meet any partner's) and pairs in
different components are compared too: no link that could join components is left out, and texts
that only share a common passage don't become pairs.

Defined cases: null, empty or blank texts have an empty set and are linked with nothing; texts under
five words have one shingle, the whole sequence; repeated rows are one class, and rows that share a
doc_id are one node; a null doc_id takes no part in links and is its own component (null); a table
without rows gives no rows; other columns are ignored. Long texts are sketched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from preftable.llm.components import components
from preftable.llm.rarity import bucket_counts, by_rarity
from preftable.llm.scratch import staged
from preftable.llm.ship import ship_package
from preftable.llm.textbuf import hash_words, mix64, text_shingles, utf8

WIDTH = 5  # words of a shingle
BANDS, ROWS = 48, 5
COORDINATES = BANDS * ROWS
PERCENT = 75  # 100 * intersection >= PERCENT * union links two sets

_U = np.uint64
_ROUND = _U(0x9E3779B97F4A7C15)
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


def sketches(elements: np.ndarray, sizes: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """A row of ``t`` coordinates for each set; ``elements`` holds the (non-empty) sets end to end."""
    n = len(sizes)
    out = np.full(n * t, _EMPTY, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    for i in range(2 * t):
        if not len(elements):
            break
        h = mix64(elements + _U((i + 1) * int(_ROUND) & 0xFFFFFFFFFFFFFFFF))
        value = (_U(i) << _U(40)) | (h & _U(0xFFFFFFFFFF))
        where = ((h >> _U(40)) * _U(t) >> _U(24)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(out, owner * t + where, value)
        filled = (out.reshape(n, t) != _EMPTY).all(axis=1)
        more = ~filled[owner]
        elements, owner = elements[more], owner[more]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each sketch (different bands never share a key on purpose)."""
    n, t = sketch.shape
    part = sketch.reshape(n, bands, t // bands)
    acc = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (n, 1))
    for k in range(part.shape[2]):
        acc = mix64(acc * _ROUND + part[:, :, k])
    return acc.view(np.int64)


def _sets(batch: pa.RecordBatch, text_col: str) -> list[np.ndarray]:
    data, off = utf8(batch.column(text_col))
    start, _, h = hash_words(data, off, lower=True)
    at = np.searchsorted(start, off)
    return [text_shingles(h[at[i] : at[i + 1]], WIDTH) for i in range(batch.num_rows)]


def _ids(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Two 64-bit hashes of each whole set."""
    first = [int(mix64(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
    second = [int(mix64(s ^ _ROUND).sum(dtype=np.uint64).view(np.int64)) for s in sets]
    return pa.array(first, pa.int64()), pa.array(second, pa.int64())


def sketch_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, s1, s2, bands``: set size, set hashes and band keys (none for an empty set)."""
    ship_package(df.sparkSession)
    schema = T.StructType([df.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("n_shingles", "s1", "s2")), T.StructField("bands", T.ArrayType(T.LongType()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):  # bounds the memory of a round
                batch = whole.slice(at, 500)
                sets = _sets(batch, text_col)
                sizes = np.array([len(s) for s in sets])
                real = sizes > 0
                keys = band_keys(sketches(np.concatenate(sets), sizes[real])) if real.any() else np.zeros((0, BANDS), np.int64)
                rows = iter(keys)
                bands = pa.array([next(rows) if r else [] for r in real], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(sizes, pa.int64()), *_ids(sets), bands], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(sketch, schema)


def set_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``node, n, items``: the sorted shingle hashes of each non-empty set as bytes."""
    schema = T.StructType([T.StructField("node", df.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("items", T.BinaryType())])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch, text_col)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=schema.names,
            )

    return df.select(id_col, text_col).mapInArrow(full, schema).filter("n > 0")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the similarity."""
    sizes = sets.select("node", "n").distinct()
    near = pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    near = near.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b").distinct()
    both = near.join(sets.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b").join(sets.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a")
    schema = pairs.select("a", "b").schema

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ia"), batch.column("ib")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return both.select("a", "b", "ia", "ib").mapInArrow(confirm, schema).distinct()


def across(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs ``a, b`` of sets with different ``label`` that share a token of their prefixes.

    Two sets of sizes n and m can reach the similarity only if they have a common token among the
    first ``n - ceil(p * n) + 1`` and ``m - ceil(p * m) + 1`` of any common order of tokens; if the
    first such token has ``i`` and ``j`` tokens before it, at most ``min(n - i, m - j)`` are common.
    """
    counts = bucket_counts(sets.select("items"), lambda batch: np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64))
    order = sets.sparkSession.sparkContext.broadcast(counts)
    schema = T.StructType([*(sets.schema[c] for c in ("node", "label", "n")), T.StructField("pos", T.LongType()), T.StructField("key", T.LongType())])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for x in batch.column("items"):
                items = np.frombuffer(x.as_py(), np.uint64)
                keys.append(by_rarity(items, order.value)[: len(items) + (-len(items) * percent // 100) + 1])
            row = np.repeat(np.arange(batch.num_rows), [len(k) for k in keys])
            pos = pa.array(np.concatenate([np.arange(len(k)) for k in keys]) if keys else [], pa.int64())
            own = batch.select(["node", "label", "n"]).take(pa.array(row))
            key = pa.array(np.concatenate(keys).view(np.int64) if keys else [], pa.int64())
            yield pa.RecordBatch.from_arrays([*own.columns, pos, key], names=schema.names)

    keys = sets.select("node", "label", "n", "items").mapInArrow(prefixes, schema)
    mixed = keys.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("key")
    few = staged(keys.join(mixed, "key"), "prefixes")
    x, y = few.alias("x"), few.alias("y")
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))
    near &= 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    most = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    near &= (100 + percent) * most >= percent * (F.col("x.n") + F.col("y.n"))
    return x.join(y, near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _some_rows_empty(table: DataFrame, id_col: str) -> bool:
    """Whether an id has rows with an empty set and rows with others."""
    ids = table.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"))
    return not ids.filter("lo = 0 AND hi > 0").isEmpty()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row of ``df``."""
    docs = df.select(id_col, text_col)
    table = staged(sketch_table(docs, id_col, text_col), "sketches")
    sets_key = ["s1", "s2", "n_shingles"]
    real = table.filter((F.col("n_shingles") > 0) & F.col(id_col).isNotNull())
    classes = staged(real.groupBy(*sets_key).agg(F.min(id_col).alias("node"), F.first("bands").alias("bands")), "classes")

    # Buckets with two members or more, and the most central member of each.
    spread = classes.select("node", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = staged(spread.join(shared, "key"), "members")
    weight = members.groupBy("node").agg(F.sum(F.col("m") - 1).alias("w"))
    centre = members.join(weight, "node").groupBy("key").agg(F.min(F.struct((-F.col("w")).alias("w"), "node"))["node"].alias("centre"))
    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    spokes = staged(members.join(centre, "key").filter("node != centre").select(*ends("node", "centre")).distinct(), "spokes")

    wanted = members.select(F.col("node").alias(id_col)).distinct()
    sets = staged(set_table(docs.join(wanted, id_col, "left_semi"), id_col, text_col), "sets")
    links = staged(verified(spokes, sets), "spoke-links")

    # What is left: members of buckets that hold more than one component.
    label = components(links)
    placed = members.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("key")
    open_ = placed.join(mixed, "key").select("node", "label").distinct()
    rest = across(staged(sets.join(open_, "node"), "open")).join(spokes, ["a", "b"], "left_anti")
    more = staged(verified(staged(rest, "rest"), sets), "rest-links")

    # Classes that share an id are one component.
    repeated = staged(real.groupBy(id_col).agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(id_col), "repeated-ids")
    links = links.unionByName(more)
    if not repeated.isEmpty():
        nodes = real.join(repeated, id_col, "left_semi").select(id_col, *sets_key).distinct().join(classes.select(*sets_key, "node"), sets_key)
        least = nodes.groupBy(id_col).agg(F.min("node").alias("a"))
        links = links.unionByName(nodes.join(least, id_col).filter("a != node").select("a", F.col("node").alias("b")).distinct())
    label = staged(components(links), "labels")
    known = classes.select(*sets_key, "node").join(label, "node", "left").select(*sets_key, F.coalesce("label", "node").alias("component_id"))
    out = table.drop("bands").join(known, sets_key, "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(id_col)))
    if _some_rows_empty(table, id_col):  # a row without words goes with the rows of its id that have some
        whole = out.filter("n_shingles > 0").groupBy(id_col).agg(F.min("component_id").alias("__c"))
        out = out.join(whole, id_col, "left").withColumn("component_id", F.coalesce("__c", "component_id")).drop("__c")
    return out.select(id_col, "n_shingles", "component_id", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stand for their group, all columns kept; of rows that share an id one stays (the
    one whose columns' hash is least; rows without an id all stay)."""
    kept = near_duplicates(df, id_col, text_col).filter("kept").select(id_col).distinct()
    left = df.join(kept, df[id_col].eqNullSafe(kept[id_col]), "left_semi")
    ids = df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("__n"))
    repeated = staged(ids.filter("__n > 1").select(F.col(id_col).alias("__id")), "repeated-rows")
    if repeated.isEmpty():
        return left
    mine = left[id_col] == repeated["__id"]
    # One row of each such id, combined before the shuffle, so an id with very many rows stays spread.
    rows = left.join(repeated, mine, "left_semi").select(id_col, F.struct(*df.columns).alias("__row"), F.xxhash64(*df.columns).alias("__h"))
    one = rows.groupBy(id_col).agg(F.min_by("__row", "__h").alias("__row")).select("__row.*")
    return left.join(repeated, mine, "left_anti").unionByName(one)
