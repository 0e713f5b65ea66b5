"""A global order of tokens by rarity, from counts in a fixed number of hash buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 17  # the counts that reach the driver, whatever the corpus


def bucket_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def bucket_counts(df: DataFrame, tokens: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """How often the tokens of all rows fall in each bucket; a task sends a row for each bucket it has met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(bucket_of(tokens(batch)), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in df.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def by_rarity(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The tokens from rare to frequent. Any order that all sets share is right for prefix filters;
    rare tokens first keeps their candidates few. Ties go by hash."""
    return tokens[np.lexsort((tokens, counts[bucket_of(tokens)]))]
