"""Fill-in-the-middle texts: every whole text cut in prefix, middle and suffix and put in a new order.

Cuts are drawn in units (runs of letters A-Z and a-z, or one other code point), kept in code points and
made in bytes. A sparse exception index converts between the two: it records only the multibyte
characters of a buffer (place, and the bytes beyond one up to there), so a search among these few gives
the shift of a cut, and what lies between them is arithmetic. Units are found by a mask over the bytes.

The draws of a text are the first 8-digit groups of the hex SHA-256 of ``<seed>:<id>``: two cuts, whether
the text stays plain, and the order. Lost tasks give the same rows again.

Defined cases: a null text is empty, an empty text stays plain, as does one that contains a sentinel; a
null id draws as an empty one; rows that share an id or are repeated whole draw alike, each for its own
text; cuts may coincide, so that a part is empty; a text of any length is cut whole; an empty table
gives no rows; only the id and the results are returned, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from preftable.llm.ship import ship_package
from preftable.llm.textbuf import utf8

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_PERCENT = 10
SPM_PERCENT = 20
SLICE = 4 << 20  # bytes cut at once; a longer text is a slice of its own


class ExceptionIndex:
    """Conversions between code points and bytes of a UTF-8 buffer, from its multibyte characters alone."""

    def __init__(self, data: np.ndarray):
        self.at_byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.at_byte]
        beyond = np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))
        self.excess = np.concatenate([np.zeros(1, np.int64), beyond])
        self.at_char = self.at_byte - self.excess[:-1]

    def to_byte(self, chars: np.ndarray) -> np.ndarray:
        """Bytes before each place between characters."""
        return chars + self.excess[np.searchsorted(self.at_char, chars)]

    def to_char(self, places: np.ndarray) -> np.ndarray:
        """Characters before each place that lies between characters, given in bytes."""
        return places - self.excess[np.searchsorted(self.at_byte, places)]


def unit_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where units begin, in bytes; ``off`` are the rows' offsets, and a row's end always ends a unit."""
    letter = ((data | np.uint8(32)) - np.uint8(97)) < 26
    begins = (data & np.uint8(0xC0)) != 0x80
    joined = letter[1:] & letter[:-1]
    joined[off[(off > 0) & (off < len(data))] - 1] = False
    begins[1:] &= ~joined
    return np.flatnonzero(begins)


def draws(seed: str, key: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def _slices(off: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _cut(data: np.ndarray, off: np.ndarray, keys: list[str], seed: str, plain: int, spm: int, marks: Sequence[bytes]):
    """``n``, form, prefix and middle chars, whether it was cut, and output of the rows of one slice."""
    raw = data.tobytes()
    starts = unit_starts(data, off)
    first = np.searchsorted(starts, off)
    count = np.diff(first)
    h = np.array([draws(seed, k) for k in keys], np.int64).reshape(-1, 4)
    ends = off.tolist()
    moved = (count > 0) & (h[:, 2] % 100 < 100 - plain)
    for r in np.flatnonzero(moved):
        moved[r] = not any(raw.find(m, ends[r], ends[r + 1]) >= 0 for m in marks)
    form = np.where(moved, np.where(h[:, 3] % 100 < spm, "spm", "psm"), "plain")
    cuts = np.sort(h[:, :2] % (count + 1)[:, None], axis=1)
    # The place of the k-th unit of a row; its k beyond the last is the row's end.
    placed = np.append(starts, len(data))
    in_bytes = np.where(cuts < count[:, None], placed[np.minimum(first[:-1, None] + cuts, len(starts))], off[1:, None])
    index = ExceptionIndex(data)
    base = index.to_char(off[:-1])
    spans = index.to_char(in_bytes) - base[:, None]  # in code points, as they are kept
    at = index.to_byte(spans + base[:, None]).tolist()
    p, s, m = marks
    out = []
    for r, kind in enumerate(form.tolist()):
        a, d = ends[r], ends[r + 1]
        b, c = at[r]
        if kind == "psm":
            out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
        elif kind == "spm":
            out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
        else:
            out.append(raw[a:d])
    return count, form, spans[:, 0], spans[:, 1] - spans[:, 0], moved, out


def fill_in_middle(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = "1",
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
    sentinels: Sequence[str] = SENTINELS,
) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` of every row.

    ``n`` counts units. ``form`` is ``plain`` (the text itself; its chars are null), ``psm`` (prefix,
    suffix, middle) or ``spm`` (suffix, prefix, middle), each part after its sentinel. No sentinel may
    overlap another or itself, so that the first match of each is the one that was put there.
    """
    for a in sentinels:
        for b in sentinels:
            if not a or (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")
    marks = [x.encode() for x in sentinels]
    ship_package(df.sparkSession)
    kept = T.StructField("__fim_key", df.schema[id_col].dataType)
    schema = T.StructType(
        [kept, T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
         T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            keys = ["" if x is None else str(x) for x in batch.column(0).to_pylist()]
            for lo, hi in _slices(off):
                own = data[off[lo] : off[hi]]
                n, form, p, m, moved, out = _cut(own, off[lo : hi + 1] - off[lo], keys[lo:hi], seed, plain_percent, spm_percent, marks)
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(form.tolist(), pa.string())]
                cols += [pa.array(x, pa.int64(), mask=~moved) for x in (p, m)]
                cols.append(pa.array(out, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    rows = df.select(F.col(id_col).alias("__fim_key"), F.col(text_col).alias("__fim_text"))
    return rows.mapInArrow(cut, schema).withColumnRenamed("__fim_key", id_col)


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that ``output`` was made of, found again by the sentinels."""
    p, s, m = sentinels

    def after(x: Column, mark: str) -> Column:
        return F.substring_index(x, mark, -1)

    def before(x: Column, mark: str) -> Column:
        return F.substring_index(x, mark, 1)

    middle = after(output, m)
    psm = F.concat(after(before(output, s), p), middle, after(before(output, m), s))
    spm = F.concat(after(before(output, m), p), middle, after(before(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
