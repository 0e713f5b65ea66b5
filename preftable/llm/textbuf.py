"""Vectorised word handling on Arrow string columns (numpy on the raw UTF-8 buffer, no per-word objects).

A word is a maximal run of bytes other than the six ASCII blanks (``[^\\x20\\x09-\\x0D]+``); a row
boundary always ends a word. Hashes are 64-bit and the same in every process: the word's length, mixed
in turn with each eight of its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANKS = b" \t\n\x0b\x0c\r"
SEGMENT = 1 << 20  # bytes hashed at once
LONG_WORD = 512  # longer words are hashed by blake2b

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
# Of eight bytes read at a word's start, those that belong to a word of 0..8 bytes.
_OWN = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | (data - np.uint8(9) < 5)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    arr = pc.fill_null(col.cast(pa.large_string()), "").cast(pa.large_binary())
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def hash_words(data: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, hash)`` of every word, in order; ``lower`` folds A-Z first."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < n:
        hi, step = min(lo + SEGMENT, n), SEGMENT
        while hi < n:  # back to a place between words, or on if a word fills the segment
            ends = np.flatnonzero(_blank(data[lo:hi]) | cut[lo + 1 : hi + 1])
            if len(ends):
                hi = lo + int(ends[-1]) + 1
                break
            step *= 2
            hi = min(lo + step, n)
        out.append(_segment(data[lo:hi], cut[lo : hi + 1], lo, lower))
        lo = hi
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _segment(data: np.ndarray, cut: np.ndarray, base: int, lower: bool):
    if lower:
        data = data + ((data - np.uint8(65) < 26) * np.uint8(32))
    inside = ~_blank(data)
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = e - s
    eights = np.ndarray(len(data), "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    h = mix64((eights[s] & _OWN[np.minimum(size, 8)]) + size.astype(np.uint64) * _BASE)
    more, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(more):
        h[more] = mix64(h[more] * _BASE + (eights[s[more] + at] & _OWN[np.minimum(size[more] - at, 8)]))
        at += 8
        more = more[size[more] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
    return s + base, e + base, h


def part_of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the ascending ``ends`` are at or before each of the ascending positions."""
    met = np.searchsorted(starts, ends)
    return np.repeat(np.arange(len(ends) + 1), np.diff(met, prepend=0, append=len(starts)))


def row_of(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The row in which each of the ascending positions lies."""
    return part_of(starts, off) - 1


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for every run of ``width`` words (of one text: the caller cuts by row)."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    acc = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        acc = acc * _BASE + h[k : len(h) - width + 1 + k]
    return mix64(acc + _U(width))


def text_shingles(h: np.ndarray, width: int) -> np.ndarray:
    """The sorted set of shingle hashes of one text; with fewer words the whole sequence is one."""
    if len(h) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(shingles(h, min(width, len(h))))
