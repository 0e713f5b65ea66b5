"""Token ids of whole texts by the ``tokenizers`` library, with a bounded store of words.

Splitting rule of the byte-level vocabularies: a match never runs on past a single space between
two non-blank characters, nor past a single newline, so a text falls into chunks at such places whose
ids can be joined. Texts are taken in slices of a column: words are found and hashed on the raw buffer,
the slice's distinct words that the store lacks go to the library in few calls, parted by newlines,
whose token parts their ids again, and every text's ids are gathered from the store by numpy.

The store holds sorted 64-bit hashes of words and their ids in flat arrays, some 40 bytes a word. It is
bounded in bytes by two generations: the older one, with the words not met since, is dropped when the
younger is full. Two words of one hash would share ids; with a million words held, a new word has
a chance of 5e-14 of that.

A text with other blanks than single spaces and newlines is cut at the safe places alone, and one that
contains the string of an added token goes to the library whole, which finds it first.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from preftable.llm.textbuf import hash_words, mix64, row_of, utf8

GENERATION_BYTES = 32 << 20  # of words held by a worker in each of two generations
CALL_WORDS = 128  # in one text of a call
SLICE_BYTES = 1 << 20  # of texts whose words are looked up together
RUNS = 6  # sorted runs of the younger generation before they are merged

_loaded: dict[str, "ChunkEncoder"] = {}
_BOUNDARY = regex.compile(r"(?<=\S)(?= \S)")
# How a word is led: by nothing (a text's start), a space, or a newline, whose token is stored with it.
START, SPACE, NEWLINE = range(3)
_LEADS = mix64(np.arange(1, 4, dtype=np.uint64))


class _Run:
    """Sorted keys with the ids of each in one flat array."""

    def __init__(self, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        self.keys, self.starts, self.sizes, self.ids = keys, starts, sizes, ids

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.starts.nbytes + self.sizes.nbytes + self.ids.nbytes

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 where it isn't held."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _merged(runs: list[_Run]) -> _Run:
    """One run of all; keys are distinct."""
    keys = np.concatenate([r.keys for r in runs])
    shift = np.cumsum([0, *(len(r.ids) for r in runs)])
    starts = np.concatenate([r.starts + s for r, s in zip(runs, shift.tolist())])
    sizes = np.concatenate([r.sizes for r in runs])
    order = np.argsort(keys)
    starts, sizes = starts[order], sizes[order]
    ids = np.concatenate([r.ids for r in runs])[_ranges(starts, sizes)]
    ends = np.cumsum(sizes, dtype=np.int64)
    return _Run(keys[order], ends - sizes, sizes, ids)


def _empty() -> _Run:
    return _Run(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4"))


class _Store:
    """Two generations of words' ids, by hash."""

    def __init__(self) -> None:
        self.older, self.young = _empty(), []

    def take(self, keys: np.ndarray, make) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(starts, sizes, ids)`` of sorted distinct keys; ``make(places)`` gives ``(sizes, ids)`` of unknown ones."""
        if sum(r.nbytes for r in self.young) > GENERATION_BYTES:
            self.older, self.young = _merged(self.young), []
        sizes, starts, flat, base = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int64), [], 0
        left = np.arange(len(keys))
        for run in [*self.young, self.older]:
            at = run.find(keys[left])
            hit = at >= 0
            own, at = left[hit], at[hit]
            sizes[own] = run.sizes[at]
            starts[own] = base + np.concatenate([[0], np.cumsum(run.sizes[at], dtype=np.int64)])[:-1]
            flat.append(run.ids[_ranges(run.starts[at], run.sizes[at])])
            base += len(flat[-1])
            if run is self.older and len(own):
                self.young.append(_Run(keys[own], starts[own] - (base - len(flat[-1])), sizes[own], flat[-1]))
            left = left[~hit]
        if len(left):
            sizes[left], ids = make(left)
            begins = np.cumsum(sizes[left], dtype=np.int64) - sizes[left]
            starts[left] = base + begins
            flat.append(ids)
            self.young.append(_Run(keys[left], begins, sizes[left], ids))
        if len(self.young) > RUNS:
            self.young = [_merged(self.young)]
        return starts, sizes, np.concatenate(flat) if flat else np.zeros(0, "<u4")


def _odd_rows(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows with any blank but single spaces and newlines between words (or with a control that some call blank)."""
    n = len(off) - 1
    odd = np.zeros(n, bool)
    if not len(data):
        return odd
    blank = (data == 32) | (data == 10)
    bad = ((data < 32) & (data != 10) & ((data >= 9) & (data <= 13) | (data >= 28))) | False
    bad[1:] |= blank[1:] & blank[:-1]  # also across rows: no harm, the row is only cut the slower way
    # Blanks of more than one byte, by their first two bytes.
    high = np.flatnonzero(data >= 0xC2)
    high = high[high + 1 < len(data)]
    a, b = data[high], data[high + 1]
    bad[high] |= ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
    odd[row_of(np.flatnonzero(bad), off)] = True
    full = np.flatnonzero(np.diff(off) > 0)
    odd[full] |= blank[off[full]] | blank[off[full + 1] - 1]
    return odd


class ChunkEncoder:
    """``ids(text)`` equals the library's own ids of the whole text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per Spark task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = line[0]
        self.chunked = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and len(line) == 1
        )
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.store = _Store()

    def library(self, chunk: str) -> bytes:
        return np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        return next(self.column(pa.array([text], pa.large_string())))

    def column(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, little-endian uint32; nulls are empty."""
        data, off = utf8(texts)
        lo, n = 0, len(off) - 1
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE_BYTES, side="right")) - 1))
            yield from self._slice(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            lo = hi

    def _slice(self, data: np.ndarray, off: np.ndarray) -> Iterator[bytes]:
        raw, ends = data.tobytes(), off.tolist()
        text = lambda r: raw[ends[r] : ends[r + 1]].decode()
        if not self.chunked:
            yield from (self.library(text(r)) if ends[r] < ends[r + 1] else b"" for r in range(len(ends) - 1))
            return
        odd = _odd_rows(data, off)
        whole = np.zeros(len(odd), bool)
        for mark in (x.encode() for x in self.added):
            at = raw.find(mark)
            while at >= 0:
                whole[np.searchsorted(off, at, side="right") - 1] = True
                at = raw.find(mark, at + 1)
        start, end, h = hash_words(data, off)
        lead = np.where(data[start - 1] == 32, SPACE, NEWLINE)
        lead[np.isin(start, off)] = START
        row = row_of(start, off)
        plain = ~(odd | whole)[row]
        start, end, lead, row = start[plain], end[plain], lead[plain], row[plain]
        keys, first, inverse = np.unique(mix64(h[plain] ^ _LEADS[lead]), return_index=True, return_inverse=True)
        words = lambda places: [raw[a:b].decode() for a, b in zip(start[first[places]].tolist(), end[first[places]].tolist())]
        at, sizes, ids = self.store.take(keys, lambda places: self._encoded(words(places), lead[first[places]]))
        each = sizes[inverse]
        flat = ids[_ranges(at[inverse], each)].astype("<u4").tobytes()
        upto = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        cut = (4 * upto[np.searchsorted(row, np.arange(len(ends)))]).tolist()
        for r, (o, w) in enumerate(zip(odd.tolist(), whole.tolist())):
            if w:
                yield self.library(text(r))
            elif o:
                yield b"".join([self.library(x) for x in _BOUNDARY.split(text(r))])
            else:
                yield flat[cut[r] : cut[r + 1]]

    def _encoded(self, words: list[str], lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(sizes, ids)`` of words by their lead, in few calls of the library."""
        sizes, parts = np.zeros(len(words), np.int32), []
        order = []
        for after_space in (True, False):
            own = np.flatnonzero((lead == SPACE) == after_space)
            order.append(own)
            # A newline is one token between words, also before a space, and stands in no other.
            space = " " if after_space else ""
            got = []
            for i in range(0, len(own), CALL_WORDS):
                got.append(space + ("\n" + space).join([words[k] for k in own[i : i + CALL_WORDS].tolist()]))
            ids = [x for e in self.tokenizer.encode_batch_fast(got, add_special_tokens=False) for x in (*e.ids, self.newline)]
            ids = np.asarray(ids, "<u4")
            ends = np.flatnonzero(ids == self.newline)
            sizes[own] = np.diff(ends, prepend=-1) - 1
            if after_space:
                parts.append(ids[ids != self.newline])
                continue
            # The newline after a word serves as the one before the next: words that have none drop theirs.
            ids = np.concatenate([np.asarray([self.newline], "<u4"), ids[:-1]]) if len(ids) else ids
            head = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
            led = lead[own] == NEWLINE
            sizes[own] += led
            keep = np.ones(len(ids), bool)
            keep[head[~led]] = False
            parts.append(ids[keep])
        # From the order of the calls to that of the words.
        called = np.concatenate(order)
        flat = np.concatenate(parts)
        back = np.argsort(called)
        begins = np.cumsum(sizes[called], dtype=np.int64) - sizes[called]
        return sizes, flat[_ranges(begins[back], sizes)]


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file (loaded once per worker)."""
    if path not in _loaded:
        _loaded[path] = ChunkEncoder(path)
    return _loaded[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
