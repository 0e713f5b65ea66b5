"""Near-duplicate lines by an exact set-similarity join; later matches are removed.

A line's tokens are its distinct words. Every line with a word takes part, unless ``min_tokens`` asks for
more; lines of up to three tokens can only match equal ones, which their set's hash finds. A line is
removed if an earlier one, by (doc_id, line number), has a Jaccard similarity of ``PERCENT``/100 or
more. Tokens are ordered by rarity (counts over the whole corpus, see ``rarity``). Two lines of n and
m tokens can match only if

* prefix: they share one of their first ``n - ceil(tn) + 1`` and ``m - ceil(tm) + 1`` tokens, and for
  every l, l of the first ``n - ceil(tn) + l``: short lines, whose rare tokens are often frequent
  words, are keyed by pairs of tokens (l = 2), longer ones by single tokens;
* length: ``t * max(n, m) <= min(n, m)``;
* position: with i and j tokens before the first shared one, ``min(n - i, m - j)`` reaches the
  overlap that the similarity needs;
* bitmap: a set's tokens set bits of a 64-bit word (two words for long lines), and two maps can't
  differ in more bits than the sets differ in tokens.

Entries (key, line) are shuffled once, packed in parcels by bucket of keys (the buckets grow with the
corpus); a task sorts one bucket at a time and emits the candidate pairs of its runs of equal keys.
Equal token sets are found in the same pass (keyed by their hash; a task first drops the copies it
sees itself, so a line that a third of the corpus repeats stays small). A line is first compared with
its likeliest candidate of each run alone (the bitmap that differs least); only lines that this
doesn't remove meet their other candidates afterwards, so a group of thousands of similar lines takes
about one comparison for each line and key. In runs of more than ``RUN`` different lines, a line with
more than ``KEPT`` candidates doesn't list them: a later join finds them again among the run's lines
that are someone's candidate. The texts are shuffled once for the full sets of all lines with
candidates, and candidates are verified on these.

Defined cases: null, empty and blank texts have no lines with tokens; rows with a null id take no
part and keep their text; rows that share an id are one document; a table without rows gives no
rows; other columns pass through under any name. Texts and lines of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from preftable.llm.rarity import BUCKETS, bucket_counts, bucket_of
from preftable.llm.scratch import release, staged
from preftable.llm.ship import ship_package
from preftable.llm.textbuf import hash_words, mix64, part_of, row_of, utf8

PERCENT = 80
MIN_TOKENS = 1  # distinct words of a line that takes part
FEWEST = 4  # tokens of the smallest set that a different one can match: 4 of 5
SHORT = 12  # pairs with a line of at most so many tokens are found by pairs of tokens
RUN = 64  # lines of a run that are compared all with all at once
KEPT = 16  # candidates that a line of a longer run lists itself
WIDE = 40
BUCKET_WORDS = 500_000  # words of the corpus for each bucket of keys, which a task reads at once
SLICE = 500  # texts handled at once

_U = np.uint64
_CLASS, _COPY = -1, -2  # in place of n: an entry that stands for a whole line (n in pos), a known copy


def _required(n: np.ndarray) -> np.ndarray:
    return -(-n * PERCENT // 100)


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Each bucket's place among the distinct counts."""
    return np.unique(counts, return_inverse=True)[1]


def _token_order(number: np.ndarray, h: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The order by line number, then from rare to frequent, ties by the hash's bits past those that name
    its bucket, then all of them: as one 64-bit key where that decides."""
    rank, rest = ranks[bucket_of(h)], h << _U(BUCKETS.bit_length() - 1)
    # In the key: the line, the count's rank, and as much of the hash as there is room for.
    top = 64 - int(number[-1]).bit_length() if len(number) else 64
    low = top - int(ranks.max()).bit_length()
    if 20 <= low < top < 64:
        key = (number.astype(np.uint64) << _U(top)) | (rank.astype(np.uint64) << _U(low)) | (rest >> _U(64 - low))
        order = np.argsort(key)
        a, b = order[1:], order[:-1]
        if not ((key[a] == key[b]) & (h[a] != h[b])).any():
            return order
    return np.lexsort((h, rest, rank, number))


class Lines:
    """The token sets of the lines of a batch, each sorted from rare to frequent (ties by hash)."""

    def __init__(self, batch: pa.RecordBatch, text_col: str, ranks: np.ndarray, min_tokens: int = MIN_TOKENS):
        data, off = utf8(batch.column(text_col))
        start, _, h = hash_words(data, off)
        breaks = np.flatnonzero(data == 10)
        row = row_of(start, off)
        line = part_of(start, breaks) - np.searchsorted(breaks, off[:-1])[row] if len(start) else row
        where = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(line, prepend=-1)) if len(row) else row
        number = np.zeros(len(row), np.int64)
        number[where[1:]] = 1
        number = np.cumsum(number)
        order = _token_order(number, h, ranks)
        number, h = number[order], h[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (number[1:] != number[:-1]) | (h[1:] != h[:-1])
        number, h = number[keep], h[keep]
        n = np.bincount(number, minlength=len(where))
        big = n >= min_tokens
        self.tokens = h[big[number]] if len(h) else h
        self.row, self.line, self.n = row[where][big], line[where][big], n[big]
        self.at = np.cumsum(self.n) - self.n

    def items(self, k: int) -> np.ndarray:
        return self.tokens[self.at[k] : self.at[k] + self.n[k]]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each whole set."""
        if not len(self.n):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return tuple(mix64(np.add.reduceat(mix64(self.tokens ^ _U(s)), self.at)) for s in (0x51, 0xA7))

    def bitmaps(self) -> tuple[np.ndarray, np.ndarray]:
        """64 bits in the first word, or 128 in both for lines of more than ``WIDE`` tokens."""
        if not len(self.n):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bit = _U(1) << (self.tokens & _U(63))
        second = np.repeat(self.n > WIDE, self.n) & ((self.tokens & _U(64)) > 0)
        return tuple(np.bitwise_or.reduceat(np.where(second == w, bit, _U(0)), self.at).view(np.int64) for w in (False, True))

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(line, key, position)`` of every prefix key."""
        one = np.flatnonzero(self.n > SHORT)
        size = self.n[one] - _required(self.n[one]) + 1
        line = np.repeat(one, size)
        pos = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
        found = [(line, mix64(self.tokens[self.at[line] + pos]), pos)] if len(line) else []
        for n in range(FEWEST, SHORT * 100 // PERCENT + 1):  # whatever a line of SHORT tokens can match
            two = np.flatnonzero(self.n == n)
            if len(two):
                i, j = np.triu_indices(n - int(_required(np.array(n))) + 2, 1)
                a, b = self.tokens[self.at[two][:, None] + i], self.tokens[self.at[two][:, None] + j]
                found.append((np.repeat(two, len(i)), mix64(a * _U(3) + mix64(b)).ravel(), np.tile(i, len(two))))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


_FOUND = "kind int, a_doc long, a_line long, b_doc long, b_line long, key long, n long, pos long, bits long, more long"
# The columns of a parcel, each stored whole: a parcel holds what one slice has for one bucket of keys.
_PARCEL = (("key", "<i8"), ("bits", "<i8"), ("more", "<i8"), ("doc", "<i8"), ("cls", "<u4"), ("line", "<i4"), ("n", "<i4"), ("pos", "<i4"))
_ENTRY = sum(np.dtype(t).itemsize for _, t in _PARCEL)


def _parcels(docs: DataFrame, id_col: str, text_col: str, ranks, buckets: int, min_tokens: int) -> DataFrame:
    """``bucket, parcel``: every line (by the hash of its set) and every prefix key of every line."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = Lines(batch, text_col, ranks.value, min_tokens)
            doc = batch.column(id_col).cast(pa.int64()).to_numpy(zero_copy_only=False)[x.row]
            h1, h2 = x.hashes()
            order = np.lexsort((x.line, doc, h2, h1))
            copy = np.zeros(len(order), bool)
            a, b = order[1:], order[:-1]
            copy[a] = (h1[a] == h1[b]) & (h2[a] == h2[b]) & ((doc[a] != doc[b]) | (x.line[a] != x.line[b]))
            line, key, pos = x.keys()
            fresh = ~copy[line]
            line, key, pos = line[fresh], key[fresh], pos[fresh]
            spread = mix64(h1 + x.line.astype(np.uint64) + doc.astype(np.uint64) * _U(977))
            key = np.concatenate([np.where(copy, spread, h1), key])
            who = np.concatenate([np.arange(len(doc)), line])
            bits, more = x.bitmaps()
            n = np.concatenate([np.where(copy, _COPY, _CLASS), x.n[line]])
            at = np.concatenate([x.n, pos])
            own = {"key": key.view(np.int64), "bits": bits[who], "more": more[who], "doc": doc[who], "cls": h2[who] >> _U(32), "line": x.line[who], "n": n, "pos": at}
            bucket = ((key >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cols = [own[c][by].astype(t) for c, t in _PARCEL]
            which, first = np.unique(bucket[by], return_index=True)
            ends = np.append(first[1:], len(by))
            blobs = [b"".join([c[i:j].tobytes() for c in cols]) for i, j in zip(first.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "parcel"])

    return docs.mapInArrow(rows, "bucket long, parcel binary")


def _opened(parcels: list[bytes]) -> dict[str, np.ndarray]:
    cols: dict[str, list[np.ndarray]] = {c: [] for c, _ in _PARCEL}
    for p in parcels:
        size, at = len(p) // _ENTRY, 0
        for c, t in _PARCEL:
            cols[c].append(np.frombuffer(p, t, size, at))
            at += size * np.dtype(t).itemsize
    return {c: np.concatenate(v).astype(np.uint32 if c == "cls" else np.int64) for c, v in cols.items()}


def _pairs(key, doc, line, n, pos, bits, more) -> Iterator[pa.RecordBatch]:
    """Candidates of complete runs; rows are different lines, sorted by key."""
    if not len(key):
        return
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if key[0] > np.iinfo(np.int64).min else key[0] + 1))
    size = np.diff(np.append(first, len(key)))
    def fitting(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs (earlier, later) that pass the filters, and the bits in which they differ."""
        swap = (doc[i] > doc[j]) | ((doc[i] == doc[j]) & (line[i] > line[j]))
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        both = (n[i] > WIDE) & (n[j] > WIDE)
        differ = np.where(both, _bits(bits[i] ^ bits[j]) + _bits(more[i] ^ more[j]), _bits((bits[i] | more[i]) ^ (bits[j] | more[j])))
        most = np.minimum(np.minimum(n[i] - pos[i], n[j] - pos[j]), (n[i] + n[j] - differ) // 2)
        fits = (PERCENT * np.maximum(n[i], n[j]) <= 100 * np.minimum(n[i], n[j])) & ((100 + PERCENT) * most >= PERCENT * (n[i] + n[j]))
        return i[fits], j[fits], differ[fits]

    def told(kind, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        return _found(kind, doc[i], line[i], doc[j], line[j], key[i], n[i], pos[i], bits[i], more[i])

    for m in np.unique(size[(size > 1) & (size <= RUN)]).tolist():
        runs = first[size == m]
        a, b = np.triu_indices(m, 1)
        step = max(1, 500_000 // len(a))
        for s in range(0, len(runs), step):
            i, j, differ = fitting((runs[s : s + step, None] + a).ravel(), (runs[s : s + step, None] + b).ravel())
            order = np.lexsort((line[i], doc[i], differ, j))
            i, j = i[order], j[order]
            kind = np.full(len(i), 3)
            kind[np.flatnonzero(np.diff(j, prepend=-1))] = 1  # the likeliest match of each line
            yield told(kind, i, j)
    for f, m in zip(first[size > RUN].tolist(), size[size > RUN].tolist()):
        own = np.arange(f, f + m)
        own = own[np.argsort(n[own], kind="stable")]  # partners lie in a window of lengths
        until = np.searchsorted(100 * n[own], n[own] * 100 * 100 // PERCENT, side="right")
        best, best_differ, hits = np.full(m, -1), np.full(m, 1 << 30), np.zeros(m, np.int64)
        partner, listed = np.zeros(m, bool), []
        at = 0
        while at < m:
            upto = at + 1
            while upto < m and (until[at:upto + 1] - np.arange(at, upto + 1)).sum() < 500_000:
                upto += 64
            upto = min(upto, m)
            width = until[at:upto] - np.arange(at, upto) - 1
            i = np.repeat(np.arange(at, upto), width)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width)
            i, j, differ = fitting(own[i], own[j])
            order = np.lexsort((line[i], doc[i], differ, j))
            i, j, differ = i[order], j[order], differ[order]
            np.add.at(hits, j - f, 1)
            partner[i - f] = True
            few = hits[j - f] <= KEPT
            listed.append((i[few], j[few]))
            top = np.flatnonzero(np.diff(j, prepend=-1))
            better = top[differ[top] < best_differ[j[top] - f]]
            best[j[better] - f], best_differ[j[better] - f] = i[better], differ[better]
            at = upto
        has = np.flatnonzero(best >= 0)
        yield told(1, best[has], has + f)
        i, j = (np.concatenate(x) for x in zip(*listed))
        other = (hits[j - f] <= KEPT) & (best[j - f] != i)
        yield told(3, i[other], j[other])
        several = np.flatnonzero(hits > KEPT) + f  # lines with many candidates, and all lines that may be these
        if len(several):
            partners = np.flatnonzero(partner) + f
            yield told(2, several, several)
            yield told(4, partners, partners)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64)).astype(np.int64)


def _found(kind: int | np.ndarray, *cols: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(cols[0]), kind), pa.int32()), *(pa.array(c, pa.int64()) for c in cols)]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _FOUND.split(", ")])


def _bucket(parcels: list[bytes]) -> Iterator[pa.RecordBatch]:
    """What one bucket of keys tells: copies (kind 0), candidate pairs (1: a line's likeliest in its run,
    3: others) and, of long runs, lines with many candidates (2) and the candidates of any line (4)."""
    x = _opened(parcels)
    known = x["n"] == _COPY
    zero = lambda m: [np.zeros(int(m.sum()), np.int64)] * 5
    yield _found(0, x["doc"][known], x["line"][known], x["doc"][known], x["line"][known], *zero(known))
    by = np.argsort(x["key"])
    key = x["key"][by]
    twin = np.zeros(len(key), bool)
    twin[1:] = key[1:] == key[:-1]
    twin[:-1] |= twin[1:]
    by = by[twin & ~known[by]]  # a key met once says nothing
    x = {c: v[by] for c, v in x.items()}
    # Equal lines of a run: by its hashes, its size and its bitmaps.
    lined = x["n"] == _CLASS
    size = np.where(lined, x["pos"], x["n"])
    same = [x["key"], lined, size, x["cls"], x["bits"], x["more"]]
    sign = np.zeros(len(by), np.uint64)
    for c in same[1:]:
        sign = mix64(sign + c.astype(np.uint64))
    order = np.lexsort((x["line"], x["doc"], sign, x["key"]))
    x, lined = {c: v[order] for c, v in x.items()}, lined[order]
    equal = np.ones(len(order), bool)
    equal[:1] = False
    for c in same:
        c = c[order]
        equal[1:] &= c[1:] == c[:-1]
    first = np.maximum.accumulate(np.where(equal, 0, np.arange(len(order)))) if len(order) else order
    again = lined & equal & ((x["doc"] != x["doc"][first]) | (x["line"] != x["line"][first]))
    yield _found(0, x["doc"][first][again], x["line"][first][again], x["doc"][again], x["line"][again], *zero(again))
    keep = ~lined & ~equal
    yield from _pairs(*(x[c][keep] for c in ("key", "doc", "line", "n", "pos", "bits", "more")))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_bucket`` over rows sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for bucket, parcel in zip(batch.column(0).to_pylist(), batch.column(1)):
            if bucket != now and held:
                yield from _bucket(held)
                held = []
            now = bucket
            held.append(parcel.as_py())
    if held:
        yield from _bucket(held)


def _cut_lines(batch: pa.RecordBatch, text_col: str, least: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """``(row, line, set)`` of the lines listed in ``lines``: the sorted hashes of each one's words.

    Of rows that share an id, some may not have a listed line, or too few words in it.
    """
    data, off = utf8(batch.column(text_col))
    lists = batch.column("lines")
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    line = lists.flatten().to_numpy(zero_copy_only=False)
    edges = np.concatenate([np.flatnonzero(data == 10), [len(data)]])
    at = np.searchsorted(edges, off[:-1])[row] + line  # the break that ends the line, if its text doesn't
    has = (line == 0) | (edges[np.minimum(at, len(edges)) - 1] < off[row + 1]) & (at < len(edges))
    row, line, at = row[has], line[has], at[has]
    start = np.where(line == 0, off[row], edges[at - 1] + 1)
    end = np.minimum(edges[at], off[row + 1])
    raw = memoryview(data)
    cut = np.frombuffer(b"".join([raw[i:j] for i, j in zip(start.tolist(), end.tolist())]), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(end - start)])
    words, _, h = hash_words(cut, bounds)
    which = row_of(words, bounds)
    order = np.lexsort((h, which))
    which, h = which[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (which[1:] != which[:-1]) | (h[1:] != h[:-1])
    which, h = which[fresh], h[fresh]
    to = np.searchsorted(which, np.arange(len(row) + 1))
    big = np.flatnonzero(np.diff(to) >= least)
    return row[big], line[big], [h[i:j].tobytes() for i, j in zip(to[big].tolist(), to[big + 1].tolist())]


def _line_sets(found: DataFrame, docs: DataFrame, id_col: str, text_col: str, min_tokens: int) -> DataFrame:
    """``doc, line, items``: the full sets of all lines with candidates."""
    sides = [F.struct(F.col(f"{s}_doc").alias("doc"), F.col(f"{s}_line").alias("line")) for s in "ab"]
    wanted = found.filter("kind in (1, 3, 4)").select(F.inline(F.array(*sides))).groupBy("doc").agg(F.collect_set("line").alias("lines"))
    texts = docs.join(wanted, docs[id_col] == wanted["doc"]).select("doc", "lines", text_col)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            row, line, items = _cut_lines(batch, text_col, max(FEWEST, min_tokens))
            doc = batch.column("doc").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, pa.array(line, pa.int64()), pa.array(items, pa.binary())], names=["doc", "line", "items"])

    return staged(texts.mapInArrow(full, "doc long, line long, items binary"), "line-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The lines ``doc, line`` that an earlier one matches, of candidate pairs a (earlier) and b."""
    for s in "ab":
        pairs = pairs.join(sets.select(F.col("doc").alias(f"{s}_doc"), F.col("line").alias(f"{s}_line"), F.col("items").alias(f"{s}_items")), [f"{s}_doc", f"{s}_line"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for u, v in zip(batch.column("a_items"), batch.column("b_items")):
                u, v = np.frombuffer(u.as_py(), np.uint64), np.frombuffer(v.as_py(), np.uint64)
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                common = int((v[at] == u).sum())
                ok.append(100 * common >= PERCENT * (len(u) + len(v) - common))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["b_doc", "b_line"]).rename_columns(["doc", "line"])

    checked = pairs.select("b_doc", "b_line", "a_items", "b_items").mapInArrow(confirm, "doc long, line long")
    return staged(checked.distinct(), "near-lines")


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``doc_id, line_no, exact``: every line to remove (line numbers from 0 at each ``\\n``; exact: an
    earlier line has the same words). Lines of fewer than ``min_tokens`` distinct words take no part."""
    spark = df.sparkSession
    ship_package(spark)
    docs = df.select(id_col, text_col).filter(F.col(id_col).isNotNull())

    def words(batch: pa.RecordBatch) -> np.ndarray:
        return hash_words(*utf8(batch.column(0)))[2]

    frequency = bucket_counts(docs.select(text_col), words)
    ranks = spark.sparkContext.broadcast(_ranks(frequency))
    buckets = max(1, int(frequency.sum()) // BUCKET_WORDS)
    dealt = _parcels(docs, id_col, text_col, ranks, buckets, min_tokens).repartition("bucket").sortWithinPartitions("bucket")
    found = staged(dealt.mapInArrow(_runs, _FOUND), "line-candidates")
    release(spark)
    copies = found.filter("kind = 0").select(F.col("b_doc").alias("doc"), F.col("b_line").alias("line"))
    pairs = found.filter("kind = 1").select("a_doc", "a_line", "b_doc", "b_line").distinct()
    sets = _line_sets(found, docs, id_col, text_col, min_tokens)
    near = _verified(pairs, sets)
    release(spark)

    # Lines that their likeliest candidates don't remove meet the other ones.
    lines = ["a_doc", "a_line", "b_doc", "b_line"]
    removed = near.select(F.col("doc").alias("b_doc"), F.col("line").alias("b_line"))
    rest = found.filter("kind = 3").select(lines).distinct().join(removed, ["b_doc", "b_line"], "left_anti").select(lines)
    long = ["key", F.col("a_doc").alias("doc"), F.col("a_line").alias("line"), "n", "pos", "bits", "more"]
    open_ = found.filter("kind = 2").select(long).join(near, ["doc", "line"], "left_anti")
    if not open_.isEmpty():
        x, y = found.filter("kind = 4").select(long).alias("x"), open_.alias("y")
        earlier = (F.col("x.doc") < F.col("y.doc")) | ((F.col("x.doc") == F.col("y.doc")) & (F.col("x.line") < F.col("y.line")))
        fits = PERCENT * F.greatest("x.n", "y.n") <= 100 * F.least("x.n", "y.n")
        most = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
        xor = lambda c: F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")))
        folded = F.bit_count(F.expr("(x.bits | x.more) ^ (y.bits | y.more)"))
        differ = F.when((F.col("x.n") > WIDE) & (F.col("y.n") > WIDE), xor("bits") + xor("more")).otherwise(folded)
        most = F.least(most, F.floor((F.col("x.n") + F.col("y.n") - differ) / 2))
        fits &= (100 + PERCENT) * most >= PERCENT * (F.col("x.n") + F.col("y.n"))
        met = x.join(y, (F.col("x.key") == F.col("y.key")) & earlier & fits)
        met = met.select(*(F.col(f"{t}.{c}").alias(f"{s}_{c}") for s, t in (("a", "x"), ("b", "y")) for c in ("doc", "line")))
        rest = rest.unionByName(met).distinct()
    rest = staged(rest.join(pairs, lines, "left_anti"), "line-rest")
    if not rest.isEmpty():
        near = near.unionByName(_verified(rest, sets))
        release(spark)
    marked = copies.withColumn("exact", F.lit(True)).unionByName(near.withColumn("exact", F.lit(False)))
    marked = marked.groupBy("doc", "line").agg(F.max("exact").alias("exact"))
    return marked.select(F.col("doc").alias(id_col), F.col("line").alias("line_no"), "exact")


def without_lines(df: DataFrame, lines: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with those lines taken out of its texts; a document that loses its last word goes.

    A column ``n_chars`` is set to the new length where lines went.
    """
    ship_package(df.sparkSession)
    names = df.columns
    key, out_col = "__id", "__gone"
    while {key, out_col} & {n.lower() for n in names}:
        key, out_col = f"_{key}", f"_{out_col}"
    gone = lines.groupBy(F.col(id_col).alias(key)).agg(F.collect_list("line_no").alias(out_col))
    joined = df.join(gone, df[id_col] == gone[key], "left").drop(key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, out in zip(batch.column(text_col).to_pylist(), batch.column(out_col).to_pylist()):
                if out:
                    out = set(out)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out)
                keep.append(not out or bool(text.encode().split()))
                texts.append(text)
            cols = {n: batch.column(n) for n in names}
            cols[text_col] = pa.array(texts, cols[text_col].type)
            if "n_chars" in cols:
                length = pa.array([None if t is None else len(t) for t in texts], cols["n_chars"].type)
                cols["n_chars"] = pc.if_else(pc.is_valid(batch.column(out_col)), length, cols["n_chars"])
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(cut, df.schema)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the lines that an earlier line matches."""
    return without_lines(df, repeated_lines(df, id_col, text_col), id_col, text_col)
