"""Quality rules as a short-circuit cascade ordered by rejection per cost.

``learn_order`` times every rule on a sample of rows and counts what it rejects; rules then run in
descending order of ``rejected / seconds`` and a text stops at the first rule that fails it. The
verdict is the conjunction of all rules, so it doesn't depend on the order, the sample or the
machine; only the work does.

Defined cases: a null text is an empty text; an empty text has no words and fails the base rules;
repeated rows and ties are judged one by one; a table without rows gives a table without rows (the
rules then keep their given order). Other columns pass through untouched; a column of the input
named like a result column is replaced by it. Texts of any length are judged whole: the work of a
rule is at most n log n in the words of one text.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from preftable.llm.ship import ship_package
from preftable.llm.textbuf import BLANKS, hash_words, utf8

WINDOW = 8  # words of a window that counts as repeated
SLICE = 500  # texts hashed at once
SAMPLE_ROWS = 4000  # rows (in expectation) on which costs and selectivities are estimated

_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_ASCII_OTHER = bytes(b for b in range(33, 127) if not (65 <= b <= 90 or 97 <= b <= 122))


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


class Facts:
    """What rules ask about one UTF-8 text, each computed on first use."""

    def __init__(self, text: bytes, hashes: np.ndarray | None = None):
        self.text = text
        self._hashes = hashes

    @cached_property
    def hashes(self) -> np.ndarray:
        if self._hashes is not None:
            return self._hashes
        data = np.frombuffer(self.text, np.uint8)
        return hash_words(data, np.array([0, len(data)]))[2]

    @cached_property
    def n_words(self) -> int:
        return len(self.hashes) if self._hashes is not None else len(self.text.split())

    @cached_property
    def word_chars(self) -> int:
        """Code points in words: bytes that are neither blanks nor continuation bytes."""
        return len(self.text.translate(None, BLANKS + _CONTINUATION))

    @cached_property
    def n_symbols(self) -> int:
        return _count(self.text, _SYMBOLS)

    @cached_property
    def n_upper(self) -> int:
        return _count(self.text, _UPPER)

    @cached_property
    def n_lower(self) -> int:
        return _count(self.text, _LOWER)

    @cached_property
    def n_other(self) -> int:
        """ASCII digits and marks."""
        return _count(self.text, _ASCII_OTHER)

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with at least one word."""
        return [x for x in self.text.split(b"\n") if x.strip(BLANKS)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_stutter(self) -> int:
        """Words equal to the word before."""
        return int((self.hashes[1:] == self.hashes[:-1]).sum())

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a window of eight which the text has twice or more (the first one too)."""
        h = self.hashes
        n = len(h) - WINDOW + 1
        if n < 2:
            return 0
        acc = h[:n].copy()
        for k in range(1, WINDOW):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
        order = np.argsort(acc, kind="stable")
        same = acc[order][1:] == acc[order][:-1]
        if not same.any():
            return 0
        twice = np.zeros(n, bool)  # by hash; the words themselves decide
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        words = self.text.split()
        found: dict[tuple, list[int]] = defaultdict(list)
        for i in np.flatnonzero(twice).tolist():
            found[tuple(words[i : i + WINDOW])].append(i)
        edge = np.zeros(len(h) + 1, np.int64)
        for at in found.values():
            if len(at) > 1:
                np.add.at(edge, at, 1)
                np.add.at(edge, np.asarray(at) + WINDOW, -1)
        return int((np.cumsum(edge[:-1]) > 0).sum())


@dataclass(frozen=True)
class Rule:
    """``fails(facts)`` is true for a text to be rejected."""

    name: str
    fails: Callable[[Facts], bool]


BASE_RULES = (
    Rule("too_few_words", lambda f: f.n_words < 20),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 30 * f.n_words),
)
RULES = (
    Rule("symbols", lambda f: 100 * f.n_symbols > 10 * f.n_words),
    Rule("capitals", lambda f: 100 * f.n_upper > 40 * (f.n_upper + f.n_lower)),
    Rule("not_letters", lambda f: 100 * f.n_other > 40 * f.word_chars),
    Rule("duplicate_lines", lambda f: f.n_dup_lines >= 3 and 100 * f.n_dup_lines > 30 * len(f.lines)),
    Rule("stutter", lambda f: 100 * f.n_stutter > 20 * f.n_words),
    Rule("word_length", lambda f: f.word_chars < 2 * f.n_words or f.word_chars > 20 * f.n_words),
)


@dataclass(frozen=True)
class RuleStat:
    name: str
    rows: int
    rejected: int
    seconds: float

    @property
    def value(self) -> float:
        """Rows rejected for each second spent."""
        return self.rejected / max(self.seconds, 1e-9)


def _texts(batch: pa.RecordBatch, col: str) -> Iterator[tuple[int, Facts]]:
    for first in range(0, batch.num_rows, SLICE):
        data, off = utf8(batch.column(col).slice(first, SLICE))
        raw = data.tobytes()
        start, _, h = hash_words(data, off)
        at = np.searchsorted(start, off)
        for i in range(len(off) - 1):
            yield first + i, Facts(raw[off[i] : off[i + 1]], h[at[i] : at[i + 1]])


def learn_order(
    df: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7
) -> list[RuleStat]:
    """Cost and selectivity of each rule on about ``sample_rows`` rows, best first.

    Each rule is timed on its own (with fresh facts), so a rule pays for all it needs. The result
    has one row per rule; ties keep the order given.
    """
    ship_package(df.sparkSession)
    total = df.count()
    part = df.select(text_col).sample(False, min(1.0, sample_rows / max(total, 1)), seed)
    rules = tuple(rules)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, hits, cost = 0, [0] * len(rules), [0.0] * len(rules)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                text = (v or "").encode()
                n += 1
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    hits[k] += bool(rule.fails(Facts(text)))
                    cost[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict(
            {"k": pa.array(range(len(rules)), pa.int32()), "n": pa.array([n] * len(rules), pa.int64()),
             "hits": pa.array(hits, pa.int64()), "cost": pa.array(cost, pa.float64())}
        )

    stats = part.mapInArrow(measure, "k int, n long, hits long, cost double")
    rows = stats.groupBy("k").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("cost").alias("cost")).collect()
    by = {r.k: RuleStat(rules[r.k].name, r.n, r.hits, r.cost) for r in rows}
    found = [by.get(k, RuleStat(r.name, 0, 0, 0.0)) for k, r in enumerate(rules)]
    return sorted(found, key=lambda x: -x.value)


def ordered(rules: Sequence[Rule], stats: Sequence[RuleStat]) -> tuple[Rule, ...]:
    by = {r.name: r for r in rules}
    return tuple(by[s.name] for s in stats)


def cascade(df: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> DataFrame:
    """``df`` with ``rejected_by`` (the first failing rule in this order, null: kept) and ``rules_run``."""
    ship_package(df.sparkSession)
    rules = tuple(rules)
    base = df.drop("rejected_by", "rules_run")
    schema = T.StructType([*base.schema.fields, T.StructField("rejected_by", T.StringType()), T.StructField("rules_run", T.IntegerType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by, ran = [], []
            for _, facts in _texts(batch, text_col):
                k = next((k for k, r in enumerate(rules) if r.fails(facts)), None)
                by.append(None if k is None else rules[k].name)
                ran.append(len(rules) if k is None else k + 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(by, pa.string()), pa.array(ran, pa.int32())],
                names=[*batch.schema.names, "rejected_by", "rules_run"],
            )

    return base.mapInArrow(judge, schema)


def keep_good(df: DataFrame, rules: Sequence[Rule] = (*BASE_RULES, *RULES), text_col: str = "text") -> DataFrame:
    """The rows that every rule passes, with the columns of ``df`` (rejected texts end at their first failure)."""
    rules = ordered(rules, learn_order(df, rules, text_col))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [not any(r.fails(facts) for r in rules) for _, facts in _texts(batch, text_col)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return df.mapInArrow(passed, df.schema)


REPORT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def quality_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The base facts of every text and the cascade's verdict: ``id`` and the columns of ``REPORT``.

    The base facts are asked of all texts; the rules run in learned order, only on texts that the
    base rules keep, and stop at the first failure.
    """
    df = df.select(id_col, text_col)
    rules = ordered(rules, learn_order(df, rules, text_col))
    schema = T.StructType([df.schema[id_col], *T._parse_datatype_string(REPORT).fields])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for _, f in _texts(batch, text_col):
                failed = any(r.fails(f) for r in BASE_RULES)
                kept = not failed and not any(r.fails(f) for r in rules)
                for c, v in zip(cols, (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, failed, kept)):
                    c.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=schema.names
            )

    return df.mapInArrow(report, schema)
