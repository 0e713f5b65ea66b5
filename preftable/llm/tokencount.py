"""Unigram token counts by dynamic programming shared over a trie of pre-tokens.

A pre-token is a blank-separated word behind the word mark. Distinct pre-tokens are inserted in a
trie; each node holds the best unigram score of its prefix and the number of pieces on that best
path, computed from the nodes above it when the node is made, so a prefix that many words share is
scored once. The node at which a word ends has its token count; a text's count is the sum over its
words. Nothing is shuffled and the trie of a worker is bounded: with ``MAX_NODES`` nodes it is begun
anew, which changes the work and not the counts.

The vocabulary is a public piece file; a piece's log-probability follows from its rank by Zipf's law
(``-ln((rank + 1) * H)``, H normalising), since piece files of the pair-merging kind hold ranks only.
Characters without a piece cost one byte piece for each UTF-8 byte. Among equal scores the path with
fewer pieces wins.

Defined cases: null, empty or blank texts have zero tokens; repeated rows count one by one; a table
without rows gives no rows; other columns are ignored; texts of any length are counted whole.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from preftable.llm.ship import ship_package

MARK = "▁"
MAX_NODES = 1_000_000
_CHARS = 0x110000

_counters: dict[str, "TrieCounter"] = {}


def read_pieces(path: str) -> tuple[dict[str, float], float]:
    """The log-probability of each piece, and that of one byte piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    total = math.log(sum(1.0 / (i + 1) for i in range(n)))
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return {sp.id_to_piece(i): -math.log(i + 1) - total for i in plain}, -math.log(n + 1) - total


class TrieCounter:
    """Token counts of words; ``scores`` are log-probabilities of pieces."""

    def __init__(self, scores: dict[str, float], byte_score: float, max_nodes: int = MAX_NODES):
        self.scores, self.byte_score, self.max_nodes = scores, byte_score, max_nodes
        self.longest = max(map(len, scores), default=1)
        self._begin()

    def _begin(self) -> None:
        self.child: dict[int, int] = {}  # node * _CHARS + character -> node
        self.score, self.count = array("d", [0.0]), array("q", [0])
        self.terminal: dict[str, int] = {}

    def _insert(self, word: str) -> int:
        if len(self.score) >= self.max_nodes:
            self._begin()
        child, score, count, scores = self.child, self.score, self.count, self.scores
        node, path = 0, [0]
        for i, ch in enumerate(word):
            key = node * _CHARS + ord(ch)
            node = child.get(key)
            if node is None:
                size = len(ch.encode())
                best, pieces = score[path[i]] + self.byte_score * size, count[path[i]] + size
                for j in range(max(0, i + 1 - self.longest), i + 1):
                    s = scores.get(word[j : i + 1])
                    if s is not None:
                        s += score[path[j]]
                        c = count[path[j]] + 1
                        if s > best or s == best and c < pieces:
                            best, pieces = s, c
                node = child[key] = len(score)
                score.append(best), count.append(pieces)
            path.append(node)
        return count[node]

    def tokens(self, text: str | None) -> tuple[int, int]:
        """``(pre-tokens, tokens)`` of a text."""
        words = (text or "").split()
        known, total = self.terminal, 0
        for w in words:
            c = known.get(w)
            if c is None:
                c = self._insert(MARK + w)
                known = self.terminal
                if len(w) <= 64:
                    known[w] = c
            total += c
        return len(words), total


def counter(path: str) -> TrieCounter:
    """The worker's trie for a vocabulary file."""
    if path not in _counters:
        _counters[path] = TrieCounter(*read_pieces(path))
    return _counters[path]


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_pretokens, n_tokens`` of every whole text."""
    ship_package(df.sparkSession)
    schema = T.StructType([df.schema[id_col], T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = counter(vocabulary)
        for batch in batches:
            got = [trie.tokens(x.as_py()) for x in batch.column(text_col)]
            words, tokens = zip(*got) if got else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=schema.names
            )

    return df.select(id_col, text_col).mapInArrow(count, schema)
