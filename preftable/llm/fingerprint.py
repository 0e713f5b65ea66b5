"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

Every shingle of five lower-cased words (with fewer words the whole sequence is one) is hashed once, by
one function. The top bits of the hash choose one of ``BINS`` bins and each bin keeps its least hash. An
empty bin takes the hash of the filled bin that comes first in the bin's own random order of all bins,
so every filled bin is as likely as any other, and two texts that fill the same bins take from the same
one (optimal densification). Of each bin's hash only the lowest ``BITS`` bits are stored, sixteen bins
to a 64-bit word, written as hexadecimal text.

Two fingerprints agree in a bin with probability J + (1 - J) / 2^BITS, J being the shingle sets' Jaccard
similarity; ``likeness`` inverts that (the bias correction) and cuts the result to 0..1. Its standard
error is at most about 0.035.

All of it is DataFrame functions. A word list or a set of hashes stays within its row, and a value that
a lambda reads is bound once, as the element of an array of one (``_let``).

Defined cases: a null text is empty; texts without a word have the fingerprint of sixteen zero words
followed by ``-``, alike with each other (1.0) and with nothing else (0.0); equal texts have equal
fingerprints. In ``edited_pairs`` null ids come last (smallest), rows that share an id are ordered by the
MD5 of id and text, and rows equal in both are one document of that order, each returned with the same
results; an only document is its own next one. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preftable.operators.indexing import with_row_index

WIDTH = 5
BINS = 256
BITS = 4
ATTEMPTS = 8  # hashed tries of an empty bin before all filled bins are ranked; changes the order, not its fairness
_PER_WORD = 16  # bins in a stored 64-bit word: 64 / BITS
_SHIFT = 56  # 64 - log2(BINS)
_LOW_BITS = 0x1111111111111111
BLANKS = " \t\n\x0b\x0c\r"
NO_WORDS = "0" * (BINS * BITS // 4) + "-"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def _shingle_hashes(words: Column) -> Column:
    """A hash for every run of ``WIDTH`` words; for the whole of a shorter list."""
    # xxhash64 passes over nulls, so a short list hashes the words that it has.
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - WIDTH, F.lit(0)))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WIDTH)]))


def _bin_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, _SHIFT)


def _minima(hashes: Column) -> Column:
    """The least hash of every bin, in the order of bins; an empty bin has its highest possible hash.

    With that mark of every bin among them, the first of each bin in sorted order is its minimum.
    """
    marks = F.array(*[F.lit(_mark(b)) for b in range(BINS)])
    ordered = F.sort_array(F.concat(hashes, marks))
    # Signed order: bins 128..255 come first; the packing below goes by this order throughout.
    return _let(ordered, lambda a: F.filter(a, lambda h, i: (i == 0) | (_bin_of(h) != _bin_of(F.coalesce(F.get(a, i - 1), F.lit(0))))))


def _mark(b: int) -> int:
    value = (b << _SHIFT) | ((1 << _SHIFT) - 1)
    return value - (1 << 64) if value >= 1 << 63 else value


def _is_mark(h: Column) -> Column:
    low = F.lit((1 << _SHIFT) - 1)
    return h.bitwiseAND(low) == low


def _densified(minima: Column) -> Column:
    """Minima with each empty bin filled from the filled bin that comes first in its random order of bins.

    The order is that of ``ATTEMPTS`` hashed tries and then, as tries may all miss when few bins are
    filled, of a hash of (empty bin, filled bin). Later tries aren't made once one has hit.
    """

    def fill(present: Column, filled: Column) -> Column:
        def choose(own: Column) -> Column:
            tries = [F.get(present, F.xxhash64(own, F.lit(t)).bitwiseAND(F.lit(BINS - 1)).cast("int")) for t in range(ATTEMPTS)]
            # Ranks carry the filled bin's place in their low bits.
            ranks = F.transform(filled, lambda at: F.xxhash64(own, at).bitwiseAND(F.lit(-BINS)).bitwiseOR(at))
            return F.coalesce(*tries, F.get(present, F.array_min(ranks).bitwiseAND(F.lit(BINS - 1)).cast("int")))

        return F.transform(present, lambda h, i: F.coalesce(h, choose(i)))

    known = F.transform(minima, lambda h: F.when(~_is_mark(h), h))
    places = lambda p: F.filter(F.transform(p, lambda h, i: F.when(h.isNotNull(), i.cast("long"))), lambda x: x.isNotNull())
    return _let(known, lambda present: _let(places(present), lambda filled: fill(present, filled)))


def _packed(hashes: Column) -> Column:
    """The lowest ``BITS`` bits of every hash, sixteen hashes to a long."""
    low = F.lit((1 << BITS) - 1).cast("long")

    def word(all_: Column, w: Column) -> Column:
        own = F.slice(all_, w * _PER_WORD + 1, F.lit(_PER_WORD))
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, h: F.shiftleft(acc, BITS).bitwiseOR(h.bitwiseAND(low)))

    return _let(hashes, lambda all_: F.transform(F.sequence(F.lit(0), F.lit(BINS // _PER_WORD - 1)), lambda w: word(all_, w)))


def sketch(text: Column) -> Column:
    """The packed sketch of a text: ``BINS`` times ``BITS`` bits as longs; null for a text without words."""
    bare = F.btrim(F.lower(text), F.lit(BLANKS))
    words = F.split(bare, r"[\x20\x09-\x0D]+")
    made = _let(words, lambda w: _packed(_densified(_minima(_shingle_hashes(w)))))
    return F.when(F.length(bare) > 0, made)


def rendered(packed: Column) -> Column:
    """A packed sketch as text, sixteen hexadecimal digits for each long."""
    shown = F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")
    return F.coalesce(shown, F.lit(NO_WORDS))


def packed_again(fingerprint: Column) -> Column:
    """The packed sketch that ``rendered`` wrote."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(BINS // _PER_WORD - 1)), lambda i: F.substring(fingerprint, i * 16 + 1, 16))
    return F.when(fingerprint != NO_WORDS, F.transform(digits, lambda d: F.conv(d, 16, -10).cast("long")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed sketches."""

    def unequal(x: Column) -> Column:
        # One bit for each group of BITS bits that isn't zero.
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(_LOW_BITS)))

    differ = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda acc, x: acc + unequal(x))
    chance = 1.0 / (1 << BITS)
    corrected = (F.lit(1.0) - differ / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1.0 - chance)
    known = F.greatest(F.lit(0.0), F.least(F.lit(1.0), corrected))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(known)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint`` of every row."""
    return df.select(F.col(id_col), rendered(sketch(F.coalesce(F.col(text_col), F.lit("")))).alias("fingerprint"))


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document beside its edited text and its next document in descending order of ids.

    The edited text has the last third of the code points replaced by the first as many of the next
    document. Columns: id, ``next_id``, ``edited`` and the packed sketches ``own``, ``changed`` and
    ``following`` (of text, edited text and next document).

    Texts move once, keyed by the MD5 of id and text: the order is found on keys and lengths alone,
    and a document sends no more of its text than the one before it needs.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), text).cast("binary"))
    slim = df.select(F.col(id_col).alias("__id"), key.alias("__k"), F.floor(F.length(text) / 3).cast("int").alias("need"))
    slim = slim.groupBy("__k").agg(F.first("__id").alias("__id"), F.first("need").alias("need"))
    order = with_row_index(slim, [F.col("__id").desc_nulls_last(), F.col("__k")], name="at").select("__k", "need", "at")
    n = max(order.count(), 1)
    before = order.select(F.pmod(F.col("at") + 1, F.lit(n)).alias("at"), F.col("__k").alias("to"), F.col("need").alias("wanted"))
    route = order.select("__k", "at").join(before, "at").select("__k", "to", "wanted")
    base = df.select(F.col(id_col).alias("__id"), text.alias("__text"), key.alias("__k")).withColumn("__sketch", sketch(F.col("__text")))
    head = F.substring("__text", F.lit(1), F.col("wanted")).alias("head")
    sends = base.join(route, "__k").select(F.col("to").alias("__k"), head, F.col("__id").alias("next_id"), F.col("__sketch").alias("following"))
    both = base.join(sends.dropDuplicates(["__k"]), "__k")
    n_chars = F.length("__text")
    kept = F.substring("__text", F.lit(1), n_chars - F.floor(n_chars / 3).cast("int"))
    both = both.withColumn("edited", F.concat(kept, F.col("head")))
    return both.select(
        F.col("__id").alias(id_col), n_chars.cast("long").alias("n_chars"), "next_id", "edited",
        F.col("__sketch").alias("own"), sketch(F.col("edited")).alias("changed"), "following",
    )


def edited_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``edited_pairs`` as digests, fingerprints and likenesses."""
    pairs = edited_pairs(df, id_col, text_col)
    return pairs.select(
        id_col, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), rendered(F.col("own")).alias("fingerprint"),
        rendered(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"), "next_id",
    )
