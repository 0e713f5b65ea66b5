"""Spelling variants: words one edit apart, each grouped under the far more frequent form it varies.

Counting is one aggregate over the words of all texts. The pairs come from asymmetric q-chunks: of two
words the shorter one (of equal ones, each) contributes two disjoint chunks of half its length, one at
its start and one at its end, and the other one its positional grams of that length. One insertion,
deletion or replacement touches at most one of the disjoint chunks, so the other stands in the longer
word too, shifted by one place at most; grams that no chunk can meet within that shift aren't sent. An
equal (length, side, chunk) is a candidate and Levenshtein's distance verifies it.

A key that very many words share is split: what is left of its words once the common chunk is taken out
is again two strings one edit apart, so the same chunks and grams of the rests extend the key, as often
as it takes (the last keys hold words that differ in two places at most). Nothing is dropped, and no
group is compared all against all.

A word's form is its nearest neighbour in frequency terms: the most frequent of its near words (ties:
the smallest in code-point order) if that is at least twice as frequent. Forms at least double, so chains
are short, and roots are found by doubling jumps.

Defined cases: a null text has no words; a null id counts as an empty one; rows that share an id or are
repeated whole count each; an empty table gives no rows; other columns are ignored; a text or run of any
length is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preftable.llm.scratch import staged

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 5
MIN_COUNT = 3
MISPRINT_MODULUS = 97
DOMINANCE = 2
GROUP_PAIRS = 1 << 20  # comparisons of one key before its words are keyed by their rests as well
LEAST_REST = 2  # rests of fewer code points aren't split further


def misprinted(key: Column, word: Column, modulus: int = MISPRINT_MODULUS) -> Column:
    """``word``, without one code point where ``modulus`` divides the CRC-32 of ``key:word``."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word)).cast("int")
    return F.when(h % modulus == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every word of every text, A-Z lower-cased; ``modulus`` misprints some of them (see ``misprinted``)."""
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(LETTERS), F.lit(0))
    each = df.select(F.col(id_col).alias("__id"), F.explode(runs).alias("run")).filter(F.length("run") >= min_chars)
    word = misprinted(F.col("__id"), F.col("run"), modulus) if modulus else F.col("run")
    return each.select(word.alias("word")).filter(F.length("word") >= min_chars)


def vocabulary(each: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the words that occur often enough."""
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows ``word, gives, more, key, rest`` once for each chunk (``gives``) or gram of their rest, taken out of it.

    ``more`` is by how many code points a gram row's word is longer than its chunk partners.
    """
    n = F.length("rest") - F.col("more")  # of the chunk partners' rests
    q = F.floor(n / 2).cast("int")
    first, last = F.lit(0), n - q

    def at(place: Column, side: str) -> Column:
        gram = F.substring(F.col("rest"), place + 1, q)
        left = F.concat(F.substring(F.col("rest"), F.lit(1), place), F.substring(F.col("rest"), place + q + 1, F.length("rest")))
        return F.struct(F.concat(F.col("key"), F.lit(side), gram).alias("key"), left.alias("rest"))

    same = F.array(at(first, "<"), at(last, ">"))
    shifted = F.array(at(first, "<"), at(first + 1, "<"), at(last, ">"), at(last + 1, ">"))
    places = F.when(F.col("more") == 0, same).otherwise(F.array_distinct(shifted))
    return rows.select("word", "gives", "more", F.explode(places).alias("x")).select("word", "gives", "more", "x.key", "x.rest")


def near_pairs(vocab: DataFrame, min_chars: int = MIN_CHARS, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """``a, b`` for all distinct words with exactly one edit between them, each pair once."""
    size = F.length("word")

    def role(gives: bool, more: int) -> Column:
        own = (size - more).cast("string")
        return F.struct(F.lit(gives).alias("gives"), F.lit(more).alias("more"), F.concat(own, F.lit(":")).alias("key"))

    longer = F.when(size > min_chars, F.array(role(False, 1))).otherwise(F.array().cast("array<struct<gives:boolean,more:int,key:string>>"))
    roles = F.explode(F.concat(F.array(role(True, 0), role(False, 0)), longer)).alias("r")
    rows = _keyed(vocab.select("word", roles).select("word", "r.gives", "r.more", "r.key", F.col("word").alias("rest")))
    found = None
    while True:
        rows = staged(rows, "chunks")
        sizes = rows.groupBy("key").agg(
            F.count_if("gives").alias("chunks"), F.count_if(~F.col("gives")).alias("grams"), F.max(F.length("rest") - F.col("more")).alias("left")
        )
        hot = sizes.filter((F.col("chunks") * F.col("grams") > group_pairs) & (F.col("left") >= LEAST_REST)).select("key")
        hot = staged(hot, "hot-chunks")
        split = not hot.isEmpty()
        cool = rows.join(hot, "key", "left_anti") if split else rows
        got = _verified(cool)
        found = got if found is None else found.unionByName(got)
        if not split:
            return found.distinct()
        rows = _keyed(rows.join(hot, "key", "left_semi"))


def _verified(rows: DataFrame) -> DataFrame:
    chunks = rows.filter("gives").select("key", F.col("word").alias("a"))
    grams = rows.filter(~F.col("gives")).select("key", "more", F.col("word").alias("b"))
    met = chunks.join(grams, "key").filter((F.col("more") == 1) | (F.col("a") < F.col("b")))
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where following ``word -> form`` ends, for every word that has a form.

    Each round joins every word's present end with that end's own, so chains halve; rounds are
    written tables and a flag a round reaches the driver. Ends that many words share are spread by
    Spark's skew handling, as each end has one row on the other side.
    """
    ends = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("end"))
        nxt = ends.join(ahead, "root", "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved"))
        nxt = staged(nxt, "roots")
        ends = nxt.select("word", "root")
        if nxt.filter("moved").isEmpty():
            return ends


def variants(vocab: DataFrame, min_chars: int = MIN_CHARS, dominance: int = DOMINANCE, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of a ``word, n`` table with distinct words."""
    vocab = staged(vocab, "words")
    pairs = near_pairs(vocab, min_chars, group_pairs)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p"))
    counts = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = both.select("p.*").join(counts, "near").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near"))).alias("top")
    )
    frequent = -F.col("top.minus_n") >= dominance * F.col("n")
    out = vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("top.near")).alias("form"), F.when(frequent, -F.col("top.minus_n")).alias("form_n"),
    )
    out = staged(out, "forms")
    ends = roots(out.filter(F.col("form").isNotNull()))
    out = out.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")
