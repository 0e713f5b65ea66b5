"""Registered queries of the pipeline operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from preftable.llm import covertree, fingerprint, infill, linedup, mixing, neardup, packing, quotes, rules, secretscan, simple8b, spelling, sql, tokencount
from preftable.llm.tokens import default_vocabulary


def _table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def op1_simple8b(spark: SparkSession, base: str) -> DataFrame:
    """Whole texts to ids, written as Simple-8b files and read back."""
    return simple8b.write_and_read(_table(spark, base, "documents"), default_vocabulary())


def op2_quotes(spark: SparkSession, base: str) -> DataFrame:
    """Every message with its quote links and its place in reply order."""
    out = quotes.conversations(_table(spark, base, "conversations"))
    digest = [F.length("body").cast("long").alias("body_chars"), F.md5(F.col("body").cast("binary")).alias("body_md5")]
    numbers = [F.col(c).cast("long").alias(c) for c in ("n_quoted_lines", "max_level", "n_links", "parent_turn", "root_turn", "position")]
    return out.select("conv_id", "turn", "role", *numbers, *digest)


def op3_lines(spark: SparkSession, base: str) -> DataFrame:
    """Every line with a word that an earlier line matches."""
    return linedup.repeated_lines(_table(spark, base, "documents"))


def op4_secrets(spark: SparkSession, base: str) -> DataFrame:
    """Every finding with the forest's verdict; values are shown as hashes."""
    out = secretscan.find_secrets(_table(spark, base, "documents"))
    shown = F.md5(F.col("value").cast("binary")).alias("value_md5")
    return out.select("doc_id", "word_no", F.length("value").alias("length"), shown, "label", "score", "is_secret")


def op5_cover_tree(spark: SparkSession, base: str) -> DataFrame:
    """The ten best inner products for every hundredth vector against all others."""
    vectors = covertree.whole_vectors(_table(spark, base, "embeddings"))
    return covertree.search(vectors, F.col("id") % 100 == 0, 10)


def op6_token_counts(spark: SparkSession, base: str) -> DataFrame:
    """Unigram token counts of every whole text."""
    return tokencount.token_counts(_table(spark, base, "documents"), tokencount.default_pieces())


def op7_near_duplicates(spark: SparkSession, base: str) -> DataFrame:
    """Every document with its set size and near-duplicate component."""
    return neardup.near_duplicates(_table(spark, base, "documents"))


def op8_mixing(spark: SparkSession, base: str) -> DataFrame:
    """Every document's block, window and slot in the mixture of sources."""
    docs = _table(spark, base, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", *mixing.RESULTS)


def op9_packing(spark: SparkSession, base: str) -> DataFrame:
    """Every document's pieces packed in sequences of at most 1,024 tokens, chosen by what would remain of tokens,
    documents and attention cost."""
    cap = packing.Capacity(max_tokens=1024, weights=(1.0, 0.1, 0.1))
    return packing.pack_documents(_table(spark, base, "documents"), default_vocabulary(), cap)


def op10_quality(spark: SparkSession, base: str) -> DataFrame:
    """Every document's base facts and the cascade's verdict."""
    return rules.quality_report(_table(spark, base, "documents"))


def op11_spelling(spark: SparkSession, base: str) -> DataFrame:
    """Every frequent word, some of them misprinted, with its form and root."""
    each = spelling.words(_table(spark, base, "documents"), modulus=spelling.MISPRINT_MODULUS)
    return spelling.variants(spelling.vocabulary(each))


def op12_fingerprints(spark: SparkSession, base: str) -> DataFrame:
    """Every document's and its edited text's fingerprint, and their likenesses."""
    return fingerprint.edited_report(_table(spark, base, "documents"))


def op13_infill(spark: SparkSession, base: str) -> DataFrame:
    """Every text's fill-in-the-middle form and the text rebuilt from it, as digests."""
    out = infill.fill_in_middle(_table(spark, base, "documents"))
    digest = lambda c, name: F.sha2(c.cast("binary"), 256).alias(name)
    rebuilt = infill.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output"), "output_sha256"), digest(rebuilt, "restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simple8b, op2_quotes, op3_lines, op4_secrets, op5_cover_tree, op6_token_counts, op7_near_duplicates, op8_mixing, op9_packing, op10_quality, op11_spelling, op12_fingerprints, op13_infill)
}
ORACLES: dict[str, str] = sql.ORACLES
