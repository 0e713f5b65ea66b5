"""Views over the driver fixture tables (FIXTURES §2.3, §2.4).

The fixtures carry no model outputs, so score columns are deterministic arithmetic on existing
columns, written identically in the DuckDB oracles (``plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from preftable.operators.encode import build_vocab
from preftable.operators.indexing import with_group_row_number
from preftable.sources.readers import read_parquet_table

# Positions before this index are the "prompt" part of each score sequence.
PROMPT_POSITIONS = 8
# Sequences per batch in the score views.
SCORE_BATCH = 8


def table(spark: SparkSession, base: str, name: str, spread: bool = False) -> DataFrame:
    """A fixture table; ``spread`` before heavy per-row work such as tokenisation."""
    return read_parquet_table(spark, base, name, spread=spread)


def conversation_neighbours(spark: SparkSession, base: str, offsets: tuple[int, ...] = (1,)) -> DataFrame:
    """Each turn with the turn ``offset`` places later and the conversation's system text.

    Every turn is emitted once as itself and once per offset keyed at ``turn - offset``; a
    ``groupBy(conv_id, turn)`` then holds at most ``1 + len(offsets)`` rows per key, so no task
    ever holds a whole conversation however long one is, and the table is scanned and shuffled
    once. The system text is one row per conversation joined on ``conv_id`` (AQE splits a skewed
    side).
    """
    conv = table(spark, base, "conversations").select("conv_id", "turn", "role", "text")
    copies = [F.struct(F.lit(0).alias("k"), F.col("turn").alias("t"), "role", "text")] + [
        F.struct(F.lit(k).alias("k"), (F.col("turn") - k).alias("t"), "role", "text") for k in offsets
    ]
    keyed = conv.select("conv_id", F.inline(F.array(*copies)))
    grouped = keyed.groupBy("conv_id", F.col("t").alias("turn")).agg(
        F.collect_list(F.struct("k", "role", "text")).alias("__items")
    )

    def pick(k: int):
        return F.get(F.filter(F.col("__items"), lambda x: x["k"] == F.lit(k)), 0)

    out = grouped.select(
        "conv_id",
        "turn",
        pick(0)["role"].alias("role"),
        pick(0)["text"].alias("text"),
        *[pick(k)["role"].alias(f"role_{k}") for k in offsets],
        *[pick(k)["text"].alias(f"text_{k}") for k in offsets],
    ).filter(F.col("role").isNotNull())
    system = conv.filter(F.col("role") == "system").groupBy("conv_id").agg(F.max("text").alias("sys_text"))
    return out.join(system, "conv_id", "left")


def instruction_rows(spark: SparkSession, base: str) -> DataFrame:
    """User turn followed by an assistant turn → instruction record.

    ``instruction`` = user text, ``input`` = the conversation's system text or '', ``output`` =
    [assistant text], ``example_id = conv_id*100 + turn``.
    """
    x = conversation_neighbours(spark, base, (1,))
    return x.filter((F.col("role") == "user") & (F.col("role_1") == "assistant")).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("example_id"),
        F.col("text").alias("instruction"),
        F.coalesce(F.col("sys_text"), F.lit("")).alias("input"),
        F.array(F.col("text_1")).alias("output"),
        F.lit(False).alias("output_is_scalar"),
    )


def prompt_rows(spark: SparkSession, base: str) -> DataFrame:
    """The same user→assistant neighbours in the prompt layout ``{prompt, chosen}``."""
    inst = instruction_rows(spark, base)
    return inst.select("example_id", F.col("instruction").alias("prompt"), F.get(F.col("output"), 0).alias("chosen"))


def preference_rows(spark: SparkSession, base: str) -> DataFrame:
    """Every quality-1 (chosen) document with a quality-0 (rejected) one of its language, dealt by rank.

    The rejected documents of a language go round as often as its chosen ones need; a language
    without any has no pairs. One that goes round many times is a key that AQE splits.
    The rank is ``row_number() OVER (PARTITION BY lang, quality ORDER BY doc_id)``; there are only
    a few (lang, quality) groups, so it is computed with range-partitioned numbering instead of a
    window that would put a whole language in one task. Only keys are ranked and paired; the texts
    are fetched afterwards with one join of the paired documents against ``documents`` and folded
    back per pair, so document text crosses the network once (plus once per paired document).
    """
    keys = table(spark, base, "documents").select("doc_id", "lang")
    labels = table(spark, base, "labels").select("doc_id", "quality")
    lab = keys.join(labels, "doc_id").filter(F.col("quality").isin(0, 1))
    ranked = with_group_row_number(lab, ["lang", "quality"], ["doc_id"], name="rn")
    chosen = ranked.filter(F.col("quality") == 1).select("lang", "rn", F.col("doc_id").alias("example_id"))
    rejected = ranked.filter(F.col("quality") == 0).select("lang", "rn", F.col("doc_id").alias("rejected_doc_id"))
    dealt = rejected.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    chosen = chosen.join(dealt, "lang").withColumn("rn", F.pmod("rn", "n"))
    pairs = chosen.join(rejected, ["lang", "rn"]).select("example_id", "rejected_doc_id", "lang")
    members = pairs.select(
        "example_id",
        "rejected_doc_id",
        "lang",
        F.explode(F.array(F.struct(F.col("example_id").alias("doc_id"), F.lit(True).alias("is_chosen")),
                          F.struct(F.col("rejected_doc_id").alias("doc_id"), F.lit(False).alias("is_chosen")))).alias("m"),
    ).select("example_id", "rejected_doc_id", "lang", "m.doc_id", "m.is_chosen")
    texts = members.join(table(spark, base, "documents").select("doc_id", "text"), "doc_id")
    folded = texts.groupBy("example_id", "rejected_doc_id", "lang").agg(
        F.max(F.when(F.col("is_chosen"), F.col("text"))).alias("chosen"),
        F.max(F.when(~F.col("is_chosen"), F.col("text"))).alias("rejected"),
    )
    return folded.select(
        "example_id",
        F.concat(F.lit("Write in "), F.col("lang")).alias("prompt"),
        "chosen",
        "rejected",
        "rejected_doc_id",
        "lang",
    )


def document_vocab(spark: SparkSession, base: str) -> DataFrame:
    """Vocabulary built from the whole ``documents`` table."""
    return build_vocab(table(spark, base, "documents", spread=True), "text")


def _scores(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    actor = -F.pmod(e * 37 + 11, F.lit(1000)).cast("double") / F.lit(250.0)
    return events.select(
        F.col("user_id").alias("seq"),
        e.alias("event_id"),
        actor.alias("actor"),
        (-F.pmod(e * 53 + 29, F.lit(1000)).cast("double") / F.lit(250.0)).alias("ref"),
        (actor + (F.pmod(e, F.lit(21)) - 10).cast("double") / F.lit(50.0)).alias("new"),
        ((F.pmod(e * 17, F.lit(200)) - 100).cast("double") / F.lit(100.0)).alias("value"),
        (
            (F.pmod(e * 17, F.lit(200)) - 100).cast("double") / F.lit(100.0)
            + (F.pmod(e, F.lit(9)) - 4).cast("double") / F.lit(10.0)
        ).alias("new_value"),
    )


def rollout_rows(spark: SparkSession, base: str) -> DataFrame:
    """One row per sequence (``seq = user_id``) with the logged score arrays.

    Events are clustered once by ``batch_id = seq div 8`` and folded per ``(batch_id, seq)`` in
    ``event_id`` order with one ``collect_list``. Every later batch-level step (whitening window,
    per-batch losses and metrics, the chosen/rejected fold per ``(batch_id, pair)``; a pair never
    straddles a batch because the batch size is even) is then satisfied by that partitioning and
    needs no further exchange. Arrays: ``sequence_mask``/``response_mask``/``critic_values``
    (length T), ``actor_logp``/``ref_logp``/``new_logp``/``new_values`` (length T-1).
    """
    s = _scores(table(spark, base, "events"))
    s = s.withColumn("batch_id", F.floor(F.col("seq") / SCORE_BATCH).cast("long")).repartition("batch_id")
    seqs = s.groupBy("batch_id", "seq").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "actor", "ref", "new", "value", "new_value"))).alias("__s")
    )
    t = F.size("__s")
    head = F.slice(F.col("__s"), 1, t - 1)
    return seqs.select(
        "seq",
        "batch_id",
        F.floor(F.col("seq") / 2).cast("long").alias("pair"),
        F.transform("__s", lambda x: F.lit(1)).alias("sequence_mask"),
        F.transform("__s", lambda x, i: F.when(i < PROMPT_POSITIONS, 0).otherwise(1)).alias("response_mask"),
        F.transform(head, lambda x: x["actor"]).alias("actor_logp"),
        F.transform(head, lambda x: x["ref"]).alias("ref_logp"),
        F.transform(head, lambda x: x["new"]).alias("new_logp"),
        F.transform("__s", lambda x: x["value"]).alias("critic_values"),
        F.transform(head, lambda x: x["new_value"]).alias("new_values"),
        ((F.pmod(F.col("seq") * 13, F.lit(41)) - 20).cast("double") / F.lit(10.0)).alias("reward"),
    )


def explode_tokens(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Per-token long form ``(keys…, pos, col…)`` of equal-length array columns."""
    zipped = F.arrays_zip(*[F.col(c) for c in cols])
    return df.select(*keys, F.posexplode(zipped).alias("pos", "__z")).select(
        *keys, "pos", *[F.col("__z")[c].alias(c) for c in cols]
    )
