"""Rollout fields of sequences of any length, from rows per position (§2.7).

``operators.rollout.build_experience`` holds a sequence in arrays of one row. Here a sequence is rows
``(seq, pos)`` and is worked on in chunks of at most ``chunk`` positions (a row ``(seq, chunk)`` with arrays
and the first position of the next chunk), so neither a task nor a row holds a whole sequence, however
long one is. What needs a sequence as a whole is one small row for it (its last response position, its
masked sums), joined to its chunks, and the advantages' recurrence crosses chunks by affine carries
(``functions.scan``). Batch statistics are moments over tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preftable.config import MASKED_MEAN_EPS, WHITEN_EPS, RolloutConfig
from preftable.functions import rollout as R
from preftable.functions.scan import suffix_carries

INPUTS = ("actor_logp", "ref_logp", "value", "sequence_mask", "response_mask")


def sequence_chunks(df: DataFrame, seq: str = "seq", pos: str = "pos", chunk: int = 1024) -> DataFrame:
    """``seq, at, rows, ahead`` for each chunk: its positions' structs and the next chunk's first one (or null).

    A position that begins a chunk is also sent to the one before it, so no chunk is joined to another.
    """
    at = F.floor(F.col(pos) / chunk).cast("long")
    item = F.struct(F.col(pos).cast("long").alias("pos"), *INPUTS)
    own = F.struct(at.alias("at"), item.alias("x"))
    sent = F.when((F.pmod(pos, F.lit(chunk)) == 0) & (F.col(pos) > 0), F.array(own, F.struct((at - 1).alias("at"), item.alias("x")))).otherwise(F.array(own))
    rows = df.select(F.col(seq).alias("seq"), F.inline(sent)).groupBy("seq", "at").agg(F.array_sort(F.collect_list("x")).alias("all"))
    inside = lambda x: x["pos"] < (F.col("at") + 1) * chunk
    return rows.select("seq", "at", F.filter("all", inside).alias("rows"), F.get(F.filter("all", lambda x: ~inside(x)), 0).alias("ahead"))


def build_experience_long(
    df: DataFrame,
    sequences: DataFrame,
    cfg: RolloutConfig = RolloutConfig(),
    seq: str = "seq",
    pos: str = "pos",
    chunk: int = 1024,
    fan: int = 1024,
    levels: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """``(tokens, per_sequence)`` from positions ``(seq, pos, actor_logp, ref_logp, value, sequence_mask,
    response_mask)`` and one row ``(seq, batch_id, reward)`` per sequence.

    ``tokens`` has, for each position but a sequence's last, ``kl_penalty, rewards_kl, critic_values,
    advantages`` (whitened over the batch when the configuration says so), ``returns`` and ``mask``;
    ``per_sequence`` has ``reward_score, actor_ce, ref_ce`` and ``quarantine_reason`` (a sequence without
    a response token has no reward). Same numbers as ``build_experience``.
    """
    chunks = sequence_chunks(df, seq, pos, chunk)
    # A token's score at position t belongs to the token at t + 1: the masks are those of the next position.
    following = F.concat(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), F.when(F.col("ahead").isNotNull(), F.array("ahead")).otherwise(F.slice("rows", 1, 0)))
    chunks = chunks.withColumn("next", following).withColumn("rows", F.slice("rows", 1, F.size("next")))
    field = lambda rows, name: F.transform(rows, lambda x: x[name].cast("double"))
    chunks = chunks.filter(F.size("rows") > 0).select(
        "seq", "at", F.get(F.col("rows"), 0)["pos"].alias("first"), field("rows", "actor_logp").alias("actor"), field("rows", "ref_logp").alias("ref"),
        field("rows", "value").alias("value"), field("next", "response_mask").alias("mask"), field("next", "sequence_mask").alias("own"),
    )
    sums = chunks.groupBy("seq").agg(
        F.max(F.col("first") + R.last_index(F.col("mask").cast("array<int>"))).alias("last"),
        F.sum(R.masked_sum(F.col("actor"), F.col("own"))).alias("sa"), F.sum(R.masked_sum(F.col("ref"), F.col("own"))).alias("sr"),
        F.sum(R.array_sum(F.col("own"))).alias("n"),
    )
    given = sequences.select(F.col(seq).alias("seq"), "batch_id", F.col("reward").cast("double").alias("reward"))
    score = R.clip_reward(F.when(F.col("last").isNotNull(), F.col("reward")), cfg.reward_score_clip)
    whole = given.join(sums, "seq").select(
        "seq", "batch_id", "last", score.alias("reward_score"), (-F.col("sa") / (F.col("n") + MASKED_MEAN_EPS)).alias("actor_ce"),
        (-F.col("sr") / (F.col("n") + MASKED_MEAN_EPS)).alias("ref_ce"), F.when(F.col("last").isNull(), F.lit("empty response")).alias("quarantine_reason"),
    )
    c = float(cfg.gamma) * float(cfg.lam)
    work = chunks.join(whole.select("seq", "batch_id", "last", "reward_score"), "seq")
    work = work.withColumn("pen", R.kl_penalty(F.col("actor"), F.col("ref"), cfg.kl_penalty_beta, cfg.kl_penalty_method))
    raw = F.transform("pen", lambda p, i: F.when(F.col("first") + i == F.col("last"), p + F.col("reward_score")).otherwise(p))
    work = work.withColumn("raw", raw).withColumn("rk", R.mask_scores(F.col("raw"), F.col("mask"))).withColumn("v", R.mask_scores(F.col("value"), F.col("mask")))
    work = work.withColumn("local", R.gae(F.col("rk"), F.col("v"), cfg.gamma, cfg.lam)).withColumn("size", F.size("rk"))
    maps = work.select(
        "seq", "at", F.pow(F.lit(c), F.col("size").cast("double")).alias("a"),
        (F.lit(float(cfg.gamma)) * F.get("v", F.lit(0)) + F.lit(c) * F.get("local", F.lit(0))).alias("b"),
    )
    work = work.join(suffix_carries(maps, "seq", "at", "a", "b", "carried", fan, levels), ["seq", "at"])
    adv = F.transform("local", lambda x, i: x + F.pow(F.lit(c), (F.col("size") - i - 1).cast("double")) * F.col("carried"))
    shown = F.arrays_zip(
        (F.col("raw") if cfg.compat else F.col("pen")).alias("kl_penalty"), F.col("rk").alias("rewards_kl"), F.col("v").alias("critic_values"),
        F.col("adv").alias("advantages"), R.returns(F.col("adv"), F.col("v")).alias("returns"), F.col("mask").alias("mask"),
    )
    work = work.withColumn("adv", adv)
    tokens = work.select("seq", "batch_id", "first", F.posexplode(shown).alias("i", "z")).select("seq", "batch_id", (F.col("first") + F.col("i")).alias("pos"), "z.*")
    if cfg.use_advantage_norm:
        taken = F.when(F.col("mask") != 0, F.col("advantages"))
        # Mergeable moments; ``compat`` takes the mean's numerator over all tokens, as the reference does.
        mean = F.try_divide(F.sum("advantages"), F.sum("mask")) if cfg.compat else F.avg(taken)
        stats = tokens.groupBy("batch_id").agg(mean.alias("mean"), (F.var_pop(taken) + F.pow(F.avg(taken) - mean, F.lit(2.0))).alias("var"))
        tokens = tokens.join(stats, "batch_id").withColumn("advantages", (F.col("advantages") - F.col("mean")) / F.sqrt(F.col("var") + F.lit(WHITEN_EPS))).drop("mean", "var")
    return tokens, whole.drop("last")
