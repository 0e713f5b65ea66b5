"""Batch-level objectives over logged scores (§2.8).

Every batch statistic is a per-row partial (array fold inside the row) followed by a
``groupBy(batch)`` sum, so Spark's partial/final hash aggregation pre-aggregates before the
shuffle and only one small row per batch and task crosses the network.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from preftable.config import MASKED_MEAN_EPS, PairConfig
from preftable.functions import objectives as O
from preftable.functions import rollout as R


def _masked_batch_mean(x, mask):
    return (F.sum(R.masked_sum(x, mask)) / (F.sum(R.array_sum(mask)) + F.lit(MASKED_MEAN_EPS)))


def actor_loss_agg(advantages: str, new_logp: str, old_logp: str, mask: str, ratio_clip: float = 0.2) -> Column:
    """Aggregate: masked mean of ``max(-A·ratio, -A·clip(ratio, 1±c))`` over the group."""
    ratio = R.policy_ratio(F.col(new_logp), F.col(old_logp), F.col(mask))
    return _masked_batch_mean(O.actor_terms(F.col(advantages), ratio, ratio_clip), F.col(mask))


def critic_loss_agg(old_values: str, new_values: str, returns: str, mask: str, value_clip: float = 0.2) -> Column:
    """Aggregate: ``0.5·masked_mean(max(err², clipped_err²))``."""
    terms = O.critic_terms(F.col(old_values), F.col(new_values), F.col(returns), value_clip)
    return F.lit(0.5) * _masked_batch_mean(terms, F.col(mask))


def values_error_agg(new_values: str, returns: str, mask: str) -> Column:
    """Aggregate: masked mean of the unclipped ``(new - returns)²``."""
    return _masked_batch_mean(O.values_error(F.col(new_values), F.col(returns)), F.col(mask))


def clm_loss_agg(logp: str, mask: Column) -> Column:
    """Aggregate: mean negative log-prob over the selected tokens."""
    # try_divide: no selected token gives NULL instead of failing under ANSI.
    return F.try_divide(-F.sum(R.masked_sum(F.col(logp), mask)), F.sum(R.array_sum(mask)))


def ppo_actor_loss(
    df: DataFrame,
    batch_col: str = "batch_id",
    advantages: str = "advantages",
    new_logp: str = "new_logp",
    old_logp: str = "actor_logp",
    mask: str = "mask",
    ratio_clip: float = 0.2,
) -> DataFrame:
    """Masked mean over the batch of ``max(-A·ratio, -A·clip(ratio, 1±c))``."""
    return df.groupBy(batch_col).agg(actor_loss_agg(advantages, new_logp, old_logp, mask, ratio_clip).alias("actor_loss"))


def ppo_critic_loss(
    df: DataFrame,
    batch_col: str = "batch_id",
    old_values: str = "critic_values",
    new_values: str = "new_values",
    returns: str = "returns",
    mask: str = "mask",
    value_clip: float = 0.2,
) -> DataFrame:
    """``0.5·masked_mean(max(err², clipped_err²))`` and the masked mean of the unclipped error."""
    return df.groupBy(batch_col).agg(
        critic_loss_agg(old_values, new_values, returns, mask, value_clip).alias("critic_loss"),
        values_error_agg(new_values, returns, mask).alias("values_error_mean"),
    )


def rm_last_loss_agg(accepts_end: str = "accepts_end_value", rejects_end: str = "rejects_end_value") -> Column:
    """Aggregate: mean ``-logsigmoid(a_end - r_end)``."""
    return F.avg(O.neg_logsigmoid(F.col(accepts_end) - F.col(rejects_end)))


def rm_pairwise_loss(
    df: DataFrame,
    batch_col: str = "batch_id",
    accepts_values: str = "accepts_values",
    rejects_values: str = "rejects_values",
    accepts_end: str = "accepts_end_value",
    rejects_end: str = "rejects_end_value",
    use_last_reward: bool = False,
) -> DataFrame:
    """``-logsigmoid(a - r)``: on end values, or averaged over every position of the padded batch.

    Values must already be masked (``rm_mask_values``). Padded positions beyond a row's length
    have difference 0 and add ``ln 2`` each, as in the reference.
    """
    if use_last_reward:
        return df.groupBy(batch_col).agg(rm_last_loss_agg(accepts_end, rejects_end).alias("rm_loss"))
    diff = F.zip_with(
        F.col(accepts_values),
        F.col(rejects_values),
        lambda a, r: O.neg_logsigmoid(F.coalesce(a, F.lit(0.0)) - F.coalesce(r, F.lit(0.0))),
    )
    width = F.greatest(F.size(accepts_values), F.size(rejects_values))
    per_row = R.array_sum(diff)
    agg = df.groupBy(batch_col).agg(
        F.sum(per_row).alias("__s"),
        F.sum(width).alias("__w"),
        F.max(width).alias("__t"),
        F.count(F.lit(1)).alias("__b"),
    )
    ln2 = F.lit(math.log(2.0))
    total = F.col("__s") + (F.col("__t") * F.col("__b") - F.col("__w")) * ln2
    return agg.select(batch_col, F.try_divide(total, F.col("__t") * F.col("__b")).alias("rm_loss"))


def dpo_outputs(
    df: DataFrame,
    cfg: PairConfig = PairConfig(),
    accepts: str = "accepts_logps",
    rejects: str = "rejects_logps",
    ref_accepts: str = "ref_accepts_logps",
    ref_rejects: str = "ref_rejects_logps",
    batch_col: str = "batch_id",
) -> DataFrame:
    """Per-pair DPO outputs: rewards, ratios, CE (= -logps) and the row loss.

    When per-token logits and shifted label masks are present (``{side}_logits`` as
    ARRAY<ARRAY<DOUBLE>> and ``{side}_mask``, for ``accepts``, ``rejects``, ``ref_accepts``,
    ``ref_rejects``), the four entropies are added as well: one masked mean over all tokens of a
    batch, beside each of its pairs. Pairs give their token sums, and windows over ``batch_col``
    (a batch of pairs each) weigh them by their tokens; one shuffle by batch, no join.
    """
    a, r, ra, rr = (F.col(c) for c in (accepts, rejects, ref_accepts, ref_rejects))
    pi, ref = O.dpo_ratios(a, r, ra, rr, cfg.dpo_beta, cfg.reference_free)
    sides = [s for s in ("accepts", "rejects", "ref_accepts", "ref_rejects") if {f"{s}_logits", f"{s}_mask"} <= set(df.columns)]
    for s in sides:
        mask = F.col(f"{s}_mask")
        df = df.withColumn(f"__{s}_e", R.masked_sum(R.token_entropies(F.col(f"{s}_logits")), mask)).withColumn(f"__{s}_n", R.array_sum(mask))
    over = Window.partitionBy(batch_col)
    means = {s: F.sum(f"__{s}_e").over(over) / (F.sum(f"__{s}_n").over(over) + F.lit(MASKED_MEAN_EPS)) for s in sides}
    df = df.withColumns({f"{s}_entropy": m for s, m in means.items()}).drop(*[f"__{s}_{x}" for s in sides for x in "en"]) if sides else df
    return (
        df.withColumn("accepts_reward", O.dpo_rewards(a, ra, cfg.dpo_beta))
        .withColumn("rejects_reward", O.dpo_rewards(r, rr, cfg.dpo_beta))
        .withColumn("pi_ratio", pi)
        .withColumn("ref_ratio", ref)
        .withColumn("accepts_ce_loss", -a)
        .withColumn("rejects_ce_loss", -r)
        .withColumn("dpo_loss_row", O.dpo_row_loss(pi, ref))
    )


def dpo_loss(df: DataFrame, batch_col: str = "batch_id", cfg: PairConfig = PairConfig(), **cols) -> DataFrame:
    """Mean row loss and pair accuracy per batch."""
    out = dpo_outputs(df, cfg, batch_col=batch_col, **cols) if "dpo_loss_row" not in df.columns else df
    return out.groupBy(batch_col).agg(
        F.avg("dpo_loss_row").alias("dpo_loss"),
        F.avg(O.pair_correct(F.col("accepts_reward"), F.col("rejects_reward"))).alias("accuracy"),
        F.count(F.lit(1)).alias("n_pairs"),
    )


def pair_accuracy(df: DataFrame, accepts: str, rejects: str, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Share of pairs whose accepted score is at least the rejected one (ties count as correct)."""
    acc = F.avg(O.pair_correct(F.col(accepts), F.col(rejects))).alias("accuracy")
    return df.groupBy(*group_cols).agg(acc) if group_cols else df.agg(acc)


def clm_loss(df: DataFrame, logp: str, labels: str | None = None, mask: str | None = None, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Mean negative log-prob over non-ignored labels, and perplexity ``exp(loss)``.

    Either ``labels`` (ignored where -100, shifted by one) or a shifted 0/1 ``mask`` selects tokens.
    """
    if labels is not None:
        m = R.shifted(O.label_mask(F.col(labels)))
    elif mask is not None:
        m = F.col(mask)
    else:
        m = F.transform(F.col(logp), lambda _: F.lit(1))
    g = df.groupBy(*group_cols) if group_cols else df.groupBy()
    return g.agg(clm_loss_agg(logp, m).alias("clm_loss")).withColumn("perplexity", O.perplexity(F.col("clm_loss")))


def token_entropy(
    df: DataFrame, logits: str, mask: str, group_cols: tuple[str, ...] = ("batch_id",)
) -> DataFrame:
    """Per-token entropy ``-Σ p·log p`` of ``logits[:-1]`` (ARRAY<ARRAY<DOUBLE>>), then the masked
    mean over each group (mask already shifted, aligned with ``logits[:-1]``)."""
    ent = R.token_entropies(F.col(logits))
    return df.groupBy(*group_cols).agg(_masked_batch_mean(ent, F.col(mask)).alias("entropy"))
