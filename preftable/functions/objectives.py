"""Objective column functions (§2.8): per-row pieces of the PPO, RM and DPO losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from preftable.config import IGNORE_INDEX
from preftable.functions.rollout import array_sum, masked_mean, masked_sum, shifted


def neg_logsigmoid(x: Column) -> Column:
    """``-logsigmoid(x) = softplus(-x)``, written without overflow."""
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def actor_terms(advantages: Column, ratio: Column, ratio_clip: float) -> Column:
    """Per-token ``max(-A·ratio, -A·clip(ratio, 1-c, 1+c))``."""
    lo, hi = F.lit(1.0 - ratio_clip), F.lit(1.0 + ratio_clip)
    return F.zip_with(
        advantages,
        ratio,
        lambda a, r: F.greatest(-a * r, -a * F.greatest(lo, F.least(hi, r))),
    )


def critic_terms(old_values: Column, new_values: Column, returns: Column, value_clip: float) -> Column:
    """Per-token ``max(err², clipped_err²)``; new values clamped to old ± clip."""
    c = F.lit(float(value_clip))
    pair = F.zip_with(old_values, new_values, lambda o, n: F.struct(o.alias("o"), n.alias("n")))
    return F.zip_with(
        pair,
        returns,
        lambda p, r: F.greatest(
            (p["n"] - r) * (p["n"] - r),
            (F.greatest(p["o"] - c, F.least(p["o"] + c, p["n"])) - r)
            * (F.greatest(p["o"] - c, F.least(p["o"] + c, p["n"])) - r),
        ),
    )


def values_error(new_values: Column, returns: Column) -> Column:
    """Unclipped ``(new - returns)²`` per token."""
    return F.zip_with(new_values, returns, lambda n, r: (n - r) * (n - r))


def extra_loss_weight(step: Column, weight: float, warmup_ratio: float | None, max_steps: int) -> Column:
    """Warm-up ramp ``step / warmup · w`` before ``int(ratio·max_steps)``; ``w ** 1.001`` after; ``w`` without ratio."""
    w = F.lit(float(weight))
    if warmup_ratio is None:
        return w
    warmup = int(warmup_ratio * max_steps)
    if warmup <= 0:
        return F.pow(w, F.lit(1.001))
    return F.when(step < warmup, step.cast("double") / F.lit(float(warmup)) * w).otherwise(F.pow(w, F.lit(1.001)))


def ppo_total_loss(
    actor: Column,
    entropy: Column,
    critic: Column,
    extra: Column | None = None,
    extra_weight: Column | None = None,
    actor_weight: float = 1.0,
    entropy_beta: float = 0.0,
    critic_weight: float = 1.0,
) -> Column:
    """``wa·actor + entropy_beta·entropy + wc·critic (+ extra_weight·extra)``; entropy is added."""
    total = F.lit(actor_weight) * actor + F.lit(entropy_beta) * entropy + F.lit(critic_weight) * critic
    if extra is not None:
        total = total + (extra_weight if extra_weight is not None else F.lit(1.0)) * extra
    return total


def label_mask(labels: Column) -> Column:
    """1 where the label is not ignored."""
    return F.transform(labels, lambda y: F.when(y != F.lit(IGNORE_INDEX), 1).otherwise(0))


def rm_mask_values(values: Column, labels: Column) -> Column:
    """Value × (label ≠ -100); no shift."""
    return F.zip_with(values, label_mask(labels), lambda v, m: v * m)


def rm_end_value(masked_values: Column, ids: Column, pad: int) -> Column:
    """Masked value at index ``count(id ≠ pad) - 1``."""
    idx = F.size(F.filter(ids, lambda x: x != F.lit(pad))) - 1
    return F.get(masked_values, idx)


def dpo_sequence_logps(logp: Column, labels: Column, average: bool = False) -> Column:
    """Σ (or masked mean) of per-token log-probs over ``labels[1:] != -100``."""
    mask = shifted(label_mask(labels))
    return masked_mean(logp, mask) if average else masked_sum(logp, mask)


def sequence_logps_by_mask(logp: Column, mask_shifted: Column, average: bool = False) -> Column:
    """Same as ``dpo_sequence_logps`` with the shifted 0/1 mask given directly."""
    return masked_mean(logp, mask_shifted) if average else masked_sum(logp, mask_shifted)


def dpo_rewards(policy: Column, reference: Column, beta: float) -> Column:
    return F.lit(float(beta)) * (policy - reference)


def dpo_ratios(
    accepts: Column, rejects: Column, ref_accepts: Column, ref_rejects: Column, beta: float, reference_free: bool = False
) -> tuple[Column, Column]:
    """``pi = beta·(acc - rej)``; ``ref = beta·(ref_acc - ref_rej)``, or 0 when reference-free."""
    b = F.lit(float(beta))
    pi = b * (accepts - rejects)
    ref = F.lit(0.0) if reference_free else b * (ref_accepts - ref_rejects)
    return pi, ref


def dpo_row_loss(pi_ratio: Column, ref_ratio: Column) -> Column:
    return neg_logsigmoid(pi_ratio - ref_ratio)


def pair_correct(accepts: Column, rejects: Column) -> Column:
    """Arg-max over (accepts, rejects) is 0; a tie counts as correct."""
    return F.when(accepts >= rejects, F.lit(1.0)).otherwise(F.lit(0.0))


__all__ = [
    "actor_terms",
    "array_sum",
    "critic_terms",
    "dpo_ratios",
    "dpo_rewards",
    "dpo_row_loss",
    "dpo_sequence_logps",
    "extra_loss_weight",
    "label_mask",
    "neg_logsigmoid",
    "pair_correct",
    "perplexity",
    "ppo_total_loss",
    "rm_end_value",
    "rm_mask_values",
    "rm_total_loss",
    "sequence_logps_by_mask",
    "values_error",
]


def perplexity(loss: Column) -> Column:
    """``exp(loss)``; an overflowing loss gives ``Infinity`` as in the reference."""
    return F.exp(loss)


def rm_total_loss(pairwise: Column, clm: Column, clm_loss_weight: float = 0.0) -> Column:
    """Pairwise loss plus ``clm_loss_weight`` times the language-model loss of the chosen side."""
    return pairwise + F.lit(float(clm_loss_weight)) * clm
