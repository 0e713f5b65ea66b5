"""Rollout arithmetic over logged model outputs (§2.7), as per-row array expressions.

Index convention: a length-T sequence has per-token scores of length T-1 (token t is predicted at
position t-1), paired with ``response_mask[1:]``. Everything here stays inside one row, so it
compiles into the surrounding whole-stage-codegen stage and never shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from preftable.config import MASKED_MEAN_EPS, WHITEN_EPS
from preftable.functions.scan import let, suffix_scan


def shifted(mask: Column) -> Column:
    """``mask[1:]``."""
    return F.slice(mask, 2, F.greatest(F.size(mask) - 1, F.lit(0)))


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0).cast("double"), lambda acc, v: acc + v.cast("double"))


def masked_sum(x: Column, mask: Column) -> Column:
    return array_sum(F.zip_with(x, mask, lambda a, m: a * m))


def masked_mean(x: Column, mask: Column, eps: float = MASKED_MEAN_EPS) -> Column:
    """Per-row ``Σ(x·m) / (Σm + eps)``."""
    return masked_sum(x, mask) / (array_sum(mask) + F.lit(eps))


def masked_var(x: Column, mask: Column) -> Column:
    """Per-row masked mean of squared deviations from the masked mean (population variance)."""
    mean = masked_mean(x, mask)
    return masked_mean(F.transform(x, lambda v: (v - mean) * (v - mean)), mask)


def response_mask(sequence_mask: Column, prompt_len: Column) -> Column:
    """0 over the first ``prompt_len`` positions, then the sequence mask."""
    return F.transform(sequence_mask, lambda m, i: F.when(i < prompt_len, F.lit(0)).otherwise(m))


def last_index(mask: Column) -> Column:
    """0-based index of the last 1 in ``mask``; NULL when there is none."""
    return F.array_max(F.filter(F.transform(mask, lambda m, i: F.when(m == 1, i)), lambda v: v.isNotNull()))


def last_reward(values: Column, mask: Column) -> Column:
    """Value at the last position where ``mask`` is 1 (NULL for an empty response)."""
    return F.get(values, last_index(mask))


def clip_reward(score: Column, clip: float | None) -> Column:
    if clip is None:
        return score
    return F.greatest(F.lit(-float(clip)), F.least(F.lit(float(clip)), score))


def kl_penalty(actor_logp: Column, ref_logp: Column, beta: float, method: str | None = None) -> Column:
    """``-beta * k`` with ``k = actor - ref``, ``|k|`` (abs) or ``k²/2`` (mse)."""
    if method not in (None, "abs", "mse"):
        raise ValueError(f"unknown kl penalty method {method!r}")

    def one(a: Column, r: Column) -> Column:
        k = a - r
        if method == "abs":
            k = F.abs(k)
        elif method == "mse":
            k = k * k * F.lit(0.5)
        return F.lit(-float(beta)) * k

    return F.zip_with(actor_logp, ref_logp, one)


def rewards_with_kl(penalty: Column, score: Column, mask_shifted: Column) -> Column:
    """Penalty per token with ``score`` added at the last position where ``mask[1:]`` is 1."""
    end = last_index(mask_shifted)
    return F.transform(penalty, lambda p, i: F.when(i == end, p + score).otherwise(p))


def mask_scores(x: Column, mask_shifted: Column) -> Column:
    """Element-wise ``x * mask[1:]`` (arrays of equal length)."""
    return F.zip_with(x, mask_shifted, lambda a, m: a * m)


def gae(rewards: Column, values: Column, gamma: float = 1.0, lam: float = 0.95) -> Column:
    """Generalised advantages over the full length, computed from the end.

    ``δ_t = r_t + γ·V_{t+1} − V_t`` (``V`` beyond the end is 0), ``A_t = δ_t + γλ·A_{t+1}``: a suffix
    scan, linear in the length (``functions.scan``).
    """
    g = F.lit(float(gamma))
    both = F.struct(rewards.alias("r"), values.alias("v"))
    delta = let(
        both,
        lambda x: F.transform(x["r"], lambda r, i: r + g * F.coalesce(F.get(x["v"], i + 1), F.lit(0.0)) - F.get(x["v"], i)),
    )
    return suffix_scan(delta, float(gamma) * float(lam))


def returns(advantages: Column, values: Column) -> Column:
    """Unwhitened advantage + value."""
    return F.zip_with(advantages, values, lambda a, v: a + v)


def whiten(x: Column, mean: Column, var: Column, shift_mean: bool = True, eps: float = WHITEN_EPS) -> Column:
    """``(x - mean) * rsqrt(var + eps)``, plus ``mean`` again when ``shift_mean`` is False."""
    scale = F.lit(1.0) / F.sqrt(var + F.lit(eps))
    if shift_mean:
        return F.transform(x, lambda v: (v - mean) * scale)
    return F.transform(x, lambda v: (v - mean) * scale + mean)


def _by_log_sum_exp(logits: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the log-sum-exp of one position, which is computed once, not again for each logit."""

    def by_max(m: Column) -> Column:
        return let(m + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v - m))), use)

    return let(F.array_max(logits), by_max)


def log_softmax_at(logits: Column, label: Column) -> Column:
    """Log-probability of ``label`` under ``softmax(logits)`` for one position."""
    return _by_log_sum_exp(logits, lambda lse: F.get(logits, label) - lse)


def entropy(logits: Column) -> Column:
    """``-Σ p·log p`` of ``softmax(logits)`` for one position."""

    def by_lse(lse: Column) -> Column:
        return -F.aggregate(logits, F.lit(0.0), lambda acc, v: acc + F.exp(v - lse) * (v - lse))

    return _by_log_sum_exp(logits, by_lse)


def token_logprobs(logits: Column, ids: Column) -> Column:
    """Per-token log-probs: logits ``[:-1]`` (ARRAY<ARRAY<DOUBLE>>) against ids ``[1:]``."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.zip_with(F.slice(logits, 1, n), F.slice(ids, 2, n), lambda row, y: log_softmax_at(row, y))


def token_entropies(logits: Column) -> Column:
    """Per-position entropies of logits ``[:-1]``."""
    return F.transform(F.slice(logits, 1, F.greatest(F.size(logits) - 1, F.lit(0))), entropy)


def token_scores(logits: Column, ids: Column) -> Column:
    """Per position of logits ``[:-1]``: struct of ``logp`` of the next id and ``entropy``, from one log-sum-exp.

    With ``e = exp(v - max)`` the log-sum-exp is ``max + log Σe`` and the entropy ``lse - Σe·v / Σe``.
    """

    def scores(row: Column, y: Column) -> Column:
        def by_max(m: Column) -> Column:
            def by_exp(e: Column) -> Column:
                def by_sum(s: Column) -> Column:
                    lse = m + F.log(s)
                    return F.struct((F.get(row, y) - lse).alias("logp"), (lse - array_sum(F.zip_with(e, row, lambda a, v: a * v)) / s).alias("entropy"))

                return let(array_sum(e), by_sum)

            return let(F.transform(row, lambda v: F.exp(v - m)), by_exp)

        return let(F.array_max(row), by_max)

    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.zip_with(F.slice(logits, 1, n), F.slice(ids, 2, n), scores)


def sequence_ce(logp: Column, sequence_mask: Column) -> Column:
    """``-masked_mean(logp, sequence_mask[1:])`` over prompt and response."""
    return -masked_mean(logp, shifted(sequence_mask))


def policy_ratio(new_logp: Column, old_logp: Column, mask: Column) -> Column:
    """``exp((new - old) * mask)``."""
    diff = F.zip_with(new_logp, old_logp, lambda a, b: a - b)
    return F.zip_with(diff, mask, lambda d, m: F.exp(d * m))
