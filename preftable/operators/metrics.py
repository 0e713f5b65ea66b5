"""Step metrics (§2.9).

Masked means and variances over a mini-batch come from one pass over its tokens: Spark's mean and
central-moment aggregates keep ``(n, mean, M2)`` for each group and task and merge them pairwise, so
the centred squares are exact however large the values are beside their spread, nothing is joined back,
and one small row per group and task is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preftable.config import MASKED_MEAN_EPS
from preftable.functions import rollout as R

DEFAULT_ARRAY_METRICS = ("kl_penalty", "rewards_kl", "advantages", "ratio", "returns", "values_error")


def _tokens(df: DataFrame, group_cols: Sequence[str], arrays: Sequence[str], mask: str, row_cols: Sequence[str]) -> DataFrame:
    """A row for every position; ``__first`` marks one of each input row, also of one without positions."""
    fields = {f"t{i}": c for i, c in enumerate([mask, *arrays])}
    zipped = F.arrays_zip(*[F.col(c).alias(f) for f, c in fields.items()])
    at = df.select(*group_cols, *row_cols, F.posexplode_outer(zipped).alias("__pos", "__z"))
    first = (F.coalesce(F.col("__pos"), F.lit(0)) == 0).alias("__first")
    # A position where the mask is 0, or that a shorter array doesn't have, counts in none of the sums.
    taken = [F.when(F.col("__z.t0") != 0, F.col(f"__z.{f}").cast("double")).alias(f"__{c}") for f, c in list(fields.items())[1:]]
    return at.select(*group_cols, *row_cols, first, F.when(F.col("__z.t0") != 0, 1).alias("__m"), *taken)


def _moments(c: str) -> tuple[Column, Column]:
    """Masked mean ``Σx / (n + eps)`` and masked mean of the squares of deviations from it."""
    n, eps = F.count("__m").cast("double"), F.lit(MASKED_MEAN_EPS)
    x = F.col(f"__{c}")
    mean = F.coalesce(F.sum(x), F.lit(0.0)) / (n + eps)
    off = F.coalesce(F.avg(x), F.lit(0.0)) - mean  # eps moves the mean by this much from the true one
    return mean, n * (F.coalesce(F.var_pop(x), F.lit(0.0)) + off * off) / (n + eps)


def masked_stats(df: DataFrame, cols: Sequence[str], mask: str, group_cols: Sequence[str]) -> DataFrame:
    """Masked mean and variance of array columns per group (0/1 masks; null groups are groups too)."""
    named = [x.alias(f"{c}_{s}") for c in cols for x, s in zip(_moments(c), ("mean", "var"))]
    return _tokens(df, group_cols, cols, mask, ()).groupBy(*group_cols).agg(*named)


def rollout_metrics(
    df: DataFrame,
    group_cols: Sequence[str],
    mask: str = "mask",
    array_cols: Sequence[str] = DEFAULT_ARRAY_METRICS,
    reward_col: str = "reward_score",
    ce_cols: Sequence[str] = ("actor_ce", "ref_ce"),
    scalar_cols: Sequence[str] = (),
    length_cols: Sequence[str] = (),
) -> DataFrame:
    """Per group, in one pass: masked mean/var of the array metrics, mean and sample variance of the
    reward score and of ``length_cols``, perplexities ``exp(avg(ce))`` and the mean of any scalar
    columns (losses, lr)."""
    arrays = [c for c in array_cols if c in df.columns]
    rows = list(dict.fromkeys([reward_col, *ce_cols, *scalar_cols, *length_cols]))
    once = lambda c: F.when(F.col("__first"), F.col(c))
    out = [x.alias(f"{c}_{s}") for c in arrays for x, s in zip(_moments(c), ("mean", "var"))]
    out += [F.avg(once(reward_col)).alias("reward_score_mean"), F.var_samp(once(reward_col)).alias("reward_score_var")]
    out += [F.exp(F.avg(once(c))).alias(c.replace("_ce", "") + "_perplexity") for c in ce_cols]
    out += [F.avg(once(c)).alias(c) for c in scalar_cols]
    out += [x.alias(f"{c}_{s}") for c in length_cols for x, s in ((F.avg(once(c)), "mean"), (F.var_samp(once(c)), "var"))]
    return _tokens(df, group_cols, arrays, mask, rows).groupBy(*group_cols).agg(*out)


def length_metrics(df: DataFrame, group_cols: Sequence[str], prompt_col: str = "prompt_ids", response_col: str = "response_ids") -> DataFrame:
    """Mean and sample variance of the unpadded prompt and response lengths."""
    return df.groupBy(*group_cols).agg(
        F.avg(F.size(prompt_col)).alias("prompts_length_mean"),
        F.var_samp(F.size(prompt_col)).alias("prompts_length_var"),
        F.avg(F.size(response_col)).alias("responses_length_mean"),
        F.var_samp(F.size(response_col)).alias("responses_length_var"),
    )


def step_metrics(
    step_log: DataFrame,
    accum: int,
    metric_cols: Sequence[str],
    step_col: str = "step",
    rank_col: str = "rank",
) -> DataFrame:
    """Average each metric over the ``accum`` micro-steps of an update, then over ranks.

    ``update = ceil(step / accum)``; an update whose window is not complete (fewer than
    ``accum`` steps on a rank) is not logged, as in the reference.
    """
    upd = F.ceil(F.col(step_col) / F.lit(accum)).cast("long").alias("update")
    first = (
        step_log.select(upd, rank_col, *metric_cols)
        .groupBy("update", rank_col)
        .agg(F.count(F.lit(1)).alias("__n"), *[F.avg(c).alias(c) for c in metric_cols])
        .filter(F.col("__n") == accum)
    )
    return first.groupBy("update").agg(*[F.avg(c).alias(c) for c in metric_cols])


def log_cadence(df: DataFrame, every: int, update_col: str = "update") -> DataFrame:
    """Keep every ``every``-th update."""
    return df.filter((F.col(update_col) > 0) & (F.pmod(F.col(update_col), F.lit(every)) == 0))


def pair_eval_metrics(
    df: DataFrame, metric_cols: Sequence[str], batch_col: str = "batch_id", compat: bool = False
) -> DataFrame:
    """``eval_``-prefixed means. Default: over all rows. ``compat``: the last batch's means only
    (the reference overwrites the running value at every batch)."""
    if not compat:
        return df.agg(*[F.avg(c).alias(f"eval_{c}") for c in metric_cols])
    per_batch = df.groupBy(batch_col).agg(*[F.avg(c).alias(c) for c in metric_cols])
    return per_batch.agg(*[F.max_by(c, batch_col).alias(f"eval_{c}") for c in metric_cols])


def masked_mean_agg(x: str, mask: str) -> Column:
    """Aggregate: ``Σ(x·m) / (Σm + 1e-8)`` over the arrays of a group."""
    return F.sum(R.masked_sum(F.col(x), F.col(mask))) / (F.sum(R.array_sum(F.col(mask))) + F.lit(MASKED_MEAN_EPS))
