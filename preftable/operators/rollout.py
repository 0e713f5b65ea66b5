"""Table-level rollout operators (§2.7): sequences from generations, batch whitening, experience.

Per-sequence arithmetic is array expressions inside one row (no shuffle). Batch statistics are
window sums over ``batch_id``; a batch holds ``batch_size`` sequences, so each window partition is
bounded regardless of table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from preftable.config import RolloutConfig, SpecialIds
from preftable.functions import rollout as R
from preftable.functions.arrays import attention_mask, right_pad
from preftable.functions.scan import suffix_carries


def slice_response(ids: str, prompt_width: int | str):
    """Drop the first ``prompt_width`` columns of generated ids."""
    w = F.lit(prompt_width) if isinstance(prompt_width, int) else F.col(prompt_width)
    return F.slice(F.col(ids), w + 1, F.greatest(F.size(F.col(ids)) - w, F.lit(0)))


def strip_and_join(
    df: DataFrame,
    batch_col: str = "batch_id",
    prompt_col: str = "prompt_ids",
    response_col: str = "response_ids",
    ids: SpecialIds = SpecialIds(),
) -> DataFrame:
    """Strip left pad from prompts (by count of pad ids) and right pad from responses (keep the
    first ``count(id != pad)``), join, right-pad to the batch's longest, and mask."""
    pad = F.lit(ids.pad_id)
    p = F.col(prompt_col)
    r = F.col(response_col)
    n_pad = F.size(F.filter(p, lambda x: x == pad))
    prompt = F.slice(p, n_pad + 1, F.size(p) - n_pad)
    resp = F.slice(r, 1, F.size(F.filter(r, lambda x: x != pad)))
    out = df.withColumn("prompt_ids", prompt).withColumn("response_ids", resp)
    out = out.withColumn("__seq", F.concat("prompt_ids", "response_ids"))
    out = out.withColumn("__m", F.max(F.size("__seq")).over(Window.partitionBy(batch_col)))
    out = out.withColumn("sequence_ids", right_pad(F.col("__seq"), F.col("__m"), ids.pad_id))
    out = out.withColumn("sequence_mask", attention_mask(F.col("sequence_ids"), ids.pad_id))
    return out.drop("__seq", "__m")


def masked_whiten(
    df: DataFrame,
    x_col: str,
    mask_col: str,
    batch_col: str = "batch_id",
    out_col: str | None = None,
    shift_mean: bool = True,
    compat: bool = False,
) -> DataFrame:
    """Whiten an array column with statistics over the whole batch.

    mean = ``Σ(x·m) / Σm`` (``compat``: ``Σx / Σm``, unmasked numerator as in the reference),
    var = ``Σ m·(x-mean)² / Σm``; result ``(x-mean)·rsqrt(var + 1e-6)`` (+ mean unless shift_mean).
    Two window passes over the same ``batch_id`` partitioning: one shuffle.
    """
    out_col = out_col or x_col
    x, m = F.col(x_col), F.col(mask_col)
    w = Window.partitionBy(batch_col)
    num = R.array_sum(x) if compat else R.masked_sum(x, m)
    # try_divide: a batch without any masked-in token gives NULL instead of failing under ANSI.
    out = df.withColumn("__wm", F.try_divide(F.sum(num).over(w), F.sum(R.array_sum(m)).over(w)))
    dev = F.zip_with(x, m, lambda v, k: (v - F.col("__wm")) * (v - F.col("__wm")) * k)
    out = out.withColumn("__wv", F.try_divide(F.sum(R.array_sum(dev)).over(w), F.sum(R.array_sum(m)).over(w)))
    out = out.withColumn(out_col, R.whiten(x, F.col("__wm"), F.col("__wv"), shift_mean))
    return out.drop("__wm", "__wv")


def gae_long(
    df: DataFrame,
    seq_col: str,
    pos_col: str,
    reward_col: str,
    value_col: str,
    gamma: float = 1.0,
    lam: float = 0.95,
    out_col: str = "advantage",
    chunk: int = 1024,
    fan: int = 1024,
    levels: int = 1,
) -> DataFrame:
    """GAE over a long ``(seq, pos, reward, value)`` table, linear in T, no whole-sequence task.

    Rows are grouped into chunks of at most ``chunk`` positions and each chunk's advantages are found
    as if nothing followed it (the array form's scan, so a sequence that fits one chunk gets the same
    values). What position t sends back is ``U_t = γ·V_t + γλ·A_t``, so a chunk is the affine map
    ``U -> (γ·V_0 + γλ·A_0) + (γλ)^len·U`` of what its successor sends, and ``suffix_carries`` finds
    the value that reaches every chunk through ``levels`` of ``fan`` chunks (with one, a row holds an entry
    for every 2^20 positions of a sequence). Then
    ``A_t = local_t + (γλ)^(len-1-i)·U``. No division, and no self-join for ``V_{t+1}``.
    """
    c = float(gamma) * float(lam)
    cols = [x for x in df.columns if x != seq_col]
    base = df.withColumn("__chunk", F.floor(F.col(pos_col) / int(chunk)).cast("long"))
    chunks = base.groupBy(seq_col, "__chunk").agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("__p"), *[F.col(x) for x in cols]))).alias("__rows")
    )
    field = lambda name: F.transform("__rows", lambda r: r[name].cast("double"))
    chunks = chunks.withColumn("__local", R.gae(field(reward_col), field(value_col), gamma, lam)).withColumn("__len", F.size("__rows"))
    maps = chunks.select(
        seq_col, "__chunk", F.pow(F.lit(c), F.col("__len").cast("double")).alias("__a"),
        (F.lit(float(gamma)) * F.get(F.col("__rows"), 0)[value_col].cast("double") + F.lit(c) * F.get(F.col("__local"), 0)).alias("__b"),
    )
    carries = suffix_carries(maps, seq_col, "__chunk", "__a", "__b", "__u", fan, levels)
    exploded = chunks.join(carries, [seq_col, "__chunk"]).select(
        seq_col, "__len", "__u", F.posexplode(F.arrays_zip(F.col("__rows").alias("r"), F.col("__local").alias("a"))).alias("__i", "__z")
    )
    adv = F.col("__z.a") + F.pow(F.lit(c), (F.col("__len") - F.col("__i") - 1).cast("double")) * F.col("__u")
    return exploded.select(seq_col, *[F.col("__z.r")[x].alias(x) for x in cols], adv.alias(out_col))


def build_experience(
    df: DataFrame,
    cfg: RolloutConfig = RolloutConfig(),
    batch_col: str = "batch_id",
    reward_col: str | None = None,
) -> DataFrame:
    """Rollout fields from logged scores.

    Input arrays: ``sequence_mask``/``response_mask`` (length T), ``actor_logp``/``ref_logp``
    (T-1), ``critic_values`` (T, the last one is dropped) and either ``ref_values`` (T, the reward
    is its value at the last response position) or a scalar ``reward_col``.
    Output adds ``reward_score`` (NULL and ``quarantine_reason`` set for an empty response),
    ``kl_penalty``, ``rewards_kl``, ``critic_values`` (masked, T-1),
    ``advantages`` (whitened when enabled), ``returns``, ``actor_ce`` and ``ref_ce``.
    """
    ms = R.shifted(F.col("response_mask"))
    score = F.col(reward_col) if reward_col else R.last_reward(F.col("ref_values"), F.col("response_mask"))
    score = F.when(R.last_index(ms).isNotNull(), score.cast("double"))  # Q10: an empty response has no reward
    out = df.withColumn("reward_score", R.clip_reward(score, cfg.reward_score_clip))
    out = out.withColumn("__pen", R.kl_penalty(F.col("actor_logp"), F.col("ref_logp"), cfg.kl_penalty_beta, cfg.kl_penalty_method))
    out = out.withColumn("rewards_kl", R.rewards_with_kl(F.col("__pen"), F.col("reward_score"), ms))
    out = out.withColumn("kl_penalty", F.col("rewards_kl") if cfg.compat else F.col("__pen"))
    cv = F.slice(F.col("critic_values"), 1, F.greatest(F.size("critic_values") - 1, F.lit(0)))
    out = out.withColumn("critic_values", R.mask_scores(cv, ms))
    out = out.withColumn("rewards_kl", R.mask_scores(F.col("rewards_kl"), ms))
    out = out.withColumn("advantages", R.gae(F.col("rewards_kl"), F.col("critic_values"), cfg.gamma, cfg.lam))
    out = out.withColumn("returns", R.returns(F.col("advantages"), F.col("critic_values")))
    out = out.withColumn("actor_ce", R.sequence_ce(F.col("actor_logp"), F.col("sequence_mask")))
    out = out.withColumn("ref_ce", R.sequence_ce(F.col("ref_logp"), F.col("sequence_mask")))
    out = out.withColumn("__ms", ms)
    if cfg.use_advantage_norm:
        out = masked_whiten(out, "advantages", "__ms", batch_col, compat=cfg.compat)
    # Q10: a response without tokens has no last position; keep the row but flag it.
    out = out.withColumn(
        "quarantine_reason", F.when(R.last_index(F.col("__ms")).isNull(), F.lit("empty response"))
    )
    return out.drop("__pen", "__ms")


def normalise_advantages(
    df: DataFrame, batch_col: str = "batch_id", advantages: str = "advantages", mask_col: str = "response_mask", compat: bool = False
) -> DataFrame:
    """``masked_whiten(advantages, response_mask[1:])`` over each batch (returns stay unwhitened)."""
    out = df.withColumn("__pt_ms", R.shifted(F.col(mask_col)))
    return masked_whiten(out, advantages, "__pt_ms", batch_col, compat=compat).drop("__pt_ms")
