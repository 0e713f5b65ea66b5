"""Registered queries over logged scores: rollout arithmetic, objectives and metrics (§2.7-§2.9).

Scores come from ``views.rollout_rows`` (events folded per user). Per-token results are exploded to
``(seq, pos, value)`` rows; floats are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from preftable.config import PairConfig, RolloutConfig
from preftable.functions import objectives as O
from preftable.functions import rollout as R
from preftable.operators import metrics as M
from preftable.operators import objectives as OB
from preftable.operators.indexing import with_group_row_number
from preftable.operators.rollout import build_experience, gae_long, normalise_advantages
from preftable.operators.rollout_long import build_experience_long
from preftable.plans import oracle as Q
from preftable.plans import views as V
from preftable.plans.catalog import register

BETA = 0.1
GAMMA = 1.0
LAM = 0.95
CLIP = 0.2
DPO_BETA = 0.1
EXTRA_W = 0.5
EXTRA_RATIO = 0.2
MAX_STEPS = 100
STEP_ACCUM = 4


def _r(col):
    return Q.round6(col)


def _rollout(spark: SparkSession, base: str) -> DataFrame:
    return V.rollout_rows(spark, base)


def _experience(spark: SparkSession, base: str, **kw) -> DataFrame:
    cfg = RolloutConfig(
        gamma=GAMMA,
        lam=LAM,
        kl_penalty_beta=kw.pop("beta", BETA),
        kl_penalty_method=kw.pop("method", "abs"),
        reward_score_clip=kw.pop("clip", None),
        use_advantage_norm=kw.pop("norm", False),
        compat=kw.pop("compat", False),
    )
    exp = build_experience(_rollout(spark, base), cfg, "batch_id", reward_col="reward")
    return exp.withColumn("ms", R.shifted(F.col("response_mask")))


def _long(df: DataFrame, cols: list[str], out: dict[str, str] | None = None) -> DataFrame:
    out = out or {c: c for c in cols}
    t = V.explode_tokens(df, ["seq"], cols)
    return t.select(F.col("seq").cast("long").alias("seq"), F.col("pos").cast("long").alias("pos"), *[_r(F.col(c)).alias(n) for c, n in out.items()])


_TOK = f"WITH RECURSIVE {Q.SCORES_CTE}"


# ---------------------------------------------------------------------------------------------
# KL penalty and rewards
# ---------------------------------------------------------------------------------------------


def _kl_query(method: str | None):
    def q(spark: SparkSession, base: str) -> DataFrame:
        r = _rollout(spark, base).withColumn("kl_penalty", R.kl_penalty(F.col("actor_logp"), F.col("ref_logp"), BETA, method))
        return _long(r, ["kl_penalty"])

    return q


for _name, _method in (("kl_penalty_abs", "abs"), ("kl_penalty_mse", "mse"), ("kl_penalty_raw", None)):
    register(_name, f"{_TOK} SELECT seq, pos, {Q.rnd(Q.penalty_expr(_method, BETA))} AS kl_penalty FROM tok")(
        _kl_query(_method)
    )


@register("rewards_kl", f"{_TOK}, {Q.gae_ctes('abs', BETA, GAMMA, LAM)} SELECT seq, pos, {Q.rnd('rkl')} AS rewards_kl FROM rk")
def rewards_kl(spark: SparkSession, base: str) -> DataFrame:
    return _long(_experience(spark, base), ["rewards_kl"])


@register(
    "rewards_kl_clip",
    f"{_TOK}, {Q.gae_ctes('abs', BETA, GAMMA, LAM, clip=1.0)} SELECT seq, pos, {Q.rnd('rkl')} AS rewards_kl FROM rk",
)
def rewards_kl_clip(spark: SparkSession, base: str) -> DataFrame:
    return _long(_experience(spark, base, clip=1.0), ["rewards_kl"])


@register(
    "kl_penalty_compat",
    f"{_TOK}, {Q.gae_ctes('abs', BETA, GAMMA, LAM)} SELECT seq, pos, {Q.rnd('rkl_raw')} AS kl_penalty FROM rk",
)
def kl_penalty_compat(spark: SparkSession, base: str) -> DataFrame:
    return _long(_experience(spark, base, compat=True), ["kl_penalty"])


@register(
    "last_reward",
    f"{_TOK} SELECT seq, {Q.rnd('value')} AS reward_score FROM ev WHERE pos = T - 1",
)
def last_reward(spark: SparkSession, base: str) -> DataFrame:
    r = _rollout(spark, base)
    return r.select(F.col("seq").cast("long").alias("seq"), _r(R.last_reward(F.col("critic_values"), F.col("response_mask"))).alias("reward_score"))


# ---------------------------------------------------------------------------------------------
# Advantages, returns, whitening
# ---------------------------------------------------------------------------------------------

_GAE = f"WITH RECURSIVE {Q.SCORES_CTE}, {Q.gae_ctes('abs', BETA, GAMMA, LAM)}"


@register("gae_array", f"{_GAE} SELECT seq, pos, {Q.rnd('a')} AS advantage, {Q.rnd('r')} AS return_value FROM ret")
def gae_array(spark: SparkSession, base: str) -> DataFrame:
    return _long(_experience(spark, base), ["advantages", "returns"], {"advantages": "advantage", "returns": "return_value"})


@register("gae_long", f"{_GAE} SELECT seq, pos, {Q.rnd('a')} AS advantage FROM ret")
def gae_long_q(spark: SparkSession, base: str) -> DataFrame:
    exp = _experience(spark, base)
    t = V.explode_tokens(exp, ["seq"], ["rewards_kl", "critic_values"])
    g = gae_long(t, "seq", "pos", "rewards_kl", "critic_values", GAMMA, LAM, out_col="advantage")
    return g.select(F.col("seq").cast("long").alias("seq"), F.col("pos").cast("long").alias("pos"), _r(F.col("advantage")).alias("advantage"))


# A long decimal, so that no advantage is a tie at the sixth place, where the order of operations would show.
LAM_CHUNKS = 0.951234567


@register(
    "gae_chunks",
    f"{_TOK}, {Q.gae_ctes('abs', BETA, GAMMA, LAM_CHUNKS)} SELECT seq, pos, {Q.rnd('a')} AS advantage FROM ret",
)
def gae_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Sequences of several chunks, chunks of several runs: what chunks send back crosses two levels."""
    t = V.explode_tokens(_experience(spark, base), ["seq"], ["rewards_kl", "critic_values"])
    g = gae_long(t, "seq", "pos", "rewards_kl", "critic_values", GAMMA, LAM_CHUNKS, chunk=8, fan=4, levels=2)
    return g.select(F.col("seq").cast("long").alias("seq"), F.col("pos").cast("long").alias("pos"), _r(F.col("advantage")).alias("advantage"))


def _positions(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """The score views' sequences as rows per position, and a row for each sequence; no user's events meet in one row."""
    s = V._scores(V.table(spark, base, "events"))
    ranked = with_group_row_number(s.select("seq", "event_id", "actor", "ref", "value"), ["seq"], ["event_id"], name="pos")
    rows = ranked.select(
        "seq", "pos", F.col("actor").alias("actor_logp"), F.col("ref").alias("ref_logp"), "value", F.lit(1).alias("sequence_mask"),
        F.when(F.col("pos") < V.PROMPT_POSITIONS, 0).otherwise(1).alias("response_mask"),
    )
    reward = (F.pmod(F.col("seq") * 13, F.lit(41)) - 20).cast("double") / F.lit(10.0)
    users = s.select("seq").distinct().select("seq", F.floor(F.col("seq") / V.SCORE_BATCH).cast("long").alias("batch_id"), reward.alias("reward"))
    return rows, users


def _experience_long(spark: SparkSession, base: str, norm: bool) -> tuple[DataFrame, DataFrame]:
    cfg = RolloutConfig(gamma=GAMMA, lam=LAM_CHUNKS, kl_penalty_beta=BETA, kl_penalty_method="abs", use_advantage_norm=norm)
    return build_experience_long(*_positions(spark, base), cfg, chunk=16, fan=4, levels=2)


_GAE_LONG = f"{_TOK}, {Q.gae_ctes('abs', BETA, GAMMA, LAM_CHUNKS)}"


@register(
    "experience_long",
    f"""{_GAE_LONG} SELECT seq, pos, {Q.rnd('pen')} AS kl_penalty, {Q.rnd('rkl')} AS rewards_kl, {Q.rnd('v')} AS critic_values,
       {Q.rnd('a')} AS advantage, {Q.rnd('r')} AS return_value, CAST(ms AS BIGINT) AS mask FROM ret""",
)
def experience_long(spark: SparkSession, base: str) -> DataFrame:
    tokens, _ = _experience_long(spark, base, norm=False)
    names = {"kl_penalty": "kl_penalty", "rewards_kl": "rewards_kl", "critic_values": "critic_values", "advantages": "advantage", "returns": "return_value"}
    return tokens.select(F.col("seq").cast("long").alias("seq"), "pos", *[_r(F.col(c)).alias(n) for c, n in names.items()], F.col("mask").cast("long").alias("mask"))


@register(
    "experience_long_sequences",
    f"""{_TOK} SELECT seq, any_value(batch_id) AS batch_id, {Q.rnd('any_value(reward)')} AS reward_score, {Q.rnd('-sum(actor) / (count(*) + 1e-8)')} AS actor_ce,
       {Q.rnd('-sum(ref) / (count(*) + 1e-8)')} AS ref_ce FROM tok GROUP BY seq""",
)
def experience_long_sequences(spark: SparkSession, base: str) -> DataFrame:
    _, whole = _experience_long(spark, base, norm=False)
    return whole.select(F.col("seq").cast("long").alias("seq"), "batch_id", *[_r(F.col(c)).alias(c) for c in ("reward_score", "actor_ce", "ref_ce")])


def _whiten_sql(compat: bool) -> str:
    num = "sum(a)" if compat else "sum(a * ms)"
    return f"""{_GAE},
wm AS (SELECT batch_id, {num} / sum(ms) AS mean FROM ret GROUP BY batch_id),
wv AS (SELECT ret.batch_id, sum(ms * (a - wm.mean) * (a - wm.mean)) / sum(ms) AS var
       FROM ret JOIN wm ON ret.batch_id = wm.batch_id GROUP BY ret.batch_id)
SELECT ret.seq, ret.pos, {Q.rnd('(ret.a - wm.mean) / sqrt(wv.var + 1e-6)')} AS advantage
FROM ret JOIN wm ON ret.batch_id = wm.batch_id JOIN wv ON ret.batch_id = wv.batch_id"""


@register("whiten", _whiten_sql(False))
def whiten(spark: SparkSession, base: str) -> DataFrame:
    return _long(_experience(spark, base, norm=True), ["advantages"], {"advantages": "advantage"})


@register("whiten_compat", _whiten_sql(True))
def whiten_compat(spark: SparkSession, base: str) -> DataFrame:
    return _long(_experience(spark, base, norm=True, compat=True), ["advantages"], {"advantages": "advantage"})


# ---------------------------------------------------------------------------------------------
# Cross-entropy, perplexity, PPO losses
# ---------------------------------------------------------------------------------------------


@register("whiten_long", _whiten_sql(False).replace(_GAE, _GAE_LONG))
def whiten_long(spark: SparkSession, base: str) -> DataFrame:
    tokens, _ = _experience_long(spark, base, norm=True)
    return tokens.select(F.col("seq").cast("long").alias("seq"), "pos", _r(F.col("advantages")).alias("advantage"))


@register(
    "sequence_ce",
    f"""{_TOK} SELECT seq, {Q.rnd('-sum(actor) / (count(*) + 1e-8)')} AS actor_ce,
       {Q.rnd('-sum(ref) / (count(*) + 1e-8)')} AS ref_ce FROM tok GROUP BY seq""",
)
def sequence_ce(spark: SparkSession, base: str) -> DataFrame:
    r = _rollout(spark, base)
    return r.select(
        F.col("seq").cast("long").alias("seq"),
        _r(R.sequence_ce(F.col("actor_logp"), F.col("sequence_mask"))).alias("actor_ce"),
        _r(R.sequence_ce(F.col("ref_logp"), F.col("sequence_mask"))).alias("ref_ce"),
    )


_CLM_SQL = "-sum(actor * ms) / sum(ms)"


@register(
    "clm_perplexity",
    f"""{_TOK} SELECT batch_id, {Q.rnd(_CLM_SQL)} AS clm_loss, {Q.rnd(f'exp({_CLM_SQL})')} AS perplexity
FROM tok GROUP BY batch_id""",
)
def clm_perplexity(spark: SparkSession, base: str) -> DataFrame:
    r = _rollout(spark, base).withColumn("ms", R.shifted(F.col("response_mask")))
    c = OB.clm_loss(r, "actor_logp", mask="ms", group_cols=("batch_id",))
    return c.select("batch_id", _r(F.col("clm_loss")).alias("clm_loss"), _r(F.col("perplexity")).alias("perplexity"))


_ACTOR_SQL = f"""{_GAE},
pa AS (SELECT *, exp((new - actor) * ms) AS ratio FROM ret),
pt AS (SELECT *, greatest(-a * ratio, -a * greatest({1 - CLIP}, least({1 + CLIP}, ratio))) AS term,
              greatest(v - {CLIP}, least(v + {CLIP}, new_value)) AS clipped FROM pa),
al AS (SELECT batch_id, sum(term * ms) / (sum(ms) + 1e-8) AS actor_loss,
              0.5 * sum(greatest((new_value - r) * (new_value - r), (clipped - r) * (clipped - r)) * ms) / (sum(ms) + 1e-8) AS critic_loss,
              sum((new_value - r) * (new_value - r) * ms) / (sum(ms) + 1e-8) AS values_error_mean,
              {_CLM_SQL} AS clm_loss
       FROM pt GROUP BY batch_id)"""


def _losses(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    exp = _experience(spark, base)
    actor = OB.ppo_actor_loss(exp, "batch_id", "advantages", "new_logp", "actor_logp", "ms", CLIP)
    critic = OB.ppo_critic_loss(exp, "batch_id", "critic_values", "new_values", "returns", "ms", CLIP)
    clm = OB.clm_loss(exp, "actor_logp", mask="ms", group_cols=("batch_id",))
    return actor, critic, clm


@register("ppo_actor_loss", f"{_ACTOR_SQL} SELECT batch_id, {Q.rnd('actor_loss')} AS actor_loss FROM al")
def ppo_actor_loss(spark: SparkSession, base: str) -> DataFrame:
    actor, _, _ = _losses(spark, base)
    return actor.select("batch_id", _r(F.col("actor_loss")).alias("actor_loss"))


@register(
    "ppo_critic_loss",
    f"{_ACTOR_SQL} SELECT batch_id, {Q.rnd('critic_loss')} AS critic_loss, {Q.rnd('values_error_mean')} AS values_error_mean FROM al",
)
def ppo_critic_loss(spark: SparkSession, base: str) -> DataFrame:
    _, critic, _ = _losses(spark, base)
    return critic.select("batch_id", _r(F.col("critic_loss")).alias("critic_loss"), _r(F.col("values_error_mean")).alias("values_error_mean"))


_WARMUP = int(EXTRA_RATIO * MAX_STEPS)
_EXTRA_W_SQL = f"(CASE WHEN batch_id + 1 < {_WARMUP} THEN (batch_id + 1) / {float(_WARMUP)} * {EXTRA_W} ELSE pow({EXTRA_W}, 1.001) END)"


@register(
    "ppo_total_loss",
    f"{_ACTOR_SQL} SELECT batch_id, {Q.rnd(f'actor_loss + critic_loss + {_EXTRA_W_SQL} * clm_loss')} AS total_loss FROM al",
)
def ppo_total_loss(spark: SparkSession, base: str) -> DataFrame:
    exp = _experience(spark, base)
    # One aggregation computes all three losses: the experience table is read once.
    losses = exp.groupBy("batch_id").agg(
        OB.actor_loss_agg("advantages", "new_logp", "actor_logp", "ms", CLIP).alias("actor_loss"),
        OB.critic_loss_agg("critic_values", "new_values", "returns", "ms", CLIP).alias("critic_loss"),
        OB.clm_loss_agg("actor_logp", F.col("ms")).alias("clm_loss"),
    )
    w = O.extra_loss_weight(F.col("batch_id") + 1, EXTRA_W, EXTRA_RATIO, MAX_STEPS)
    total = O.ppo_total_loss(F.col("actor_loss"), F.lit(0.0), F.col("critic_loss"), F.col("clm_loss"), w)
    return losses.select("batch_id", _r(total).alias("total_loss"))


@register("extra_weight", f"{_TOK} SELECT DISTINCT batch_id + 1 AS step, {Q.rnd(_EXTRA_W_SQL)} AS weight FROM ev")
def extra_weight(spark: SparkSession, base: str) -> DataFrame:
    steps = _rollout(spark, base).select((F.col("batch_id") + 1).alias("step")).distinct()
    return steps.select("step", _r(O.extra_loss_weight(F.col("step"), EXTRA_W, EXTRA_RATIO, MAX_STEPS)).alias("weight"))


# ---------------------------------------------------------------------------------------------
# Pairs: DPO and reward-model losses (chosen = even user, rejected = user + 1)
# ---------------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, base: str) -> DataFrame:
    # Sequences are clustered by batch and a pair lies inside one batch, so folding each pair's two
    # sequences into one row is a groupBy the partitioning already satisfies: no self-join.
    r = V.rollout_rows(spark, base).withColumn("ms", R.shifted(F.col("response_mask")))
    side = ["actor_logp", "ref_logp", "ms", "critic_values", "response_mask", "sequence_mask"]
    both = r.groupBy("batch_id", "pair").agg(F.collect_list(F.struct("seq", *side)).alias("__s"))
    even = F.get(F.filter(F.col("__s"), lambda x: F.pmod(x["seq"], F.lit(2)) == 0), 0)
    odd = F.get(F.filter(F.col("__s"), lambda x: F.pmod(x["seq"], F.lit(2)) == 1), 0)
    pairs = both.select("batch_id", even.alias("__a"), odd.alias("__r")).filter(
        F.col("__a").isNotNull() & F.col("__r").isNotNull()
    )
    # Keep the grouping column itself so later per-batch steps see the existing partitioning.
    return pairs.select(
        F.col("__a.seq").alias("seq"),
        "batch_id",
        *[F.col(f"__a.{c}").alias(f"a_{c}") for c in side],
        *[F.col(f"__r.{c}").alias(f"r_{c}") for c in side],
    )


def _dpo_scores(spark: SparkSession, base: str, cfg: PairConfig) -> DataFrame:
    p = _pairs(spark, base)
    avg = cfg.average_log_prob
    s = p.select(
        F.col("seq").alias("example_id"),
        "batch_id",
        O.sequence_logps_by_mask(F.col("a_actor_logp"), F.col("a_ms"), avg).alias("accepts_logps"),
        O.sequence_logps_by_mask(F.col("r_actor_logp"), F.col("r_ms"), avg).alias("rejects_logps"),
        O.sequence_logps_by_mask(F.col("a_ref_logp"), F.col("a_ms"), avg).alias("ref_accepts_logps"),
        O.sequence_logps_by_mask(F.col("r_ref_logp"), F.col("r_ms"), avg).alias("ref_rejects_logps"),
    )
    return OB.dpo_outputs(s, cfg)


_DPO_BASE = f"""{_TOK},
sl AS (SELECT seq, any_value(batch_id) AS batch_id, sum(actor * ms) AS lp, sum(ref * ms) AS rlp FROM tok GROUP BY seq),
dp AS (SELECT c.seq AS example_id, c.batch_id, c.lp AS a, r.lp AS rj, c.rlp AS ra, r.rlp AS rr
       FROM sl c JOIN sl r ON r.seq = c.seq + 1 WHERE c.seq % 2 = 0)"""


def _dpo_sql(beta: float, reference_free: bool = False) -> str:
    ref = "0.0" if reference_free else f"{beta} * (ra - rr)"
    x = f"({beta} * (a - rj) - {ref})"
    return f"""{_DPO_BASE},
dq AS (SELECT *, {beta} * (a - ra) AS ar, {beta} * (rj - rr) AS rw, {beta} * (a - rj) AS pi, {ref} AS rf,
              greatest(-{x}, 0) + ln(1 + exp(-abs({x}))) AS loss FROM dp)"""


@register(
    "dpo_logps",
    f"""{_DPO_BASE} SELECT example_id, {Q.rnd('a')} AS accepts_logps, {Q.rnd('rj')} AS rejects_logps,
       {Q.rnd('ra')} AS ref_accepts_logps, {Q.rnd('rr')} AS ref_rejects_logps FROM dp""",
)
def dpo_logps(spark: SparkSession, base: str) -> DataFrame:
    s = _dpo_scores(spark, base, PairConfig(dpo_beta=DPO_BETA))
    return s.select("example_id", *[_r(F.col(c)).alias(c) for c in ("accepts_logps", "rejects_logps", "ref_accepts_logps", "ref_rejects_logps")])


@register(
    "dpo_rewards",
    f"""{_dpo_sql(DPO_BETA)} SELECT example_id, {Q.rnd('ar')} AS accepts_reward, {Q.rnd('rw')} AS rejects_reward,
       {Q.rnd('pi')} AS pi_ratio, {Q.rnd('rf')} AS ref_ratio, {Q.rnd('-a')} AS accepts_ce_loss, {Q.rnd('-rj')} AS rejects_ce_loss,
       {Q.rnd('loss')} AS dpo_loss_row FROM dq""",
)
def dpo_rewards(spark: SparkSession, base: str) -> DataFrame:
    s = _dpo_scores(spark, base, PairConfig(dpo_beta=DPO_BETA))
    cols = ["accepts_reward", "rejects_reward", "pi_ratio", "ref_ratio", "accepts_ce_loss", "rejects_ce_loss", "dpo_loss_row"]
    return s.select("example_id", *[_r(F.col(c)).alias(c) for c in cols])


def _dpo_loss_sql(reference_free: bool) -> str:
    return f"""{_dpo_sql(DPO_BETA, reference_free)}
SELECT batch_id, {Q.rnd('avg(loss)')} AS dpo_loss, {Q.rnd('avg(CASE WHEN ar >= rw THEN 1.0 ELSE 0.0 END)')} AS accuracy,
       count(*) AS n_pairs FROM dq GROUP BY batch_id"""


def _dpo_loss(reference_free: bool):
    def q(spark: SparkSession, base: str) -> DataFrame:
        cfg = PairConfig(dpo_beta=DPO_BETA, reference_free=reference_free)
        l = OB.dpo_loss(_dpo_scores(spark, base, cfg), "batch_id", cfg)
        return l.select("batch_id", _r(F.col("dpo_loss")).alias("dpo_loss"), _r(F.col("accuracy")).alias("accuracy"), "n_pairs")

    return q


register("dpo_loss", _dpo_loss_sql(False))(_dpo_loss(False))
register("dpo_reference_free", _dpo_loss_sql(True))(_dpo_loss(True))


@register(
    "pair_accuracy",
    f"""{_dpo_sql(DPO_BETA)} SELECT {Q.rnd('avg(CASE WHEN ar >= rw THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM dq""",
)
def pair_accuracy(spark: SparkSession, base: str) -> DataFrame:
    s = _dpo_scores(spark, base, PairConfig(dpo_beta=DPO_BETA))
    return OB.pair_accuracy(s, "accepts_reward", "rejects_reward").select(_r(F.col("accuracy")).alias("accuracy"))


_EVAL_COLS = ["accepts_reward", "rejects_reward", "pi_ratio", "ref_ratio", "accepts_ce_loss", "rejects_ce_loss"]
_EVAL_SQL = {"accepts_reward": "ar", "rejects_reward": "rw", "pi_ratio": "pi", "ref_ratio": "rf", "accepts_ce_loss": "-a", "rejects_ce_loss": "-rj"}


@register(
    "dpo_eval_metrics",
    f"{_dpo_sql(DPO_BETA)} SELECT " + ", ".join(f"{Q.rnd(f'avg({e})')} AS eval_{c}" for c, e in _EVAL_SQL.items()) + " FROM dq",
)
def dpo_eval_metrics(spark: SparkSession, base: str) -> DataFrame:
    m = M.pair_eval_metrics(_dpo_scores(spark, base, PairConfig(dpo_beta=DPO_BETA)), _EVAL_COLS, "batch_id")
    return m.select(*[_r(F.col(f"eval_{c}")).alias(f"eval_{c}") for c in _EVAL_COLS])


@register(
    "dpo_eval_metrics_compat",
    f"{_dpo_sql(DPO_BETA)} SELECT "
    + ", ".join(f"{Q.rnd(f'avg({e})')} AS eval_{c}" for c, e in _EVAL_SQL.items())
    + " FROM dq WHERE batch_id = (SELECT max(batch_id) FROM dq)",
)
def dpo_eval_metrics_compat(spark: SparkSession, base: str) -> DataFrame:
    m = M.pair_eval_metrics(_dpo_scores(spark, base, PairConfig(dpo_beta=DPO_BETA)), _EVAL_COLS, "batch_id", compat=True)
    return m.select(*[_r(F.col(f"eval_{c}")).alias(f"eval_{c}") for c in _EVAL_COLS])


def _rm(spark: SparkSession, base: str) -> DataFrame:
    p = _pairs(spark, base)
    labels = lambda mask: F.transform(mask, lambda m: F.when(m == 1, F.lit(1)).otherwise(F.lit(-100)))
    out = p.withColumn("accepts_values", O.rm_mask_values(F.col("a_critic_values"), labels(F.col("a_response_mask"))))
    out = out.withColumn("rejects_values", O.rm_mask_values(F.col("r_critic_values"), labels(F.col("r_response_mask"))))
    out = out.withColumn("accepts_end_value", O.rm_end_value(F.col("accepts_values"), F.col("a_sequence_mask"), 0))
    return out.withColumn("rejects_end_value", O.rm_end_value(F.col("rejects_values"), F.col("r_sequence_mask"), 0))


_RM_BASE = f"""{_TOK},
rv AS (SELECT seq, pos, T, batch_id, value * CASE WHEN pos < 8 THEN 0 ELSE 1 END AS mv FROM ev),
pr AS (SELECT c.seq AS pair, c.batch_id FROM (SELECT DISTINCT seq, batch_id FROM ev) c
       JOIN (SELECT DISTINCT seq FROM ev) r ON r.seq = c.seq + 1 WHERE c.seq % 2 = 0),
ends AS (SELECT pr.pair, pr.batch_id, a.mv AS ae, r.mv AS re FROM pr
         JOIN rv a ON a.seq = pr.pair AND a.pos = a.T - 1 JOIN rv r ON r.seq = pr.pair + 1 AND r.pos = r.T - 1),
last AS (SELECT batch_id, avg(greatest(-(ae - re), 0) + ln(1 + exp(-abs(ae - re)))) AS rm_loss FROM ends GROUP BY batch_id)"""


@register("rm_loss_last", f"{_RM_BASE} SELECT batch_id, {Q.rnd('rm_loss')} AS rm_loss FROM last")
def rm_loss_last(spark: SparkSession, base: str) -> DataFrame:
    l = OB.rm_pairwise_loss(_rm(spark, base), "batch_id", use_last_reward=True)
    return l.select("batch_id", _r(F.col("rm_loss")).alias("rm_loss"))


@register(
    "rm_loss_all",
    f"""{_RM_BASE},
ca AS (SELECT pr.pair, pr.batch_id, rv.pos, rv.mv FROM pr JOIN rv ON rv.seq = pr.pair),
cr AS (SELECT pr.pair, pr.batch_id, rv.pos, rv.mv FROM pr JOIN rv ON rv.seq = pr.pair + 1),
pp AS (SELECT coalesce(ca.pair, cr.pair) AS pair, coalesce(ca.batch_id, cr.batch_id) AS batch_id,
              coalesce(ca.mv, 0) - coalesce(cr.mv, 0) AS d
       FROM ca FULL OUTER JOIN cr ON ca.pair = cr.pair AND ca.pos = cr.pos),
w AS (SELECT pair, batch_id, count(*) AS width, sum(greatest(-d, 0) + ln(1 + exp(-abs(d)))) AS s FROM pp GROUP BY pair, batch_id)
SELECT batch_id, {Q.rnd(f'(sum(s) + (max(width) * count(*) - sum(width)) * {math.log(2.0)}) / (max(width) * count(*))')} AS rm_loss
FROM w GROUP BY batch_id""",
)
def rm_loss_all(spark: SparkSession, base: str) -> DataFrame:
    l = OB.rm_pairwise_loss(_rm(spark, base), "batch_id", use_last_reward=False)
    return l.select("batch_id", _r(F.col("rm_loss")).alias("rm_loss"))


@register(
    "rm_total",
    f"""{_RM_BASE},
clm AS (SELECT pr.batch_id, -sum(t.actor * t.ms) / sum(t.ms) AS clm FROM pr JOIN tok t ON t.seq = pr.pair GROUP BY pr.batch_id)
SELECT last.batch_id, {Q.rnd('last.rm_loss + 1.0 * clm.clm')} AS rm_total FROM last JOIN clm ON last.batch_id = clm.batch_id""",
)
def rm_total(spark: SparkSession, base: str) -> DataFrame:
    rm = _rm(spark, base)
    agg = rm.groupBy("batch_id").agg(
        OB.rm_last_loss_agg().alias("rm_loss"), OB.clm_loss_agg("a_actor_logp", F.col("a_ms")).alias("clm_loss")
    )
    return agg.select("batch_id", _r(O.rm_total_loss(F.col("rm_loss"), F.col("clm_loss"), 1.0)).alias("rm_total"))


# ---------------------------------------------------------------------------------------------
# Metrics
# ---------------------------------------------------------------------------------------------

_METRIC_EXPR = {
    "kl_penalty": "pen",
    "rewards_kl": "rkl",
    "advantages": "a",
    "ratio": "exp((new - actor) * ms)",
    "returns": "r",
    "values_error": "(new_value - r) * (new_value - r)",
}


def _rollout_metrics_sql() -> str:
    cols = ", ".join(f"{e} AS x_{c}" for c, e in _METRIC_EXPR.items())
    means = ", ".join(f"sum(x_{c} * ms) / (sum(ms) + 1e-8) AS m_{c}" for c in _METRIC_EXPR)
    vars_ = ", ".join(f"sum(ms * (x_{c} - mm.m_{c}) * (x_{c} - mm.m_{c})) / (sum(ms) + 1e-8) AS v_{c}" for c in _METRIC_EXPR)
    out = ", ".join(f"{Q.rnd(f'mm.m_{c}')} AS {c}_mean, {Q.rnd(f'vv.v_{c}')} AS {c}_var" for c in _METRIC_EXPR)
    return f"""{_GAE},
x AS (SELECT batch_id, seq, ms, {cols} FROM ret),
mm AS (SELECT batch_id, {means} FROM x GROUP BY batch_id),
vv AS (SELECT x.batch_id, {vars_} FROM x JOIN mm ON x.batch_id = mm.batch_id GROUP BY x.batch_id),
sq AS (SELECT seq, any_value(batch_id) AS batch_id, any_value(reward) AS reward,
              -sum(actor) / (count(*) + 1e-8) AS actor_ce, -sum(ref) / (count(*) + 1e-8) AS ref_ce FROM tok GROUP BY seq),
sc AS (SELECT batch_id, avg(reward) AS rsm, var_samp(reward) AS rsv, exp(avg(actor_ce)) AS ap, exp(avg(ref_ce)) AS rp
       FROM sq GROUP BY batch_id)
SELECT mm.batch_id, {out}, {Q.rnd('sc.rsm')} AS reward_score_mean, {Q.rnd('sc.rsv')} AS reward_score_var,
       {Q.rnd('sc.ap')} AS actor_perplexity, {Q.rnd('sc.rp')} AS ref_perplexity
FROM mm JOIN vv ON mm.batch_id = vv.batch_id JOIN sc ON mm.batch_id = sc.batch_id"""


@register("rollout_metrics", _rollout_metrics_sql())
def rollout_metrics(spark: SparkSession, base: str) -> DataFrame:
    exp = _experience(spark, base)
    exp = exp.withColumn("ratio", R.policy_ratio(F.col("new_logp"), F.col("actor_logp"), F.col("ms")))
    exp = exp.withColumn("values_error", O.values_error(F.col("new_values"), F.col("returns")))
    m = M.rollout_metrics(exp, ["batch_id"], mask="ms", array_cols=list(_METRIC_EXPR))
    return m.select("batch_id", *[_r(F.col(c)).alias(c) for c in m.columns if c != "batch_id"])


@register(
    "length_metrics",
    f"""{_TOK}, sq AS (SELECT seq, any_value(batch_id) AS batch_id, 8 AS pl, any_value(T) - 8 AS rl FROM ev GROUP BY seq)
SELECT batch_id, {Q.rnd('avg(pl)')} AS prompts_length_mean, {Q.rnd('var_samp(pl)')} AS prompts_length_var,
       {Q.rnd('avg(rl)')} AS responses_length_mean, {Q.rnd('var_samp(rl)')} AS responses_length_var FROM sq GROUP BY batch_id""",
)
def length_metrics(spark: SparkSession, base: str) -> DataFrame:
    r = _rollout(spark, base)
    n = F.size("sequence_mask")
    r = r.select(
        "batch_id",
        F.slice("sequence_mask", 1, V.PROMPT_POSITIONS).alias("prompt_ids"),
        F.slice(F.col("sequence_mask"), V.PROMPT_POSITIONS + 1, n - V.PROMPT_POSITIONS).alias("response_ids"),
    )
    m = M.length_metrics(r, ["batch_id"])
    return m.select("batch_id", *[_r(F.col(c)).alias(c) for c in m.columns if c != "batch_id"])


def _step_log(spark: SparkSession, base: str) -> DataFrame:
    # Step = position of the event within its user; numbered without a per-user window, so one
    # user holding a large share of the events does not land in a single task.
    ev = V.table(spark, base, "events").select("user_id", "event_id", "value")
    ranked = with_group_row_number(ev, ["user_id"], ["event_id"], name="pos")
    return ranked.select(F.col("user_id").alias("rank"), (F.col("pos") + 1).alias("step"), "value")


_STEP_SQL = f"""sl AS (SELECT user_id AS rank, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, value FROM events),
u AS (SELECT CAST(ceil(step / {float(STEP_ACCUM)}) AS BIGINT) AS update, rank, avg(value) AS value FROM sl
      GROUP BY 1, 2 HAVING count(*) = {STEP_ACCUM}),
um AS (SELECT update, avg(value) AS value FROM u GROUP BY update)"""


@register("step_metrics", f"WITH {_STEP_SQL} SELECT update, {Q.rnd('value')} AS value FROM um")
def step_metrics(spark: SparkSession, base: str) -> DataFrame:
    s = M.step_metrics(_step_log(spark, base), STEP_ACCUM, ["value"])
    return s.select("update", _r(F.col("value")).alias("value"))


@register("log_cadence", f"WITH {_STEP_SQL} SELECT update, {Q.rnd('value')} AS value FROM um WHERE update > 0 AND update % 2 = 0")
def log_cadence(spark: SparkSession, base: str) -> DataFrame:
    s = M.log_cadence(M.step_metrics(_step_log(spark, base), STEP_ACCUM, ["value"]), 2)
    return s.select("update", _r(F.col("value")).alias("value"))


# ---------------------------------------------------------------------------------------------
# Token log-probabilities and entropies over logits (first 8 embedding values as one position)
# ---------------------------------------------------------------------------------------------


# Runs of eight vectors as the logits of a sequence's positions, their labels as its ids.
_LOGITS = """p AS (SELECT vec_id // 8 AS seq, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) - 1 AS pos,
             embedding, lead(label) OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) AS y FROM embeddings),
u AS (SELECT p.seq, p.pos, p.y, CAST(x.v AS DOUBLE) AS v, x.k - 1 AS k
      FROM p, unnest(p.embedding) WITH ORDINALITY AS x(v, k) WHERE p.y IS NOT NULL),
m AS (SELECT seq, pos, max(v) AS mx FROM u GROUP BY seq, pos),
l AS (SELECT u.seq, u.pos, m.mx + ln(sum(exp(u.v - m.mx))) AS lse
      FROM u JOIN m ON u.seq = m.seq AND u.pos = m.pos GROUP BY u.seq, u.pos, m.mx),
h AS (SELECT u.seq, u.pos, u.y, max(CASE WHEN u.k = u.y THEN u.v END) - l.lse AS logp,
             -sum(exp(u.v - l.lse) * (u.v - l.lse)) AS ent
      FROM u JOIN l ON u.seq = l.seq AND u.pos = l.pos GROUP BY u.seq, u.pos, u.y, l.lse)"""


def _logit_sequences(spark: SparkSession, base: str) -> DataFrame:
    e = V.table(spark, base, "embeddings").select("vec_id", "embedding", "label")
    rows = e.groupBy(F.floor(F.col("vec_id") / 8).cast("long").alias("seq")).agg(
        F.array_sort(F.collect_list(F.struct("vec_id", "embedding", "label"))).alias("__s")
    )
    return rows.select(
        "seq",
        F.transform("__s", lambda x: x["embedding"].cast("array<double>")).alias("logits"),
        F.transform("__s", lambda x: x["label"]).alias("ids"),
    )


@register(
    "token_logprobs",
    f"""WITH {_LOGITS}
SELECT seq, pos, {Q.rnd('logp')} AS logp, {Q.rnd('ent')} AS entropy FROM h""",
)
def token_logprobs(spark: SparkSession, base: str) -> DataFrame:
    s = _logit_sequences(spark, base)
    long = s.select("seq", R.token_scores(F.col("logits"), F.col("ids")).alias("x")).select("seq", F.posexplode("x").alias("pos", "x"))
    return long.select("seq", F.col("pos").cast("long").alias("pos"), _r(F.col("x.logp")).alias("logp"), _r(F.col("x.entropy")).alias("entropy"))


@register(
    "returns",
    f"{_GAE} SELECT seq, pos, {Q.rnd('r')} AS return_value, {Q.rnd('r - v - a')} AS returns_minus_values_minus_adv FROM ret",
)
def returns_q(spark: SparkSession, base: str) -> DataFrame:
    exp = _experience(spark, base)
    check = F.zip_with(
        F.zip_with(F.col("returns"), F.col("critic_values"), lambda r, v: r - v), F.col("advantages"), lambda d, a: d - a
    )
    return _long(exp.withColumn("check", check), ["returns", "check"], {"returns": "return_value", "check": "returns_minus_values_minus_adv"})


@register(
    "token_entropy",
    f"""WITH {_LOGITS}
SELECT seq // 4 AS batch_id,
       {Q.rnd('sum(ent * CASE WHEN y > 0 THEN 1 ELSE 0 END) / (sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) + 1e-8)')} AS entropy
FROM h GROUP BY seq // 4""",
)
def token_entropy_q(spark: SparkSession, base: str) -> DataFrame:
    # Ids of class 0 are masked out; the mask is that of the predicted positions.
    s = _logit_sequences(spark, base)
    shifted = F.slice(F.col("ids"), 2, F.greatest(F.size("ids") - 1, F.lit(0)))
    s = s.withColumn("mask", F.transform(shifted, lambda y: F.when(y > 0, 1).otherwise(0)))
    s = s.withColumn("batch_id", F.floor(F.col("seq") / 4).cast("long"))
    out = OB.token_entropy(s, "logits", "mask")
    return out.select("batch_id", _r(F.col("entropy")).alias("entropy"))


def _labels_from_mask(mask):
    # Labels of a sequence: ignored (-100) on prompt positions, a token id elsewhere.
    return F.transform(mask, lambda m, i: F.when(m == 1, i + 3).otherwise(F.lit(-100)))


def _dpo_label_logps(spark: SparkSession, base: str, average: bool) -> DataFrame:
    p = _pairs(spark, base)
    return p.select(
        F.col("seq").alias("example_id"),
        O.dpo_sequence_logps(F.col("a_actor_logp"), _labels_from_mask(F.col("a_response_mask")), average).alias("accepts_logps"),
        O.dpo_sequence_logps(F.col("r_actor_logp"), _labels_from_mask(F.col("r_response_mask")), average).alias("rejects_logps"),
    )


@register(
    "dpo_sequence_logps_avg",
    f"""{_TOK},
sl AS (SELECT seq, sum(actor * ms) / (sum(ms) + 1e-8) AS lp FROM tok GROUP BY seq)
SELECT c.seq AS example_id, {Q.rnd('c.lp')} AS accepts_logps, {Q.rnd('r.lp')} AS rejects_logps
FROM sl c JOIN sl r ON r.seq = c.seq + 1 WHERE c.seq % 2 = 0""",
)
def dpo_sequence_logps_avg(spark: SparkSession, base: str) -> DataFrame:
    d = _dpo_label_logps(spark, base, average=True)
    return d.select("example_id", _r(F.col("accepts_logps")).alias("accepts_logps"), _r(F.col("rejects_logps")).alias("rejects_logps"))


@register(
    "dpo_sequence_logps_sum",
    f"""{_TOK},
sl AS (SELECT seq, sum(actor * ms) AS lp FROM tok GROUP BY seq)
SELECT c.seq AS example_id, {Q.rnd('c.lp')} AS accepts_logps, {Q.rnd('r.lp')} AS rejects_logps
FROM sl c JOIN sl r ON r.seq = c.seq + 1 WHERE c.seq % 2 = 0""",
)
def dpo_sequence_logps_sum(spark: SparkSession, base: str) -> DataFrame:
    d = _dpo_label_logps(spark, base, average=False)
    return d.select("example_id", _r(F.col("accepts_logps")).alias("accepts_logps"), _r(F.col("rejects_logps")).alias("rejects_logps"))


@register("metrics_sink_round_trip", f"WITH {_STEP_SQL} SELECT update, {Q.rnd('value')} AS value FROM um")
def metrics_sink_round_trip(spark: SparkSession, base: str) -> DataFrame:
    import uuid

    from preftable.session import scratch_table_path
    from preftable.sources.sinks import write_metrics

    path = scratch_table_path(spark, f"metrics-{uuid.uuid4().hex}")
    write_metrics(M.step_metrics(_step_log(spark, base), STEP_ACCUM, ["value"]), path)
    back = spark.read.schema("update BIGINT, value DOUBLE").json(path)
    return back.select("update", _r(F.col("value")).alias("value"))


_PPO_LOG_METRICS = ["kl_penalty_mean", "advantages_mean", "returns_mean", "actor_loss", "critic_loss"]


@register(
    "ppo_log_end_to_end",
    f"""{_GAE},
wm AS (SELECT batch_id, sum(a * ms) / sum(ms) AS mean FROM ret GROUP BY batch_id),
wv AS (SELECT ret.batch_id, sum(ms * (a - wm.mean) * (a - wm.mean)) / sum(ms) AS var
       FROM ret JOIN wm ON ret.batch_id = wm.batch_id GROUP BY ret.batch_id),
w AS (SELECT ret.*, (ret.a - wm.mean) / sqrt(wv.var + 1e-6) AS aw
      FROM ret JOIN wm ON ret.batch_id = wm.batch_id JOIN wv ON ret.batch_id = wv.batch_id),
pt AS (SELECT *, greatest(-aw * exp((new - actor) * ms), -aw * greatest({1 - CLIP}, least({1 + CLIP}, exp((new - actor) * ms)))) AS term,
              greatest(v - {CLIP}, least(v + {CLIP}, new_value)) AS clipped FROM w),
b AS (SELECT batch_id,
             sum(pen * ms) / (sum(ms) + 1e-8) AS kl_penalty_mean,
             sum(aw * ms) / (sum(ms) + 1e-8) AS advantages_mean,
             sum(r * ms) / (sum(ms) + 1e-8) AS returns_mean,
             sum(term * ms) / (sum(ms) + 1e-8) AS actor_loss,
             0.5 * sum(greatest((new_value - r) * (new_value - r), (clipped - r) * (clipped - r)) * ms) / (sum(ms) + 1e-8) AS critic_loss
      FROM pt GROUP BY batch_id),
u AS (SELECT CAST(ceil((batch_id + 1) / 2.0) AS BIGINT) AS update, """
    + ", ".join(f"avg({m}) AS {m}" for m in _PPO_LOG_METRICS)
    + """ FROM b GROUP BY 1 HAVING count(*) = 2)
SELECT update, """
    + ", ".join(f"{Q.rnd(m)} AS {m}" for m in _PPO_LOG_METRICS)
    + " FROM u",
)
def ppo_log_end_to_end(spark: SparkSession, base: str) -> DataFrame:
    # Experience (whitened advantages) -> per-mini-batch metrics and losses in one aggregation ->
    # step metrics averaged over accumulation windows of two steps (one rank).
    exp = _experience(spark, base, norm=True)
    per_batch = exp.groupBy("batch_id").agg(
        M.masked_mean_agg("kl_penalty", "ms").alias("kl_penalty_mean"),
        M.masked_mean_agg("advantages", "ms").alias("advantages_mean"),
        M.masked_mean_agg("returns", "ms").alias("returns_mean"),
        OB.actor_loss_agg("advantages", "new_logp", "actor_logp", "ms", CLIP).alias("actor_loss"),
        OB.critic_loss_agg("critic_values", "new_values", "returns", "ms", CLIP).alias("critic_loss"),
    )
    log = per_batch.select((F.col("batch_id") + 1).alias("step"), F.lit(0).alias("rank"), *_PPO_LOG_METRICS)
    s = M.step_metrics(log, 2, _PPO_LOG_METRICS)
    return s.select("update", *[_r(F.col(m)).alias(m) for m in _PPO_LOG_METRICS])


# ---------------------------------------------------------------------------------------------
# Pairs of logit sequences: all ten DPO outputs and the evaluation metrics of both pair objectives
# ---------------------------------------------------------------------------------------------

LOGIT_BATCH = 8  # sequences: four pairs


def _logit_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Even logit sequences as accepted, odd ones as rejected; the reference model has half the logits."""
    s = _logit_sequences(spark, base)
    shifted = F.slice(F.col("ids"), 2, F.greatest(F.size("ids") - 1, F.lit(0)))
    s = s.withColumn("mask", F.transform(shifted, lambda y: F.when(y > 0, 1).otherwise(0)))
    s = s.withColumn("ref_logits", F.transform("logits", lambda row: F.transform(row, lambda v: v * 0.5)))
    for name in ("", "ref_"):
        logp = R.token_logprobs(F.col(f"{name}logits"), F.col("ids"))
        s = s.withColumn(f"{name}logps", O.sequence_logps_by_mask(logp, F.col("mask")))
    fields = F.struct("logits", "ref_logits", "mask", "logps", "ref_logps")
    even = F.max_by(F.when(F.pmod("seq", F.lit(2)) == 0, fields), F.pmod("seq", F.lit(2)) == 0)
    odd = F.max_by(F.when(F.pmod("seq", F.lit(2)) == 1, fields), F.pmod("seq", F.lit(2)) == 1)
    both = s.groupBy(F.floor(F.col("seq") / LOGIT_BATCH).cast("long").alias("batch_id"), F.floor(F.col("seq") / 2).cast("long").alias("pair"))
    both = both.agg(even.alias("a"), odd.alias("r")).filter(F.col("a").isNotNull() & F.col("r").isNotNull())
    out = [F.col(f"{x}.{p}{c}").alias(f"{p}{side}_{c}") for x, side in (("a", "accepts"), ("r", "rejects")) for p in ("", "ref_") for c in ("logits", "logps")]
    masks = [F.col(f"{x}.mask").alias(f"{p}{side}_mask") for x, side in (("a", "accepts"), ("r", "rejects")) for p in ("", "ref_")]
    return both.select("batch_id", F.col("pair").alias("example_id"), *out, *masks)


_LOGIT_PAIRS = f"""WITH {_LOGITS},
ur AS (SELECT seq, pos, y, k, v * 0.5 AS v FROM u),
mr AS (SELECT seq, pos, max(v) AS mx FROM ur GROUP BY seq, pos),
lr AS (SELECT ur.seq, ur.pos, mr.mx + ln(sum(exp(ur.v - mr.mx))) AS lse FROM ur JOIN mr ON ur.seq = mr.seq AND ur.pos = mr.pos GROUP BY ur.seq, ur.pos, mr.mx),
hr AS (SELECT ur.seq, ur.pos, ur.y, max(CASE WHEN ur.k = ur.y THEN ur.v END) - lr.lse AS logp, -sum(exp(ur.v - lr.lse) * (ur.v - lr.lse)) AS ent
       FROM ur JOIN lr ON ur.seq = lr.seq AND ur.pos = lr.pos GROUP BY ur.seq, ur.pos, ur.y, lr.lse),
sp AS (SELECT h.seq, sum(CASE WHEN h.y > 0 THEN h.logp ELSE 0 END) AS lp, sum(CASE WHEN h.y > 0 THEN hr.logp ELSE 0 END) AS rlp,
              sum(CASE WHEN h.y > 0 THEN h.ent ELSE 0 END) AS e, sum(CASE WHEN h.y > 0 THEN hr.ent ELSE 0 END) AS re,
              sum(CASE WHEN h.y > 0 THEN 1 ELSE 0 END) AS n
       FROM h JOIN hr ON h.seq = hr.seq AND h.pos = hr.pos GROUP BY h.seq),
ep AS (SELECT a.seq // 2 AS example_id, a.seq // {LOGIT_BATCH} AS batch_id, a.lp AS alp, r.lp AS rlp, a.rlp AS ra, r.rlp AS rr,
              a.e AS ae, r.e AS re, a.re AS rae, r.re AS rre, a.n AS an, r.n AS rn
       FROM sp a JOIN sp r ON r.seq = a.seq + 1 WHERE a.seq % 2 = 0),
en AS (SELECT batch_id, sum(ae) / (sum(an) + 1e-8) AS accepts_entropy, sum(re) / (sum(rn) + 1e-8) AS rejects_entropy,
              sum(rae) / (sum(an) + 1e-8) AS ref_accepts_entropy, sum(rre) / (sum(rn) + 1e-8) AS ref_rejects_entropy FROM ep GROUP BY batch_id),
o AS (SELECT example_id, ep.batch_id, {DPO_BETA} * (alp - ra) AS accepts_reward, {DPO_BETA} * (rlp - rr) AS rejects_reward,
             {DPO_BETA} * (alp - rlp) AS pi_ratio, {DPO_BETA} * (ra - rr) AS ref_ratio, accepts_entropy, rejects_entropy,
             ref_accepts_entropy, ref_rejects_entropy, -alp AS accepts_ce_loss, -rlp AS rejects_ce_loss
      FROM ep JOIN en ON ep.batch_id = en.batch_id)"""
_DPO_OUTPUTS = ["accepts_reward", "rejects_reward", "pi_ratio", "ref_ratio", "accepts_entropy", "rejects_entropy",
                "ref_accepts_entropy", "ref_rejects_entropy", "accepts_ce_loss", "rejects_ce_loss"]


@register("dpo_outputs", f"{_LOGIT_PAIRS} SELECT example_id, batch_id, " + ", ".join(f"{Q.rnd(c)} AS {c}" for c in _DPO_OUTPUTS) + " FROM o")
def dpo_outputs_q(spark: SparkSession, base: str) -> DataFrame:
    o = OB.dpo_outputs(_logit_pairs(spark, base), PairConfig(dpo_beta=DPO_BETA))
    return o.select("example_id", "batch_id", *[_r(F.col(c)).alias(c) for c in _DPO_OUTPUTS])


@register("dpo_eval_all_outputs", f"{_LOGIT_PAIRS} SELECT " + ", ".join(f"{Q.rnd(f'avg({c})')} AS eval_{c}" for c in _DPO_OUTPUTS) + " FROM o")
def dpo_eval_all_outputs(spark: SparkSession, base: str) -> DataFrame:
    o = OB.dpo_outputs(_logit_pairs(spark, base), PairConfig(dpo_beta=DPO_BETA))
    m = M.pair_eval_metrics(o, _DPO_OUTPUTS, "batch_id")
    return m.select(*[_r(F.col(f"eval_{c}")).alias(f"eval_{c}") for c in _DPO_OUTPUTS])


_RM_EVAL = ["accepts_end_token_value", "rejects_end_token_value"]


def _rm_eval(compat: bool):
    def q(spark: SparkSession, base: str) -> DataFrame:
        rm = _rm(spark, base).withColumnsRenamed({"accepts_end_value": _RM_EVAL[0], "rejects_end_value": _RM_EVAL[1]})
        rm = rm.withColumn("accuracy", O.pair_correct(F.col(_RM_EVAL[0]), F.col(_RM_EVAL[1])))
        m = M.pair_eval_metrics(rm, [*_RM_EVAL, "accuracy"], "batch_id", compat=compat)
        return m.select(*[_r(F.col(f"eval_{c}")).alias(f"eval_{c}") for c in (*_RM_EVAL, "accuracy")])

    return q


for _name, _where in (("rm_eval_metrics", ""), ("rm_eval_metrics_compat", " WHERE batch_id = (SELECT max(batch_id) FROM ends)")):
    register(
        _name,
        f"""{_RM_BASE} SELECT {Q.rnd('avg(ae)')} AS eval_accepts_end_token_value, {Q.rnd('avg(re)')} AS eval_rejects_end_token_value,
       {Q.rnd('avg(CASE WHEN ae >= re THEN 1.0 ELSE 0.0 END)')} AS eval_accuracy FROM ends{_where}""",
    )(_rm_eval(bool(_where)))


# ---------------------------------------------------------------------------------------------
# The whole step log: learning rate, losses, means and variances, averaged over accumulation windows
# ---------------------------------------------------------------------------------------------

ENTROPY_BETA = 0.01
_LOSS_TERMS = {"actor": "term", "entropy": "-actor * exp(actor)", "critic": "sqe", "extra": "-actor"}
_LOG_ARRAYS = {"kl_penalty": "pen", "rewards_kl": "rkl", "advantages": "aw", "ratio": "ratio", "returns": "r",
               "values_error": "(new_value - r) * (new_value - r)"}
_LOG_LENGTHS = ("prompts_length", "responses_length")
_LOG_COLS = (
    ["lr", "loss_actor", "loss_entropy", "loss_critic", "loss_extra", "loss_total"]
    + [f"{c}_{x}" for c in (*_LOG_ARRAYS, "reward_score", *_LOG_LENGTHS) for x in ("mean", "var")]
    + ["actor_perplexity", "ref_perplexity"]
)


def _step_log_sql() -> str:
    xs = {f"l_{c}": e for c, e in _LOSS_TERMS.items()} | {f"x_{c}": e for c, e in _LOG_ARRAYS.items()}
    means = ", ".join(f"sum({c} * ms) / (sum(ms) + 1e-8) AS m{c}" for c in xs)
    vars_ = ", ".join(f"sum(ms * (x_{c} - mx_{c}) * (x_{c} - mx_{c})) / (sum(ms) + 1e-8) AS {c}_var" for c in _LOG_ARRAYS)
    total = f"ml_actor + {ENTROPY_BETA} * ml_entropy + 0.5 * ml_critic + {_EXTRA_W_SQL} * ml_extra"
    return f"""{_GAE},
wm AS (SELECT batch_id, sum(a * ms) / sum(ms) AS mean FROM ret GROUP BY batch_id),
wv AS (SELECT ret.batch_id, sum(ms * (a - wm.mean) * (a - wm.mean)) / sum(ms) AS var FROM ret JOIN wm ON ret.batch_id = wm.batch_id GROUP BY ret.batch_id),
w0 AS (SELECT ret.*, (ret.a - wm.mean) / sqrt(wv.var + 1e-6) AS aw, exp((new - actor) * ms) AS ratio, greatest(v - {CLIP}, least(v + {CLIP}, new_value)) AS clipped
       FROM ret JOIN wm ON ret.batch_id = wm.batch_id JOIN wv ON ret.batch_id = wv.batch_id),
w AS (SELECT *, greatest(-aw * ratio, -aw * greatest({1 - CLIP}, least({1 + CLIP}, ratio))) AS term,
             greatest((new_value - r) * (new_value - r), (clipped - r) * (clipped - r)) AS sqe FROM w0),
xs AS (SELECT batch_id, ms, {", ".join(f"{e} AS {c}" for c, e in xs.items())} FROM w),
mm AS (SELECT batch_id, {means} FROM xs GROUP BY batch_id),
vv AS (SELECT xs.batch_id, {vars_} FROM xs JOIN mm ON xs.batch_id = mm.batch_id GROUP BY xs.batch_id),
sq AS (SELECT seq, any_value(batch_id) AS batch_id, any_value(reward) AS reward, any_value(T) - 8 AS rl,
              -sum(actor) / (count(*) + 1e-8) AS actor_ce, -sum(ref) / (count(*) + 1e-8) AS ref_ce FROM tok GROUP BY seq),
sc AS (SELECT batch_id, avg(reward) AS reward_score_mean, var_samp(reward) AS reward_score_var, exp(avg(actor_ce)) AS actor_perplexity, exp(avg(ref_ce)) AS ref_perplexity,
              8.0 AS prompts_length_mean, CASE WHEN count(*) > 1 THEN 0.0 END AS prompts_length_var, avg(rl) AS responses_length_mean, var_samp(rl) AS responses_length_var FROM sq GROUP BY batch_id),
b AS (SELECT mm.batch_id, 0.001 / (mm.batch_id + 1) AS lr, ml_actor AS loss_actor, ml_entropy AS loss_entropy, 0.5 * ml_critic AS loss_critic, ml_extra AS loss_extra,
             {total.replace('batch_id', 'mm.batch_id')} AS loss_total, {", ".join(f"mx_{c} AS {c}_mean, {c}_var" for c in _LOG_ARRAYS)}, sc.* EXCLUDE (batch_id)
      FROM mm JOIN vv ON mm.batch_id = vv.batch_id JOIN sc ON mm.batch_id = sc.batch_id),
u AS (SELECT CAST(ceil((batch_id + 1) / 2.0) AS BIGINT) AS update, {", ".join(f"avg({c}) AS {c}" for c in _LOG_COLS)} FROM b GROUP BY 1 HAVING count(*) = 2)
SELECT update, {", ".join(f"{Q.rnd(c)} AS {c}" for c in _LOG_COLS)} FROM u"""


@register("ppo_step_log", _step_log_sql())
def ppo_step_log(spark: SparkSession, base: str) -> DataFrame:
    """Losses are masked means of their terms, so one pass over the tokens gives the whole log of a batch."""
    ratio = R.policy_ratio(F.col("new_logp"), F.col("actor_logp"), F.col("ms"))
    exp = _experience(spark, base, norm=True).withColumn("ratio", ratio).withColumns({
        "values_error": O.values_error(F.col("new_values"), F.col("returns")),
        "t_actor": O.actor_terms(F.col("advantages"), F.col("ratio"), CLIP),
        "t_entropy": F.transform("actor_logp", lambda p: -p * F.exp(p)),
        "t_critic": O.critic_terms(F.col("critic_values"), F.col("new_values"), F.col("returns"), CLIP),
        "t_extra": F.transform("actor_logp", lambda p: -p),
        "lr": F.lit(0.001) / (F.col("batch_id") + 1),
        "prompts_length": F.lit(V.PROMPT_POSITIONS),
        "responses_length": F.size("sequence_mask") - V.PROMPT_POSITIONS,
    })
    terms = [f"t_{c}" for c in _LOSS_TERMS]
    m = M.rollout_metrics(exp, ["batch_id"], "ms", [*terms, *_LOG_ARRAYS], scalar_cols=["lr"], length_cols=_LOG_LENGTHS)
    m = m.withColumnsRenamed({f"t_{c}_mean": f"loss_{c}" for c in _LOSS_TERMS}).withColumn("loss_critic", F.col("loss_critic") * 0.5)
    w = O.extra_loss_weight(F.col("batch_id") + 1, EXTRA_W, EXTRA_RATIO, MAX_STEPS)
    total = O.ppo_total_loss(F.col("loss_actor"), F.col("loss_entropy"), F.col("loss_critic"), F.col("loss_extra"), w, entropy_beta=ENTROPY_BETA)
    log = m.withColumn("loss_total", total).withColumn("step", F.col("batch_id") + 1).withColumn("rank", F.lit(0))
    s = M.step_metrics(log, 2, _LOG_COLS)
    return s.select("update", *[_r(F.col(c)).alias(c) for c in _LOG_COLS])


# ---------------------------------------------------------------------------------------------
# Rows that only other tests had: weights past the warm-up, normalised advantages, step limits
# ---------------------------------------------------------------------------------------------

_SHORT_STEPS = 10


@register(
    "extra_weight_after_warmup",
    f"""{_TOK} SELECT DISTINCT seq + 1 AS step, {Q.rnd(f"CASE WHEN seq + 1 < 2 THEN (seq + 1) / 2.0 * {EXTRA_W} ELSE pow({EXTRA_W}, 1.001) END")} AS weight FROM ev""",
)
def extra_weight_after_warmup(spark: SparkSession, base: str) -> DataFrame:
    steps = _rollout(spark, base).select((F.col("seq") + 1).alias("step"))
    return steps.select("step", _r(O.extra_loss_weight(F.col("step"), EXTRA_W, EXTRA_RATIO, _SHORT_STEPS)).alias("weight"))


@register("normalise_advantages", _whiten_sql(False))
def normalise_advantages_q(spark: SparkSession, base: str) -> DataFrame:
    exp = normalise_advantages(_experience(spark, base))
    return _long(exp, ["advantages"], {"advantages": "advantage"})
