import math

import pytest
from pyspark.sql import functions as F

from conftest import approx_list
from preftable.config import PairConfig, RolloutConfig
from preftable.functions import objectives as O
from preftable.functions import rollout as R
from preftable.operators import objectives as OB
from preftable.operators.batching import update_schedule
from preftable.operators.rollout import build_experience
from test_rollout import G4, SCHEMA


def test_g5_ppo_losses(spark):
    df = spark.createDataFrame(G4, SCHEMA)
    exp = build_experience(df, RolloutConfig(kl_penalty_beta=0.1, kl_penalty_method="abs"))
    diffs = {0: [0.1, 0.3, -0.4, 0.05], 1: [-0.2, 0.5, 0.0, 0.0]}
    vdiffs = {0: [0.1, 0.5, -0.3, 0.1], 1: [-0.4, 0.1, 0.0, 0.0]}
    d = spark.createDataFrame([(k, diffs[k], vdiffs[k]) for k in diffs], "seq long, d array<double>, vd array<double>")
    exp = exp.join(d, "seq").withColumn("new_logp", F.zip_with("actor_logp", "d", lambda a, b: a + b))
    exp = exp.withColumn("new_values", F.zip_with("critic_values", "vd", lambda a, b: a + b))
    exp = exp.withColumn("mask", R.shifted(F.col("response_mask")))
    ratio = {r.seq: r.ratio for r in exp.select("seq", R.policy_ratio(F.col("new_logp"), F.col("actor_logp"), F.col("mask")).alias("ratio")).collect()}
    approx_list(ratio[0], [1, 1.349859, 0.67032, 1.051271])
    approx_list(ratio[1], [0.818731, 1.648721, 1, 1])
    assert OB.ppo_actor_loss(exp).first().actor_loss == pytest.approx(-0.893981, abs=1e-6)
    c = OB.ppo_critic_loss(exp).first()
    assert c.critic_loss == pytest.approx(1.538153, abs=1e-6)
    assert c.values_error_mean == pytest.approx(2.808746, abs=1e-6)
    comp = build_experience(df, RolloutConfig(kl_penalty_beta=0.1, kl_penalty_method="abs", use_advantage_norm=True, compat=True))
    comp = comp.join(d, "seq").withColumn("new_logp", F.zip_with("actor_logp", "d", lambda a, b: a + b)).withColumn("mask", R.shifted(F.col("response_mask")))
    assert OB.ppo_actor_loss(comp).first().actor_loss == pytest.approx(0.381311, abs=1e-6)


@pytest.mark.parametrize(
    "beta,rows,loss,free",
    [(1.0, [0.513015, 1.037488, 0.693147], 0.747883, 0.660162), (0.1, [0.673347, 0.723597, 0.693147], 0.696697, 0.685334)],
)
def test_g6_dpo(spark, beta, rows, loss, free):
    df = spark.createDataFrame(
        [(0, -4.0, -5.0, -4.2, -4.8), (0, -6.5, -6.0, -6.1, -6.2), (0, -3.0, -3.0, -2.5, -2.5)],
        "batch_id long, accepts_logps double, rejects_logps double, ref_accepts_logps double, ref_rejects_logps double",
    )
    out = OB.dpo_outputs(df, PairConfig(dpo_beta=beta)).collect()
    approx_list([r.dpo_loss_row for r in out], rows)
    b = OB.dpo_loss(df, cfg=PairConfig(dpo_beta=beta)).first()
    assert b.dpo_loss == pytest.approx(loss, abs=1e-6)
    assert b.accuracy == pytest.approx(2 / 3)
    f = OB.dpo_loss(df, cfg=PairConfig(dpo_beta=beta, reference_free=True)).first()
    assert f.dpo_loss == pytest.approx(free, abs=1e-6)


def test_g6_rm(spark):
    lab = lambda m: [5 if x else -100 for x in m]
    rows = [
        (0, [0.2, 0.5, 1.0, 0.3], lab([0, 1, 1, 0]), [5, 5, 5, 0], [0.2, 0.1, 0.3, 0.8], lab([0, 1, 1, 1]), [5, 5, 5, 5]),
        (0, [0.1, 0.4, -0.2, 0.9], lab([0, 1, 1, 1]), [5, 5, 5, 5], [0.1, 0.2, 0.6, -0.1], lab([0, 1, 1, 0]), [5, 5, 5, 0]),
    ]
    df = spark.createDataFrame(rows, "batch_id long, av array<double>, al array<int>, ai array<int>, rv array<double>, rl array<int>, ri array<int>")
    df = df.withColumn("accepts_values", O.rm_mask_values(F.col("av"), F.col("al"))).withColumn(
        "rejects_values", O.rm_mask_values(F.col("rv"), F.col("rl"))
    )
    df = df.withColumn("accepts_end_value", O.rm_end_value(F.col("accepts_values"), F.col("ai"), 0)).withColumn(
        "rejects_end_value", O.rm_end_value(F.col("rejects_values"), F.col("ri"), 0)
    )
    ends = [(r.accepts_end_value, r.rejects_end_value) for r in df.collect()]
    assert ends == [(1.0, 0.8), (0.9, 0.6)]
    last = OB.rm_pairwise_loss(df, use_last_reward=True).first().rm_loss
    assert last == pytest.approx(0.576247, abs=1e-6)
    assert OB.rm_pairwise_loss(df).first().rm_loss == pytest.approx(0.697999, abs=1e-6)
    assert last + 1.0 * 2.25 == pytest.approx(2.826247, abs=1e-6)


def test_g6_logits(spark):
    df = spark.createDataFrame(
        [([2.0, 1.0, 0.0, -1.0], 0, 1), ([0.0, 0.0, 0.0, 0.0], 3, 0), ([1.0, 3.0, 1.0, 0.0], 1, 1)],
        "x array<double>, y int, m int",
    )
    out = df.select(R.log_softmax_at(F.col("x"), F.col("y")).alias("lp"), R.entropy(F.col("x")).alias("h"), "m").collect()
    approx_list([r.lp for r in out], [-0.44019, -1.386294, -0.277978])
    approx_list([r.h for r in out], [0.947537, 1.386294, 0.801056])
    mm = df.agg((F.sum(R.entropy(F.col("x")) * F.col("m")) / (F.sum("m") + 1e-8)).alias("e")).first().e
    assert mm == pytest.approx(0.874297, abs=1e-6)
    seq = spark.createDataFrame([([[2.0, 1.0, 0.0], [0.0, 0.0, 0.0], [9.0, 9.0, 9.0]], [1, 0, 2])], "l array<array<double>>, ids array<int>")
    lps = seq.select(R.token_logprobs(F.col("l"), F.col("ids"))).first()[0]
    assert len(lps) == 2 and lps[1] == pytest.approx(-1.0986123, abs=1e-6)


def test_g7_extra_weight(spark):
    df = spark.createDataFrame([(s,) for s in (1, 5, 19, 20, 50)], "step long")
    w = [r.w for r in df.select(O.extra_loss_weight(F.col("step"), 0.2, 0.2, 100).alias("w")).collect()]
    approx_list(w, [0.01, 0.05, 0.19, 0.199678, 0.199678], 1e-6)
    assert df.select(O.extra_loss_weight(F.col("step"), 0.2, None, 100).alias("w")).first().w == pytest.approx(0.2)


@pytest.mark.parametrize(
    "args,per_epoch,total",
    [((100, 4, 1, 1, 8, 1, -1), 50, 50), ((3, 1, 1, 1, 8, 2, -1), 1, 2), ((100, 4, 1, 2, 8, 1.5, -1), 100, 150), ((100, 1, 1, 1, 8, 1, 50), 12.5, 50)],
)
def test_g7_schedule(spark, args, per_epoch, total):
    nb, bs, mini, ep, acc, epochs, mx = args
    df = spark.range(nb).withColumnRenamed("id", "batch_id")
    r = update_schedule(df, "batch_id", bs, mini, ep, acc, epochs, mx).first()
    assert r.updates_per_epoch == pytest.approx(per_epoch) and r.total_updates == total
    assert r.micro_steps == total * acc


def test_clm_perplexity_overflow(spark):
    df = spark.createDataFrame([([-1000.0, -1000.0],)], "lp array<double>")
    r = OB.clm_loss(df, "lp").first()
    assert r.clm_loss == pytest.approx(1000.0) and r.perplexity == float("inf")


def test_dpo_entropies_weigh_tokens_of_the_batch(spark):
    flat, sharp = [0.0, 0.0], [3.0, -3.0]
    rows = [(0, [flat] * 5, [1, 1, 1, 1]), (0, [sharp] * 2, [1]), (0, [flat] * 3, [0, 0]), (1, [sharp] * 3, [0, 1]), (2, [sharp] * 2, [0])]
    df = spark.createDataFrame([(b, -1.0, -2.0, -1.0, -2.0, x, m) for b, x, m in rows],
        "batch_id long, accepts_logps double, rejects_logps double, ref_accepts_logps double, ref_rejects_logps double, "
        "ref_rejects_logits array<array<double>>, ref_rejects_mask array<int>").repartition(3)  # fmt: skip
    p = 1 / (1 + math.exp(-6))
    low = -(p * math.log(p) + (1 - p) * math.log(1 - p))
    out = OB.dpo_outputs(df)
    assert len(out.columns) == len(df.columns) + 8
    for r in out.collect():
        assert r.ref_rejects_entropy == pytest.approx([(4 * math.log(2) + low) / 5, low, 0.0][r.batch_id], abs=1e-6)


def test_dpo_entropies_and_empty_response(spark):
    df = spark.createDataFrame(
        [(0, -1.0, -2.0, -1.0, -2.0, [[2.0, 1.0, 0.0, -1.0], [0.0, 0.0, 0.0, 0.0], [9.0, 9.0, 9.0, 9.0]], [1, 1])],
        "batch_id long, accepts_logps double, rejects_logps double, ref_accepts_logps double, ref_rejects_logps double, "
        "accepts_logits array<array<double>>, accepts_mask array<int>",
    )
    r = OB.dpo_outputs(df).first()
    assert r.accepts_entropy == pytest.approx((0.947537 + 1.386294) / 2, abs=1e-6)
    g = spark.createDataFrame([(0, 0, [1, 1, 1], [1, 0, 0], [-1.0, -1.0], [-1.0, -1.0], [0.5, 0.5, 0.5], [0.0, 0.0, 0.0])], SCHEMA)
    e = build_experience(g, RolloutConfig(kl_penalty_method="abs")).first()
    assert e.quarantine_reason == "empty response"
    z = spark.createDataFrame([(0, 0, [1, 1, 1], [0, 0, 0], [-1.0, -1.0], [-1.0, -1.0], [0.5, 0.5, 0.5], [0.0, 0.0, 0.0])], SCHEMA)
    e = build_experience(z, RolloutConfig(kl_penalty_method="abs"), reward_col=None).first()
    assert e.reward_score is None and e.quarantine_reason == "empty response"


def test_survey_named_helpers(spark):
    from preftable.operators.objectives import token_entropy
    from preftable.operators.rollout import normalise_advantages
    from preftable.operators.sequences import build_pair_sequence, build_ppo_prompt

    df = spark.createDataFrame(
        [(0, [[2.0, 1.0, 0.0, -1.0], [0.0, 0.0, 0.0, 0.0], [1.0, 3.0, 1.0, 0.0], [5.0, 5.0, 5.0, 5.0]], [1, 0, 1])],
        "batch_id long, l array<array<double>>, m array<int>",
    )
    assert token_entropy(df, "l", "m").first().entropy == pytest.approx(0.874297, abs=1e-6)
    g4 = spark.createDataFrame(G4, SCHEMA)
    exp = build_experience(g4, RolloutConfig(kl_penalty_beta=0.1, kl_penalty_method="abs"))
    w = {r.seq: r.advantages for r in normalise_advantages(exp).collect()}
    approx_list(w[0], [0.782646, 0.716014, 0.730806, 0.972862])
    p = spark.createDataFrame([(0, [11], [21, 22], [31])], "example_id long, prompt_ids array<int>, chosen_ids array<int>, rejected_ids array<int>")
    assert build_pair_sequence(p).first().rejects_ids == [11, 1, 31, 2]
    assert build_ppo_prompt(p.withColumnRenamed("chosen_ids", "response_ids")).first().input_ids == [11, 1]
    one = spark.createDataFrame([(2.0, 0.5)], "pw double, clm double")
    r = one.select(O.rm_total_loss(F.col("pw"), F.col("clm"), 1.0).alias("t"), O.perplexity(F.lit(1000.0)).alias("p")).first()
    assert r.t == pytest.approx(2.5) and r.p == float("inf")
