import math

import pytest
from pyspark.sql import functions as F

from conftest import approx_list
from preftable.config import RolloutConfig
from preftable.functions import rollout as R
from preftable.operators.metrics import rollout_metrics
from preftable.operators.rollout import build_experience, gae_long, masked_whiten, strip_and_join

G4 = [
    (
        0, 0, [1, 1, 1, 1, 1], [0, 0, 1, 1, 1],
        [-0.5, -1.2, -0.3, -0.8], [-0.6, -1.0, -0.7, -0.8],
        [0.1, 0.2, 0.3, 0.4, 2.5], [0.1, 0.2, 0.3, 0.1, 9.0],
    ),
    (
        0, 1, [1, 1, 1, 0, 0], [0, 1, 1, 0, 0],
        [-0.9, -0.4, -2.0, -2.0], [-1.1, -0.9, -1.0, -1.0],
        [0.5, 0.6, -0.7, 9.0, 9.0], [0.4, -0.2, 0.7, 0.7, 0.7],
    ),
]
SCHEMA = (
    "batch_id long, seq long, sequence_mask array<int>, response_mask array<int>, actor_logp array<double>, "
    "ref_logp array<double>, ref_values array<double>, critic_values array<double>"
)


@pytest.fixture()
def g4(spark):
    return spark.createDataFrame(G4, SCHEMA)


def _exp(df, **kw):
    cfg = RolloutConfig(kl_penalty_beta=0.1, gamma=1.0, lam=0.95, **kw)
    return {r.seq: r for r in build_experience(df, cfg).collect()}


def test_g4_default(g4):
    e = _exp(g4, kl_penalty_method="abs")
    assert e[0].reward_score == pytest.approx(2.5) and e[1].reward_score == pytest.approx(-0.7)
    approx_list(e[0].kl_penalty, [-0.01, -0.02, -0.04, 0.0])
    approx_list(e[1].kl_penalty, [-0.02, -0.05, -0.1, -0.1])
    approx_list(e[0].critic_values, [0, 0.2, 0.3, 0.1])
    approx_list(e[1].critic_values, [0.4, -0.2, 0, 0])
    approx_list(e[0].rewards_kl, [0, -0.02, -0.04, 2.5])
    approx_list(e[1].rewards_kl, [-0.02, -0.75, 0, 0])
    approx_list(e[0].advantages, [2.1171, 2.018, 2.04, 2.4])
    approx_list(e[1].advantages, [-1.1425, -0.55, 0, 0])
    approx_list(e[0].returns, [2.1171, 2.218, 2.34, 2.5])
    approx_list(e[1].returns, [-0.7425, -0.75, 0, 0])
    assert e[0].actor_ce == pytest.approx(0.7) and e[1].actor_ce == pytest.approx(0.65)


def test_g4_penalty_methods_and_clip(g4):
    mse = _exp(g4, kl_penalty_method="mse")
    approx_list(mse[0].kl_penalty, [-0.0005, -0.002, -0.008, 0], 1e-9)
    approx_list(mse[1].kl_penalty, [-0.002, -0.0125, -0.05, -0.05], 1e-9)
    raw = _exp(g4)
    approx_list(raw[0].kl_penalty, [-0.01, 0.02, -0.04, 0])
    approx_list(raw[1].kl_penalty, [-0.02, -0.05, 0.1, 0.1])
    clipped = _exp(g4, kl_penalty_method="abs", reward_score_clip=2.0)
    assert clipped[0].reward_score == pytest.approx(2.0) and clipped[1].reward_score == pytest.approx(-0.7)


def test_g4_whitening_modes(g4):
    w = _exp(g4, kl_penalty_method="abs", use_advantage_norm=True)
    approx_list(w[0].advantages, [0.782646, 0.716014, 0.730806, 0.972862])
    approx_list(w[1].advantages, [-1.409032, -1.010649, -0.640842, -0.640842])
    c = _exp(g4, kl_penalty_method="abs", use_advantage_norm=True, compat=True)
    approx_list(c[0].advantages, [0.478918, 0.414832, 0.429059, 0.661864])
    approx_list(c[1].advantages, [-1.628999, -1.245841, -0.890167, -0.890167])
    # returns stay unwhitened
    approx_list(w[0].returns, [2.1171, 2.218, 2.34, 2.5])


def test_g4_metrics_both_modes(spark, g4):
    for compat, mean, var in ((False, -0.026, 0.000304), (True, 0.334, 1.251424)):
        cfg = RolloutConfig(kl_penalty_beta=0.1, kl_penalty_method="abs", compat=compat)
        exp = build_experience(g4, cfg).withColumn("mask", R.shifted(F.col("response_mask")))
        m = rollout_metrics(exp, ["batch_id"], array_cols=["kl_penalty"]).first()
        assert m.kl_penalty_mean == pytest.approx(mean, abs=1e-6)
        assert m.kl_penalty_var == pytest.approx(var, abs=1e-6)
        assert m.reward_score_mean == pytest.approx(0.9) and m.reward_score_var == pytest.approx(5.12)
        assert m.actor_perplexity == pytest.approx(1.964033, abs=1e-6)


def test_whiten_properties(spark):
    rows = [(0, i, [float((i * 7 + k) % 5) for k in range(6)], [1, 1, 1, 1, 0, 0]) for i in range(5)]
    df = spark.createDataFrame(rows, "batch_id long, seq long, x array<double>, m array<int>")
    out = masked_whiten(df, "x", "m", "batch_id", "w").collect()
    vals = [v for r in out for v, k in zip(r.w, r.m) if k]
    mean = sum(vals) / len(vals)
    var = sum((v - mean) ** 2 for v in vals) / len(vals)
    assert abs(mean) < 1e-9 and var == pytest.approx(1.0, abs=1e-4)


def test_gae_array_equals_long_form(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for s in range(4):
        n = rnd.randint(1, 40)
        rows.append((s, [rnd.uniform(-1, 1) for _ in range(n)], [rnd.uniform(-1, 1) for _ in range(n)]))
    df = spark.createDataFrame(rows, "seq long, r array<double>, v array<double>")
    for gamma, lam in ((1.0, 0.95), (0.99, 0.0), (1.0, 1.0), (0.5, 0.02)):
        arr = {r.seq: r.a for r in df.select("seq", R.gae(F.col("r"), F.col("v"), gamma, lam).alias("a")).collect()}
        long = df.select("seq", F.posexplode(F.arrays_zip("r", "v")).alias("pos", "z")).select(
            "seq", "pos", F.col("z.r").alias("r"), F.col("z.v").alias("v")
        )
        got = {}
        for r in gae_long(long, "seq", "pos", "r", "v", gamma, lam).collect():
            got.setdefault(r.seq, {})[r.pos] = r.advantage
        for s, a in arr.items():
            approx_list([got[s][i] for i in range(len(a))], a, 1e-9)
            # brute force
            r_, v_ = rows[s][1], rows[s][2]
            ref, nxt = [], 0.0
            for t in reversed(range(len(r_))):
                d = r_[t] + gamma * (v_[t + 1] if t + 1 < len(v_) else 0.0) - v_[t]
                nxt = d + gamma * lam * nxt
                ref.append(nxt)
            approx_list(a, ref[::-1], 1e-9)


def test_gae_long_chunking_matches_recursion(spark):
    # small chunks: 11 chunks with carries between them
    n = 700
    rows = [(0, t, math.sin(t), math.cos(t)) for t in range(n)]
    df = spark.createDataFrame(rows, "seq long, pos long, r double, v double")
    gamma, lam = 0.9, 0.4
    got = {r.pos: r.advantage for r in gae_long(df, "seq", "pos", "r", "v", gamma, lam, chunk=64).collect()}
    nxt, ref = 0.0, [0.0] * n
    for t in reversed(range(n)):
        d = math.sin(t) + gamma * (math.cos(t + 1) if t + 1 < n else 0.0) - math.cos(t)
        nxt = d + gamma * lam * nxt
        ref[t] = nxt
    approx_list([got[t] for t in range(n)], ref, 1e-9)


def test_strip_and_join_and_response_mask(spark):
    df = spark.createDataFrame(
        [(0, 0, [0, 0, 5, 6], [7, 8, 0]), (0, 1, [9, 6], [7, 0, 0])],
        "batch_id long, k long, prompt_ids array<int>, response_ids array<int>",
    )
    out = {r.k: r for r in strip_and_join(df).collect()}
    assert out[0].sequence_ids == [5, 6, 7, 8] and out[1].sequence_ids == [9, 6, 7, 0]
    assert out[1].sequence_mask == [1, 1, 1, 0]
    rm = spark.createDataFrame([([1, 1, 1, 0], 2)], "m array<int>, p int").select(R.response_mask(F.col("m"), F.col("p"))).first()[0]
    assert rm == [0, 0, 1, 0]


def test_last_reward_empty_is_null(spark):
    r = spark.createDataFrame([([1.0, 2.0], [0, 0])], "v array<double>, m array<int>").select(R.last_reward(F.col("v"), F.col("m"))).first()[0]
    assert r is None


def test_gae_long_unit_discount_many_chunks(spark):
    n = 9000  # more than two 4,096-position chunks
    rows = [(0, t, 1.0 if t % 7 == 0 else 0.0, 0.0) for t in range(n)]
    df = spark.createDataFrame(rows, "seq long, pos long, r double, v double")
    got = {r.pos: r.advantage for r in gae_long(df, "seq", "pos", "r", "v", 1.0, 1.0).collect()}
    total, ref = 0.0, [0.0] * n
    for t in reversed(range(n)):
        total += rows[t][2]
        ref[t] = total
    approx_list([got[t] for t in range(n)], ref, 1e-6)


def test_slice_response(spark):
    from preftable.operators.rollout import slice_response

    df = spark.createDataFrame([([0, 5, 6, 7, 8],)], "ids array<int>")
    assert df.select(slice_response("ids", 3)).first()[0] == [7, 8]
    assert df.select(slice_response("ids", 9)).first()[0] == []


def test_zero_mask_batch_does_not_fail_under_ansi(spark):
    from preftable.operators.objectives import clm_loss

    df = spark.createDataFrame([(0, 0, [1.0, 2.0], [0, 0])], "batch_id long, seq long, x array<double>, m array<int>")
    w = masked_whiten(df, "x", "m", "batch_id", "w").first()
    assert w.w == [None, None]
    assert clm_loss(df, "x", mask="m").first().clm_loss is None


def test_empty_arrays_are_safe_under_ansi(spark):
    df = spark.createDataFrame([([], [])], "l array<array<double>>, ids array<int>")
    r = df.select(R.token_logprobs(F.col("l"), F.col("ids")).alias("a"), R.token_entropies(F.col("l")).alias("b")).first()
    assert r.a == [] and r.b == []
