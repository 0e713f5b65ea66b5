"""Linear recurrences: array and table scans against the plain recursion."""

import random

import pytest
from pyspark.sql import functions as F

from preftable.functions import rollout as R
from preftable.functions import scan
from preftable.operators.rollout import gae_long


def backward(xs, c):
    out, y = [], 0.0
    for x in reversed(xs):
        y = x + c * y
        out.append(y)
    return out[::-1]


@pytest.mark.parametrize("c", [0.0, 0.95, 1.0, -0.5])
def test_suffix_scan(spark, c):
    rng = random.Random(1)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(n)]) for k, n in enumerate([0, 1, 31, 32, 33, 64, 1000, 1025, 40_000])]
    got = dict(spark.createDataFrame(rows, "k int, x array<double>").select("k", scan.suffix_scan(F.col("x"), c)).collect())
    for k, xs in rows:
        want = backward(xs, c)
        assert got[k] == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert got[k][-scan.BLOCK :] == want[-scan.BLOCK :]  # nothing follows the last block: the same operations


def test_scan_keeps_the_last_positions_bits(spark):
    rewards, values = [0.0004 * k for k in range(100)], [0.37 * (k % 7) for k in range(100)]
    df = spark.createDataFrame([(rewards, values)], "r array<double>, v array<double>")
    got = df.select(R.gae(F.col("r"), F.col("v"), 1.0, 0.95)).first()[0]
    delta = [r + (values[i + 1] if i < 99 else 0.0) - values[i] for i, r in enumerate(rewards)]
    assert got[-scan.BLOCK :] == backward(delta, 0.95)[-scan.BLOCK :]


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_carries_over_levels(spark, levels):
    rng = random.Random(levels)
    rows = [(s, k, rng.uniform(0.5, 1), rng.uniform(-1, 1)) for s, n in (("x", 1), ("y", 61), (None, 9)) for k in range(n)]
    df = spark.createDataFrame(rows, "s string, k long, a double, b double").filter("s is not null").repartition(3)
    got = {(r.s, r.k): r.y for r in scan.suffix_carries(df, "s", "k", "a", "b", "y", fan=3, levels=levels).collect()}
    y = {}
    for s, k, a, b in reversed([r for r in rows if r[0]]):
        y.setdefault(s, 0.0)
        assert got[s, k] == pytest.approx(y[s], rel=1e-12)
        y[s] = b + a * y[s]
    assert len(got) == 62


@pytest.mark.parametrize("gamma,lam", [(1.0, 0.95), (0.99, 1.0), (0.0, 0.9), (0.9, 0.0)])
def test_long_sequences_of_many_chunks(spark, gamma, lam):
    rng = random.Random(9)
    seqs = {"hot": 700, "one": 1, "short": 16, "edge": 17}
    data = {s: [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(n)] for s, n in seqs.items()}
    rows = [(s, p, r, v) for s, xs in data.items() for p, (r, v) in enumerate(xs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "seq string, pos long, r double, v double")
    got = {(x.seq, x.pos): x.advantage for x in gae_long(df, "seq", "pos", "r", "v", gamma, lam, chunk=16, fan=4, levels=2).collect()}
    for s, xs in data.items():
        delta = [r + gamma * (xs[i + 1][1] if i + 1 < len(xs) else 0.0) - v for i, (r, v) in enumerate(xs)]
        want = backward(delta, gamma * lam)
        assert [got[s, p] for p in range(len(xs))] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_empty_table(spark):
    df = spark.createDataFrame([], "seq long, pos long, r double, v double")
    assert gae_long(df, "seq", "pos", "r", "v").count() == 0


@pytest.mark.parametrize("norm,compat,chunk", [(False, False, 4), (True, False, 1024), (True, True, 7)])
def test_experience_of_positions_equals_arrays(spark, norm, compat, chunk):
    from preftable.config import RolloutConfig
    from preftable.operators.rollout import build_experience
    from preftable.operators.rollout_long import build_experience_long

    rng = random.Random(chunk)
    long, arrays, whole = [], [], []
    for seq, n in enumerate([1, 2, 9, 30, 400]):  # the last one is most of the rows
        own = [1] * n if seq != 3 else [1] * 25 + [0] * 5  # padded at its end
        resp = [0 if i < 3 else own[i] for i in range(n)]
        xs = [[rng.uniform(-2, 0) for _ in range(n)] for _ in range(3)]
        long += [(seq, p, xs[0][p], xs[1][p], xs[2][p], own[p], resp[p]) for p in range(n)]
        arrays.append((seq, seq // 2, own, resp, xs[0][:-1], xs[1][:-1], xs[2], float(seq)))
        whole.append((seq, seq // 2, float(seq)))
    cfg = RolloutConfig(lam=0.9, gamma=0.99, kl_penalty_method="mse", reward_score_clip=2.5, use_advantage_norm=norm, compat=compat)
    rng.shuffle(long)
    df = spark.createDataFrame(long, "seq long, pos long, actor_logp double, ref_logp double, value double, sequence_mask int, response_mask int")
    tokens, per = build_experience_long(df, spark.createDataFrame(whole, "seq long, batch_id long, reward double"), cfg, chunk=chunk, fan=3)
    kinds = "seq long, batch_id long, sequence_mask array<int>, response_mask array<int>, actor_logp array<double>, ref_logp array<double>, critic_values array<double>, reward double"
    want = {r.seq: r for r in build_experience(spark.createDataFrame(arrays, kinds), cfg, reward_col="reward").collect()}
    got = {}
    for r in tokens.collect():
        got[r.seq, r.pos] = r
    assert set(got) == {(s, p) for s, r in want.items() for p in range(len(r.sequence_mask) - 1)}
    for (s, p), r in got.items():
        w = want[s]
        for c in ("kl_penalty", "rewards_kl", "critic_values", "advantages", "returns"):
            if w[c][p] is None or r[c] is None:
                assert w[c][p] is None and r[c] is None
            else:
                assert r[c] == pytest.approx(w[c][p], rel=1e-9, abs=1e-9), (s, p, c)
    for r in per.collect():
        w = want[r.seq]
        assert (r.reward_score, r.quarantine_reason) == (w.reward_score, w.quarantine_reason)
        assert r.actor_ce == pytest.approx(w.actor_ce) and r.ref_ce == pytest.approx(w.ref_ce)
