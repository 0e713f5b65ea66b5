"""Tests of findings on size: encoding, packing, streams and objectives."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from preftable.operators import sequences as S
from preftable.operators.encode import _lookup, build_vocab, encode, encode_long, encode_rows, encode_stream, inline_vocabulary, token_count
from preftable.operators.normalise import split_quarantine, to_sft_text
from preftable.sources.readers import RAW_SCHEMA
from preftable.streaming.streams import stream_prepare


@pytest.mark.parametrize("limit", [1_000, 20])
def test_encode_stream_equals_encode_rows(spark, tmp_path, limit):
    rng = random.Random(limit)
    words = [f"w{i}" for i in range(200)]
    src = tmp_path / "src"
    src.mkdir()
    for part in range(2):
        rows = [{"instruction": " ".join(rng.choices(words + ["unknown"], k=rng.randint(1, 40))), "input": "", "output": [rng.choice(["w1  w2 ", " w3", "w9\nw8"])], "example_id": 1} for _ in range(8)]
        (src / f"p{part}.json").write_text("\n".join(map(json.dumps, rows)) + "\n")
    schema = RAW_SCHEMA + ", example_id BIGINT"
    vocab = build_vocab(spark.createDataFrame([(" ".join(words),)], "text string"))
    limits = {"prompt": 30, "response": 5}

    def encoded(df):
        text, _ = split_quarantine(to_sft_text(df))
        return encode_stream(text, ["prompt", "response"], vocab, ["example_id"], broadcast_limit=limit, max_ids=limits)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    stream_prepare(stream, encoded, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = sorted((r.example_id, list(r.prompt_ids), list(r.response_ids)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    text, _ = split_quarantine(to_sft_text(spark.read.schema(schema).json(str(src))))
    rows = encode_rows(text, ["prompt", "response"], inline_vocabulary(vocab), max_ids=limits).collect()
    assert got == sorted((r.example_id, list(r.prompt_ids), list(r.response_ids)) for r in rows) and len(got) == 16


def test_stream_prepare_does_not_inline_the_vocabulary(spark, tmp_path, monkeypatch):
    from preftable.operators import encode as module
    from preftable.plans import registry

    spark.createDataFrame([(0, "b a a"), (1, "a c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(7, 0, "user", "a b"), (7, 1, "assistant", "c zz a"), (8, 0, "user", "c"), (8, 1, "assistant", "")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(module.inline_vocabulary, "__defaults__", (0,))  # no vocabulary is small enough
    got = registry.queries()["stream_prepare"](spark, str(tmp_path)).collect()
    assert [(r.example_id, r.input_ids.split()[-5:]) for r in got if r.example_id == 700] == [(700, ["1", "5", "0", "3", "2"])]


@pytest.mark.parametrize("heavy", [1, 30, 10_000])
def test_missed_tokens_too_many_to_broadcast(spark, heavy):
    rng = random.Random(heavy)
    texts = [" ".join([f"w{rng.randrange(300)}" for _ in range(20)] + ["unknown"] * 5 + ["w299"] * 3) for _ in range(40)]
    vocab = spark.createDataFrame([(f"w{i}", i + 3) for i in range(300)], "token string, id int")
    rows = spark.createDataFrame([(k, p, t) for k, x in enumerate(texts) for p, t in enumerate(x.split())], "k int, p int, token string")
    looked = _lookup(rows, vocab, 50, heavy_rows=heavy)
    got = {(r.k, r.p): r["__pt_id"] for r in looked.select("k", "p", "token", "__pt_id").collect()}
    want = {(k, p): None if t == "unknown" else int(t[1:]) + 3 for k, x in enumerate(texts) for p, t in enumerate(x.split())}
    assert got == want and looked.count() == len(want)
    assert "explode" not in looked._jdf.queryExecution().optimizedPlan().toString().lower()  # the dictionary isn't copied


def test_encode_folds_numbers(spark):
    df = spark.createDataFrame([(1, "a b", "c"), (1, "b  zz", " a"), (2, None, ""), (None, "c c", None)], "k long, x string, y string")
    vocab = spark.createDataFrame([("a", 2**31 - 1), ("b", -5), ("c", 3)], "token string, id int")
    enc = encode(df, ["x", "y"], vocab, ["k"])
    got = {r.k: (list(r.x_ids), list(r.y_ids)) for r in enc.collect()}
    # Rows of one key are merged place by place.
    assert got == {1: ([-5, 2**31 - 1, -5, 0], [3, 2**31 - 1]), 2: ([], []), None: ([3, 3], [])}
    assert "collect_list(struct" not in enc._jdf.queryExecution().optimizedPlan().toString()


def test_pack_blocks_long_by_known_starts(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(d, d // 4, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(30)))) for d in range(20)], "d long, g long, t string")
    vocab = build_vocab(df, "t")
    lengths = df.select("g", "d", token_count(F.col("t"), with_bos=True).alias("n_ids"))
    plain = encode_long(df, "t", vocab, ["d", "g"], with_bos=True)
    starts = df.join(S.row_starts(lengths, ["g"], "d"), ["g", "d"])
    known = encode_long(starts, "t", vocab, ["d", "g", "__st", "__tot"], with_bos=True)
    for keep_rest in (False, True):
        want = S.pack_blocks_long(plain, ["g"], "d", block_size=7, keep_rest=keep_rest)
        got = S.pack_blocks_long(known, ["g"], "d", block_size=7, keep_rest=keep_rest)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    stored = spark.createDataFrame(known.collect(), known.schema)
    plan = S.pack_blocks_long(stored, ["g"], "d", block_size=7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect_list(struct" not in plan


@pytest.mark.parametrize("name", ["collate_blocks", "collate_blocks_ids"])
def test_blocks_are_numbered_without_labels(spark, tmp_path, monkeypatch, name):
    from preftable.operators import batching
    from preftable.plans import registry

    seen = []
    whole = batching.assign_batches
    monkeypatch.setattr(batching, "assign_batches", lambda df, *a, **k: seen.append(df.columns) or whole(df, *a, **k))
    spark.createDataFrame([(d, "a b c " * 50) for d in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()[name](spark, str(tmp_path)).collect()
    assert len(got) == 9 * 151 // 256 + (name == "collate_blocks_ids") and seen == [["group_id", "block_id", "input_ids"]]


def test_log_sum_exp_is_computed_once(spark):
    from preftable.functions import rollout as R

    df = spark.createDataFrame([([1.0, 2.0, 4.0],)], "x array<double>")
    for f in (R.entropy, lambda x: R.log_softmax_at(x, F.lit(1))):
        assert df.select(f(F.col("x")).alias("v"))._jdf.queryExecution().optimizedPlan().toString().count("array_max") == 1
    got = df.select(R.entropy(F.col("x")).alias("e"), R.log_softmax_at(F.col("x"), F.lit(1)).alias("p")).first()
    p = [v / sum(map(math.exp, [1, 2, 4])) for v in map(math.exp, [1, 2, 4])]
    assert got.e == pytest.approx(-sum(v * math.log(v) for v in p)) and got.p == pytest.approx(math.log(p[1]))
