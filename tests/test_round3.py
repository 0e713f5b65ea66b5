"""Exact splits by radix, manifests, idempotent rollouts, row-wise encoding on streams."""

import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from preftable.config import SequenceConfig, SpecialIds
from preftable.operators import batching as B
from preftable.operators import selection
from preftable.operators.encode import build_vocab, encode, encode_rows, inline_vocabulary
from preftable.operators.normalise import split_quarantine, to_sft_text
from preftable.operators.sequences import build_sft_sequences
from preftable.sources.readers import RAW_SCHEMA
from preftable.sources.sinks import materialise, read_rollouts, write_rollouts
from preftable.streaming.streams import stream_prepare


@pytest.mark.parametrize("n,ratio", [(0, 0.1), (1, 0.1), (7, 0.0), (7, 1.0), (1000, 0.05), (1000, 0.0005), (997, 0.5)])
def test_exact_split(spark, n, ratio):
    df = spark.range(n).withColumnRenamed("id", "k").withColumn("payload", F.lit("x"))
    out = B.train_test_split(df, "k", ratio, seed=3, exact=True)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.k for r in out.filter("split = 'test'").collect()}
    order = [r.k for r in df.withColumn("u", B.hash_unit(F.lit("3"), "k")).orderBy("u", "k").collect()]
    assert got == set(order[: -(-int(n * ratio * 10**6) // 10**6)]) and out.count() == n


def test_selection_with_equal_hashes(spark):
    rows = [(k, (k % 3) << 16 | 5) for k in range(30)] + [(None, 5), (None, 65536 | 5)]
    df = spark.createDataFrame(rows, "k long, h long").repartition(3)
    order = sorted(rows, key=lambda r: (r[1], r[0] is not None, r[0] or 0))
    for n in range(len(rows) + 1):
        got = df.filter(selection.smallest(df, "k", F.col("h"), lambda _: n)).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, order[:n]))


def test_manifest(spark, tmp_path):
    src, path = tmp_path / "in", str(tmp_path / "cache")
    src.mkdir()
    (src / "a.txt").write_text("one\ntwo\n")
    made = []

    def build(limit):
        df = spark.read.text(str(src)).withColumn("cut", F.substring("value", 1, limit)).withColumn("run", F.lit(len(made)))
        made.append(limit)
        return {(r.cut, r.run) for r in materialise(df, path, reuse=True, inputs=[str(src)], options={"limit": limit}).collect()}

    assert build(2) == {("on", 0), ("tw", 0)}
    assert build(2) == {("on", 0), ("tw", 0)}  # unchanged: read
    assert build(1) == {("o", 2), ("t", 2)}  # another option: rebuilt
    (src / "b.txt").write_text("three\n")
    assert build(1) == {("o", 3), ("t", 3)}  # another input file: rebuilt
    for f in glob.glob(path + "/_manifest/part*"):
        os.truncate(f, 0)
    assert build(1) == {("o", 4), ("t", 4)}  # writing was cut off before the manifest
    wider = spark.range(2).withColumn("x", F.lit(1))
    assert materialise(wider, path, reuse=True, inputs=[str(src)], options={"limit": 1}).columns == ["id", "x"]  # another schema


def test_prepared_records_are_reused(spark, tmp_path):
    from preftable.prepare import prepare_sft

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"instruction": f"say w{i}", "output": [f"w{i} w{i}"], "example_id": i}) for i in range(9)))
    vocab = build_vocab(spark.createDataFrame([(" ".join(f"w{i}" for i in range(9)),)], "text string"))
    run = lambda **kw: prepare_sft(spark, vocab, str(src), cfg=SequenceConfig(**kw), cache=str(tmp_path / "cache"))[0]
    stamp = lambda: sorted((f, os.stat(f).st_mtime_ns) for f in glob.glob(str(tmp_path / "cache" / "part*")))
    first = run(max_response_length=8)
    assert first.count() == 9
    before = stamp()
    assert run(max_response_length=8).count() == 9 and stamp() == before
    assert all(len(r.input_ids) < 40 for r in run(max_response_length=2).collect()) and stamp() != before


def test_rollouts_written_twice_are_there_once(spark, tmp_path):
    path = str(tmp_path / "rollouts")
    rows = lambda b, tag: spark.createDataFrame([(b, s, tag, [0.5] * s) for s in range(5)], "buffer_id long, seq long, tag string, a array<double>")
    for b in range(10):
        write_rollouts(rows(b, "first"), path, buckets=4)
    files = len(glob.glob(path + "/bucket=*/*.parquet"))
    write_rollouts(rows(7, "again").unionByName(rows(8, "again")), path, buckets=4)
    got = read_rollouts(spark, path).collect()
    assert len(got) == 50 and len({(r.buffer_id, r.seq) for r in got}) == 50
    assert {(r.buffer_id, r.tag) for r in got} == {(b, "again" if b in (7, 8) else "first") for b in range(10)}
    assert sorted(os.path.basename(d) for d in glob.glob(path + "/bucket=*")) == [f"bucket={k}" for k in range(4)]
    assert files <= 4 * 8 and len(glob.glob(path + "/bucket=*/*.parquet")) <= 4 * 8
    some = read_rollouts(spark, path, [3, 6], buckets=4)
    assert some.count() == 10
    assert "PartitionFilters: [bucket" in some._jdf.queryExecution().executedPlan().toString().replace("(", "").replace("isnotnullbucket", "bucket")
    write_rollouts(rows(1, "new"), path, mode="overwrite", buckets=4)
    assert read_rollouts(spark, path).count() == 5
    # Null buffers are one buffer.
    for _ in range(2):
        write_rollouts(rows(None, "none"), path, buckets=4)
    assert read_rollouts(spark, path).filter("buffer_id is null").count() == 5


def test_encode_rows_equals_encode(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)] + ['q"t', "back\\slash", "é漢", "{}", "a:b", "null"]
    texts = [None, "", " ", " \n lead", "tail ", *(" ".join(rng.choices(words + ["unknown"], k=rng.randint(1, 60))) for _ in range(50))]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(3)
    vocab = build_vocab(spark.createDataFrame([(" ".join(words),)], "text string"))
    lookup = inline_vocabulary(vocab)
    for limit in (None, 7):
        want = {r.k: list(r.t_ids) for r in encode(df, "t", vocab, ["k"], max_ids=limit).collect()}
        got = encode_rows(df, "t", lookup, max_ids=limit)
        assert {r.k: list(r.t_ids) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan.lower() and "Join" not in plan and "Aggregate" not in plan
    with pytest.raises(ValueError):
        inline_vocabulary(vocab, bytes_limit=100)
    empty = inline_vocabulary(vocab.limit(0))
    assert set(encode_rows(df.filter("k = 9"), "t", empty).first().t_ids) == {0}


def test_stream_of_micro_batches_equals_batch(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for part in range(3):
        rows = [{"instruction": f"do w{i}", "input": "", "output": [f"w{part} w{i}"], "example_id": 1} for i in range(6)]  # one id for all
        (src / f"p{part}.json").write_text("\n".join(map(json.dumps, rows)) + "\n")
    schema = RAW_SCHEMA + ", example_id BIGINT"
    lookup = inline_vocabulary(build_vocab(spark.createDataFrame([("do w0 w1 w2 w3 w4 w5",)], "text string")))

    def prepare(df):
        text, _ = split_quarantine(to_sft_text(df))
        enc = encode_rows(text, ["prompt", "response"], lookup)
        return build_sft_sequences(enc, "prompt_ids", "response_ids", SpecialIds(), 64, 64)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    query = stream_prepare(stream, prepare, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"] > 0]) == 3
    got = sorted(tuple(map(tuple, (r.input_ids, r.label_ids))) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted(tuple(map(tuple, (r.input_ids, r.label_ids))) for r in prepare(spark.read.schema(schema).json(str(src))).collect())
    assert got == want and len(got) == 18
    # Run again with nothing new: the sink's log has every file once.
    stream_prepare(stream, prepare, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 18


@pytest.mark.parametrize("limit", [1_000, 300, 40])
def test_vocabulary_above_the_limit(spark, limit):
    rng = random.Random(limit)
    known = [f"w{i}" for i in range(500)]
    texts = [None, "", " "] + [" ".join(rng.choices(known, k=20) + ["unknown"] * 10) for _ in range(60)]  # a third of all tokens is one unknown
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(4)
    vocab = spark.createDataFrame([(w, i + 3) for i, w in enumerate(known)], "token string, id int")
    got = {r.k: list(r.t_ids) for r in encode(df, "t", vocab, ["k"], broadcast_limit=limit).collect()}
    ids = {w: i + 3 for i, w in enumerate(known)}
    assert got == {k: [ids.get(w, 0) for w in (t or "").split()] for k, t in enumerate(texts)}


@pytest.mark.parametrize("n", [0, 1, 9, 500])
def test_shuffled_batches_equal_numbered_rows(spark, n):
    df = spark.range(n).select(F.col("id").alias("key"), F.expr("transform(sequence(0, int(id % 7)), x -> x)").alias("ids"))
    rows = B.assign_batches(B.shuffle(df, "key", 5, 1), ["shuffle_key", "key"], 4).drop("shuffle_key")
    got = B.shuffled_batches(df, "key", 4, 5, 1, {"ids": F.size("ids")})
    plain = lambda x: sorted((r.key, r.row_idx, r.batch_id, r.idx_in_batch, len(r.ids)) for r in x.collect())
    assert plain(got) == plain(rows) and len(plain(got)) == n
    widest = {}
    for r in rows.collect():
        widest[r.batch_id] = max(widest.get(r.batch_id, 0), len(r.ids))
    assert all(r[B.WIDTH + "ids"] == widest[r.batch_id] for r in got.collect())
    alone = B.shuffled_batches(df.select("key"), "key", 4, 5, 1).collect()
    assert sorted((r.key, r.row_idx) for r in alone) == sorted((r.key, r.row_idx) for r in rows.collect())


def test_collated_by_known_widths(spark):
    from preftable.operators import collate as C

    df = spark.createDataFrame([(k, [5] * (k % 5 + 1), [7] * (k % 5 + 1)) for k in range(23)], "key long, input_ids array<int>, label_ids array<int>")
    known = C.collate_sft(B.shuffled_batches(df, "key", 4, 1, 0, {"input_ids": F.size("input_ids")}))
    window = C.collate_sft(B.shuffled_batches(df, "key", 4, 1, 0))
    assert sorted(known.columns) == sorted(window.columns) and not [c for c in known.columns if c.startswith(B.WIDTH)]
    assert sorted(map(str, known.select(sorted(known.columns)).collect())) == sorted(map(str, window.select(sorted(known.columns)).collect()))
    assert "Window" not in known.select("input_ids")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_token_scores(spark):
    from preftable.functions import rollout as R

    rng = random.Random(3)
    rows = [(k, [[rng.uniform(-30, 30) for _ in range(5)] for _ in range(k)], [rng.randrange(5) for _ in range(k)]) for k in (0, 1, 2, 9)]
    df = spark.createDataFrame(rows, "k int, logits array<array<double>>, ids array<int>")
    out = df.select("k", R.token_scores(F.col("logits"), F.col("ids")).alias("x"), R.token_logprobs(F.col("logits"), F.col("ids")).alias("p"), R.token_entropies(F.col("logits")).alias("e"))
    for r in out.collect():
        assert [x.logp for x in r.x] == pytest.approx(list(r.p)) and [x.entropy for x in r.x] == pytest.approx(list(r.e), abs=1e-9)
        assert len(r.x) == max(r.k - 1, 0)


def test_auxiliary_stream(spark, tmp_path):
    from preftable.prepare import ppo_streams, prepare_extra, prepare_ppo

    dirs = []
    for part in range(2):
        d = tmp_path / f"extra{part}"
        d.mkdir()
        dirs.append(str(d))
        (d / "a.json").write_text("\n".join(json.dumps({"prompt": f"w{i}", "chosen": "w1 w2", "example_id": 100 * part + i}) for i in range(5)))
        (d / "b.json").write_text("\n".join(json.dumps({"instruction": f"w{i}", "output": ["w3"], "example_id": 100 * part + 50 + i}) for i in range(4)))
        (d / "t.txt").write_text("\n".join("w1 w2 w3 w4" for _ in range(30)) + "\n")
    vocab = build_vocab(spark.createDataFrame([(" ".join(f"w{i}" for i in range(9)),)], "text string"))
    cfg = SequenceConfig(block_size=16)
    prompts, _ = prepare_ppo(spark, vocab, dirs[0], cfg)
    sft = prepare_extra(spark, vocab, dirs, "sft", cfg)
    assert sorted(int(r.extra_id) for r in sft.collect()) == sorted(100 * p + k for p in range(2) for k in (*range(5), *range(50, 54)))
    text = prepare_extra(spark, vocab, dirs, None, cfg).collect()
    assert len(text) == 2 * (30 * 5 // 16) and all(len(r.input_ids) == 16 for r in text) and len({r.extra_id for r in text}) == len(text)
    both = ppo_streams(prompts, sft, 2, 3).collect()
    assert {r.batch_id for r in both} == set(range(5))  # 9 prompts in 5 batches, 18 records in 6
    assert sorted(r.example_id for r in both if r.example_id is not None) == sorted(r.example_id for r in prompts.collect())
    assert sum(r.extra_id is not None for r in both) == 15
    assert ppo_streams(prompts, None, 2).count() == 9
