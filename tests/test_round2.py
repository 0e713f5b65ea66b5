"""Record identity, layouts of mixed directories, stable variances, rewards of empty responses."""

import json

from pyspark.sql import functions as F

from preftable.config import SequenceConfig
from preftable.operators.encode import build_vocab
from preftable.operators.metrics import masked_stats
from preftable.operators.normalise import detect_layout
from preftable.operators.rollout import build_experience
from preftable.plans.views import preference_rows
from preftable.prepare import prepare_pretrain, prepare_sft
from preftable.sources.readers import read_text_dir


def test_records_with_repeating_or_missing_ids_stay_apart(spark, tmp_path):
    for name, ids in (("a", [0, 1, None]), ("b", [0, 1, None])):
        rows = [{"instruction": f"say {name} {k}", "output": ["x y"], **({} if i is None else {"example_id": i})} for k, i in enumerate(ids)]
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
    vocab = build_vocab(spark.createDataFrame([("say a b x y 0 1 2",)], "text string"), "text")
    seen = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128MB", "64", "20"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            good, bad = prepare_sft(spark, vocab, dataset_dir=str(tmp_path))
            seen.append(sorted((r.example_id, r.split, tuple(r.input_ids)) for r in good.collect()))
            assert bad.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(seen[0]) == 6 and len({x[2] for x in seen[0]}) == 6 and seen[0] == seen[1] == seen[2]


def test_preference_layout_needs_both_columns(spark):
    df = spark.createDataFrame([("f", "i", "c", None), ("g", None, "c", "r")], "file string, instruction string, chosen string, rejected string")
    assert {r.file: r.layout for r in detect_layout(df, "rm").collect()} == {"f": "instruction", "g": "preference"}
    assert {r.chosen: r.layout for r in detect_layout(df.drop("file").limit(1), "dpo").collect()} == {"c": "instruction"}


def test_variance_of_large_values(spark):
    df = spark.createDataFrame([(1, [1e8, 1e8 + 1, 1e8 + 2, 1e8 + 3], [1, 1, 1, 1])], "b int, x array<double>, mask array<int>")
    r = masked_stats(df, ["x"], "mask", ["b"]).first()
    assert abs(r.x_var - sum((1e8 + k - r.x_mean) ** 2 for k in range(4)) / 4) < 1e-4 * r.x_var and r.x_var > 1


def test_empty_response_has_no_reward(spark):
    row = (1, [1, 1, 1], [0, 0, 0], [-1.0, -1.0], [-1.0, -1.0], [0.1, 0.2, 0.3], 7.0)
    kinds = "batch_id int, sequence_mask array<int>, response_mask array<int>, actor_logp array<double>, ref_logp array<double>, critic_values array<double>, reward double"
    out = build_experience(spark.createDataFrame([row], kinds), reward_col="reward").select("reward_score", F.col("quarantine_reason").alias("q")).first()
    assert out.reward_score is None and out.q == "empty response"


def test_text_blocks_do_not_depend_on_splits(spark, tmp_path):
    files = {"a": [f"w{i % 5} w{i % 3}" * (i % 4) for i in range(90)], "b": ["w1 w2 w3"] * 7, "c": [""]}
    for name, lines in files.items():
        (tmp_path / f"{name}.txt").write_text("".join(x + "\n" for x in lines))
    vocab = build_vocab(spark.createDataFrame([(x,) for x in files["a"]], "text string"), "text")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    try:
        for size in ("128MB", "200", "31"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            read = read_text_dir(spark, str(tmp_path)).collect()
            assert {(r.file[-5], r.line_no): r.text for r in read} == {(f, i): x for f, xs in files.items() for i, x in enumerate(xs)}
            blocks = prepare_pretrain(spark, vocab, str(tmp_path), SequenceConfig(block_size=16), batch_rows=20).collect()
            seen.append(sorted((r.file, r.group_id, r.block_id, tuple(r.input_ids)) for r in blocks))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r[:2] for r in seen[0]}) == 7 and seen[0] == seen[1] == seen[2]
    assert {len(r[3]) for r in seen[0] if r[0].endswith("c.txt")} == {1}


def test_every_chosen_document_has_a_pair(spark):
    base = "/root/testdata/sf0.001"
    pairs = preference_rows(spark, base).select("example_id", "rejected_doc_id", "lang").collect()
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{base}/labels.parquet").collect() if r.doc_id in docs}
    able = {docs[d] for d, q in quality.items() if q == 0}
    assert sorted(r.example_id for r in pairs) == sorted(d for d, q in quality.items() if q == 1 and docs[d] in able)
    assert all(quality[r.rejected_doc_id] == 0 and docs[r.rejected_doc_id] == r.lang for r in pairs)
