import json

import pytest
from pyspark.sql import functions as F

from preftable.operators.normalise import (
    detect_layout,
    split_quarantine,
    to_pair_text,
    to_sft_text,
    validate_columns,
)
from preftable.sources.readers import RAW_SCHEMA, read_json_dir, resolve_source, union_datasets

ROWS = [
    {"instruction": "Add", "input": "1 2", "output": ["3", "4"]},
    {"instruction": "Say hi", "input": "", "output": ["hi"]},
    {"instruction": "Say hi", "input": None, "output": "hi"},
    {"instruction": "Use {braces}", "input": "{instruction}", "output": []},
]


@pytest.fixture()
def raw_dir(tmp_path):
    with open(tmp_path / "a.json", "w") as f:
        for i, r in enumerate(ROWS):
            f.write(json.dumps({**r, "example_id": i}) + "\n")
    with open(tmp_path / "b.json", "w") as f:
        f.write(json.dumps({"prompt": "Q", "chosen": "good", "rejected": "bad", "example_id": 9}) + "\n")
    with open(tmp_path / "ignored.txt", "w") as f:
        f.write("not json\n")
    return str(tmp_path)


def _read(spark, path):
    return read_json_dir(spark, path, RAW_SCHEMA + ", example_id BIGINT")


def test_layout_per_file(spark, raw_dir):
    df = detect_layout(_read(spark, raw_dir), "sft")
    got = {r.example_id: r.layout for r in df.select("example_id", "layout").collect()}
    assert got == {0: "instruction", 1: "instruction", 2: "instruction", 3: "instruction", 9: "prompt"}
    pairs = detect_layout(_read(spark, raw_dir), "dpo")
    assert {r.example_id: r.layout for r in pairs.collect()}[9] == "preference"


def test_sft_text_default_and_compat(spark, raw_dir):
    df = _read(spark, raw_dir)
    out = {r.example_id: r for r in to_sft_text(df, template="default").collect()}
    assert out[0].prompt == "Human: Add\n1 2\nAssistant: "
    assert out[1].prompt == "Human: Say hi\nAssistant: "
    assert out[2].prompt == "Human: Say hi\nAssistant: "
    assert out[3].prompt == "Human: Use {braces}\n{instruction}\nAssistant: "
    assert [out[i].response for i in range(3)] == ["3", "hi", "hi"]
    assert out[3].quarantine_reason == "empty output list"
    assert out[9].response == "good" and out[9].prompt == "Human: Q\nAssistant: "
    compat = {r.example_id: r.response for r in to_sft_text(df, compat=True).collect()}
    assert compat[2] == "h" and compat[1] == "hi"


def test_pairs_and_quarantine(spark, raw_dir):
    df = _read(spark, raw_dir)
    ok, bad = split_quarantine(to_pair_text(df))
    got = {r.example_id: (r.chosen, r.rejected) for r in ok.collect()}
    assert got == {0: ("3", "4"), 9: ("good", "bad")}
    assert sorted(r.example_id for r in bad.collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        split_quarantine(to_pair_text(df), strict=True)
    compat_ok, _ = split_quarantine(to_pair_text(df, compat=True))
    assert {r.example_id: (r.chosen, r.rejected) for r in compat_ok.collect()}[2] == ("h", "i")


def test_templates(spark):
    df = spark.createDataFrame([(1, "x {y}", "", ["r"], False)], "example_id long, instruction string, input string, output array<string>, output_is_scalar boolean")
    p = to_sft_text(df, template="chinese_llama2_alpaca").first().prompt
    assert p.startswith("[INST] <<SYS>>\n") and p.endswith("x {y} [/INST]")
    p = to_sft_text(df, template="chinese_llama_alpaca").first().prompt
    assert "### Instruction:\nx {y}\n\n### Response: " in p
    with pytest.raises(ValueError):
        to_sft_text(df, template="nope")


def test_source_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        resolve_source(None, "train.json", None)
    assert resolve_source("dir") == "dir"
    with pytest.raises(ValueError):
        read_json_dir(spark, str(tmp_path))
    with pytest.raises(ValueError):
        union_datasets()
    df = spark.createDataFrame([("a",)], "prompt string")
    with pytest.raises(ValueError):
        validate_columns(df, "prompt")
    single = spark.range(3)
    assert union_datasets(single) is single


def test_read_split_files(spark, tmp_path):
    from preftable.sources.readers import read_split_files

    for name, n in (("train.json", 3), ("valid.json", 2)):
        with open(tmp_path / name, "w") as f:
            for i in range(n):
                f.write(json.dumps({"prompt": f"p{i}", "chosen": "c"}) + "\n")
    df = read_split_files(spark, str(tmp_path / "train.json"), str(tmp_path / "valid.json"))
    assert {r.split: r["count"] for r in df.groupBy("split").count().collect()} == {"train": 3, "test": 2}
    assert df.filter(F.col("prompt").isNull()).count() == 0


def test_metric_and_rollout_sinks(spark, tmp_path):
    from preftable.sources.sinks import write_metrics, write_rollouts

    m = spark.createDataFrame([(1, 0.5), (2, 0.25)], "update long, loss double")
    write_metrics(m, str(tmp_path / "metrics"))
    back = spark.read.json(str(tmp_path / "metrics"))
    assert sorted((r.update, r.loss) for r in back.collect()) == [(1, 0.5), (2, 0.25)]
    r = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "buffer_id long, seq long")
    write_rollouts(r, str(tmp_path / "rollouts"))
    one = spark.read.parquet(str(tmp_path / "rollouts")).filter(F.col("buffer_id") == 1)
    assert [x.seq for x in one.collect()] == [3]


def test_multiline_json_array_and_materialise_reuse(spark, tmp_path):
    from preftable.sources.sinks import materialise

    d = tmp_path / "arr"
    d.mkdir()
    with open(d / "a.json", "w") as f:
        json.dump([{"prompt": "p1", "chosen": "c1"}, {"prompt": "p2", "chosen": "c2"}], f, indent=2)
    df = read_json_dir(spark, str(d), multi_line=True)
    ok, _ = split_quarantine(to_sft_text(df, keep=("prompt",)))
    assert sorted(r.response for r in ok.collect()) == ["c1", "c2"]
    path = str(tmp_path / "cache")
    first = materialise(spark.range(3), path)
    assert first.count() == 3
    again = materialise(spark.range(10), path, reuse=True)
    assert again.count() == 3  # reused, not recomputed


def test_prepare_sft_from_split_files_and_pairs_from_dir(spark, tmp_path):
    from preftable.config import SequenceConfig
    from preftable.operators.encode import build_vocab
    from preftable.prepare import prepare_pairs, prepare_sft

    rows = {"train.json": [{"instruction": "say a", "input": "", "output": ["a b"]}, {"instruction": "x", "input": "", "output": []}],
            "valid.json": [{"prompt": "say b", "chosen": "b"}]}
    for name, rs in rows.items():
        with open(tmp_path / name, "w") as f:
            for r in rs:
                f.write(json.dumps(r) + "\n")
    vocab = build_vocab(spark.createDataFrame([("say a b x",)], "text string"))
    cfg = SequenceConfig(max_prompt_length=64, max_response_length=64)
    seqs, bad = prepare_sft(spark, vocab, train_file=str(tmp_path / "train.json"), valid_file=str(tmp_path / "valid.json"), cfg=cfg)
    got = sorted((r.split, len(r.input_ids) == len(r.label_ids)) for r in seqs.collect())
    assert got == [("test", True), ("train", True)]
    assert [r.quarantine_reason for r in bad.collect()] == ["empty output list"]
    d = tmp_path / "pairs"
    d.mkdir()
    with open(d / "p.json", "w") as f:
        f.write(json.dumps({"prompt": "say", "chosen": "a b", "rejected": "x"}) + "\n")
        f.write(json.dumps({"instruction": "say", "input": "", "output": ["a"]}) + "\n")
    pairs, bad = prepare_pairs(spark, vocab, dataset_dir=str(d), cfg=cfg)
    p = pairs.collect()
    assert len(p) == 1 and len(p[0].input_ids) % 2 == 0 and p[0].split in ("train", "test")
    assert bad.count() == 1
