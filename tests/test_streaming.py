import json
import os

from pyspark.sql import functions as F

from preftable.operators.normalise import split_quarantine, to_sft_text
from preftable.sources.readers import RAW_SCHEMA
from preftable.streaming.streams import run_available, stream_prepare, stream_step_metrics


def test_stream_prepare_equals_batch(spark, tmp_path):
    src = tmp_path / "src"
    os.makedirs(src)
    for part in range(3):
        with open(src / f"p{part}.json", "w") as f:
            for i in range(5):
                f.write(json.dumps({"instruction": f"do {part}-{i}", "input": "", "output": [f"ok {i}"], "example_id": part * 10 + i}) + "\n")
    schema = RAW_SCHEMA + ", example_id BIGINT"

    def transform(df):
        ok, _ = split_quarantine(to_sft_text(df))
        return ok

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    stream_prepare(stream, transform, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("example_id", "prompt", "response").collect())
    batch = sorted(tuple(r) for r in transform(spark.read.schema(schema).json(str(src))).collect())
    assert got == batch and len(got) == 15


def test_stream_step_metrics_closed_windows(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", float(m)) for m in range(0, 60, 5)] + [("2024-01-01 01:30:00", 100.0)]
    df = spark.createDataFrame(rows, "ts string, value double").select(F.to_timestamp("ts").alias("ts"), "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    agg = stream_step_metrics(stream, "ts", ["value"], window="1 hour", watermark="0 seconds")
    run_available(agg, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == 1 and out[0].n_rows == 12 and out[0].value == sum(range(0, 60, 5)) / 12


def test_prepare_pretrain_blocks(spark, tmp_path):
    from preftable.config import SequenceConfig
    from preftable.operators.encode import build_vocab
    from preftable.prepare import prepare_pretrain

    d = tmp_path / "txt"
    os.makedirs(d)
    lines = [f"w{i % 5} w{i % 3} w{i % 7}" for i in range(50)]
    with open(d / "a.txt", "w") as f:
        f.write("\n".join(lines) + "\n")
    vocab = build_vocab(spark.createDataFrame([(x,) for x in lines], "text string"))
    blocks = prepare_pretrain(spark, vocab, str(d), SequenceConfig(block_size=16), batch_rows=20).collect()
    total = {0: 20 * 4, 1: 20 * 4, 2: 10 * 4}  # BOS + 3 ids per line
    for g, n in total.items():
        got = [b for b in blocks if b.group_id == g]
        assert len(got) == n // 16 and all(len(b.input_ids) == 16 for b in got)
        assert all(b.input_ids[0] == 1 for b in got if b.block_id == 0)
