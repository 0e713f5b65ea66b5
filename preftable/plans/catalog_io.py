"""Registered queries for sources, sinks and streaming (§2.1, §2.10).

Each query first writes data that Spark derives from the fixture tables into a fresh folder under
the shared checkpoint directory (``spark.checkpoint.dir``), then reads it back through the
operator under test, so the work grows with the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from preftable.functions.arrays import ids_text
from preftable.operators import sequences as S
from preftable.operators.encode import encode_stream
from preftable.operators.normalise import split_quarantine, to_sft_text
from preftable.plans import oracle as Q
from preftable.plans import views as V
from preftable.plans.catalog import _PAIR_ENC, _SFT_ENC, BLOCK, IDS, MAX_PROMPT, MAX_RESPONSE, ORACLES, TEMPLATE, register
from preftable.session import scratch_table_path
from preftable.sources.readers import RAW_SCHEMA, read_json_dir, read_text_dir
from preftable.sources.sinks import materialise
from preftable.streaming.streams import run_available, stream_prepare, stream_step_metrics

KEYED_SCHEMA = RAW_SCHEMA + ", example_id BIGINT"


def _scratch(spark: SparkSession, kind: str) -> str:
    return scratch_table_path(spark, f"{kind}-{uuid.uuid4().hex}")


def _write_mixed_layouts(spark: SparkSession, base: str, path: str) -> None:
    """Instruction-layout files and prompt-layout files in one directory (JSON lines)."""
    inst = V.instruction_rows(spark, base)
    inst.select("example_id", "instruction", "input", "output").write.mode("overwrite").json(path)
    prompts = V.prompt_rows(spark, base).select((-F.col("example_id") - 1).alias("example_id"), "prompt", "chosen")
    prompts.write.mode("append").json(path)


@register(
    "read_json_round_trip",
    f"""WITH {Q.INSTRUCTION_CTE}
SELECT example_id, 'instruction' AS layout, {Q.render(Q.merge())} AS prompt, response FROM inst
UNION ALL
SELECT -example_id - 1 AS example_id, 'prompt' AS layout, {Q.render('instruction')} AS prompt, response FROM inst""",
)
def read_json_round_trip(spark: SparkSession, base: str) -> DataFrame:
    path = _scratch(spark, "json")
    _write_mixed_layouts(spark, base, path)
    raw = read_json_dir(spark, path, KEYED_SCHEMA)
    text = to_sft_text(raw, template=TEMPLATE, keep=("example_id", "layout"))
    ok, _ = split_quarantine(text)
    return ok


@register(
    "read_text_round_trip",
    f"""SELECT CAST(sum(len(text) - len(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines,
       CAST(sum(len(list_filter(regexp_split_to_array(text, {Q.TOKEN_RE}), lambda t: t <> ''))) AS BIGINT) AS n_tokens
FROM documents""",
)
def read_text_round_trip(spark: SparkSession, base: str) -> DataFrame:
    path = _scratch(spark, "text")
    V.table(spark, base, "documents").select("text").write.mode("overwrite").text(path)
    lines = read_text_dir(spark, path)
    toks = F.size(F.filter(F.split(F.col("text"), "[ \n]+"), lambda t: t != ""))
    return lines.agg(F.count(F.lit(1)).cast("long").alias("n_lines"), F.sum(toks).cast("long").alias("n_tokens"))


@register("stream_prepare", ORACLES["sft_sequences"])
def stream_prepare_q(spark: SparkSession, base: str) -> DataFrame:
    src = _scratch(spark, "stream-src")
    out = _scratch(spark, "stream-out")
    ckpt = _scratch(spark, "stream-ckpt")
    V.instruction_rows(spark, base).select("example_id", "instruction", "input", "output").write.mode("overwrite").json(src)
    vocab = materialise(V.document_vocab(spark, base).select("token", "id"), _scratch(spark, "vocab"))
    limits = {"prompt": MAX_PROMPT - 1, "response": MAX_RESPONSE - 1}

    def prepare(batch: DataFrame) -> DataFrame:
        text, _ = split_quarantine(to_sft_text(batch, template=TEMPLATE))
        enc = encode_stream(text, ["prompt", "response"], vocab, ["example_id"], IDS, max_ids=limits)
        seqs = S.build_sft_sequences(enc, "prompt_ids", "response_ids", IDS, MAX_PROMPT, MAX_RESPONSE)
        return seqs.select(
            "example_id",
            ids_text(F.col("input_ids")).alias("input_ids"),
            ids_text(F.col("label_ids")).alias("label_ids"),
            F.size("input_ids").cast("long").alias("n_ids"),
        )

    stream = spark.readStream.schema(KEYED_SCHEMA).option("pathGlobFilter", "*.json").json(src)
    stream_prepare(stream, prepare, out, ckpt).awaitTermination()
    return spark.read.parquet(out).select("example_id", "input_ids", "label_ids", "n_ids")


@register(
    "stream_step_metrics",
    f"""WITH w AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS ws, count(*) AS n_rows, avg(value) AS value
           FROM events GROUP BY 1)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, n_rows, {Q.rnd('value')} AS value FROM w
WHERE ws + INTERVAL 1 hour <= (SELECT max(ts) FROM events)""",
)
def stream_step_metrics_q(spark: SparkSession, base: str) -> DataFrame:
    schema = V.table(spark, base, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(base)
    # Watermarks need TIMESTAMP; the fixture column is TIMESTAMP_NTZ (wall clock, session zone).
    events = stream.select(F.col("ts").cast("timestamp").alias("ts"), "value")
    agg = stream_step_metrics(events, "ts", ["value"], window="1 hour", watermark="0 seconds")
    out = _scratch(spark, "metrics-out")
    run_available(agg, out, _scratch(spark, "metrics-ckpt"))
    res = spark.read.parquet(out)
    return res.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        F.col("n_rows").cast("long").alias("n_rows"),
        Q.round6(F.col("value")).alias("value"),
    )


def _cfg():
    from preftable.config import SequenceConfig
    from preftable.plans.catalog import SEED, SPLIT_RATIO

    return SequenceConfig(template=TEMPLATE, max_prompt_length=MAX_PROMPT, max_response_length=MAX_RESPONSE,
                          split_ratio=SPLIT_RATIO, seed=SEED, ids=IDS)


def _split_case() -> str:
    from preftable.plans.catalog import SEED, SPLIT_RATIO

    return (
        f"CASE WHEN (('0x' || substr(md5('{SEED}:' || example_id), 1, 8))::BIGINT / 4294967296.0) < {SPLIT_RATIO} "
        "THEN 'test' ELSE 'train' END"
    )


_SPLIT_CASE = _split_case()


@register(
    "prepare_sft_end_to_end",
    f"""{_SFT_ENC}
SELECT example_id, {_SPLIT_CASE} AS split,
       {Q.ids_text(Q.seq_sft('src', 'tgt'))} AS input_ids, {Q.ids_text(Q.seq_labels('src', 'tgt'))} AS label_ids
FROM enc""",
)
def prepare_sft_end_to_end(spark: SparkSession, base: str) -> DataFrame:
    from preftable.prepare import prepare_sft

    src = _scratch(spark, "sft-records")
    V.instruction_rows(spark, base).select("example_id", "instruction", "input", "output").write.json(src)
    seqs, _ = prepare_sft(spark, V.document_vocab(spark, base), dataset_dir=src, cfg=_cfg())
    return seqs.select("example_id", "split", ids_text(F.col("input_ids")).alias("input_ids"), ids_text(F.col("label_ids")).alias("label_ids"))


@register(
    "prepare_ppo_end_to_end",
    ORACLES["ppo_prompts"],
)
def prepare_ppo_end_to_end(spark: SparkSession, base: str) -> DataFrame:
    from preftable.prepare import prepare_ppo

    src = _scratch(spark, "ppo-records")
    V.instruction_rows(spark, base).select("example_id", "instruction", "input", "output").write.json(src)
    prompts, _ = prepare_ppo(spark, V.document_vocab(spark, base), src, _cfg())
    return prompts.select("example_id", ids_text(F.col("input_ids")).alias("input_ids"), ids_text(F.col("label_ids")).alias("label_ids"))


@register(
    "prepare_pairs_end_to_end",
    f"""{_PAIR_ENC}
SELECT example_id, {_SPLIT_CASE} AS split, {Q.ids_text('list_concat(accepts_ids, rejects_ids)')} AS input_ids,
       {Q.ids_text('list_concat(accepts_labels, rejects_labels)')} AS label_ids
FROM padded""",
)
def prepare_pairs_end_to_end(spark: SparkSession, base: str) -> DataFrame:
    from preftable.prepare import prepare_pairs

    src = _scratch(spark, "pair-records")
    V.preference_rows(spark, base).select("example_id", "prompt", "chosen", "rejected").write.json(src)
    pairs, _ = prepare_pairs(spark, V.document_vocab(spark, base), dataset_dir=src, cfg=_cfg())
    return pairs.select("example_id", "split", ids_text(F.col("input_ids")).alias("input_ids"), ids_text(F.col("label_ids")).alias("label_ids"))


FILE_DOCS = 1000  # documents in each text file
BATCH_LINES = 100  # lines of a file that are packed together


@register(
    "prepare_pretrain_end_to_end",
    f"""WITH {Q.VOCAB_CTE},
ln AS (
  SELECT row_number() OVER (ORDER BY doc_id, k) AS lid, doc_id // {FILE_DOCS} AS file_no,
         row_number() OVER (PARTITION BY doc_id // {FILE_DOCS} ORDER BY doc_id, k) - 1 AS line_no, line
  FROM (SELECT doc_id, l.line, l.k
        FROM documents, unnest(string_split(coalesce(text, ''), chr(10))) WITH ORDINALITY AS l(line, k)) x),
{Q.encode_cte('enc', 'ln', 'lid', 'line')},
g AS (
  SELECT file_no, line_no // {BATCH_LINES} AS group_id, u.id,
         row_number() OVER (PARTITION BY file_no, line_no // {BATCH_LINES} ORDER BY line_no, u.k) - 1 AS gpos,
         count(*) OVER (PARTITION BY file_no, line_no // {BATCH_LINES}) AS tot
  FROM ln JOIN enc USING (lid), unnest(list_concat([1], enc.ids)) WITH ORDINALITY AS u(id, k)),
kept AS (
  SELECT file_no, group_id, gpos // {BLOCK} AS block_id, gpos, id FROM g
  WHERE tot < {BLOCK} OR gpos < (tot // {BLOCK}) * {BLOCK})
SELECT file_no, group_id, block_id, count(*) AS n_ids, array_to_string(list(id ORDER BY gpos), ' ') AS input_ids
FROM kept GROUP BY file_no, group_id, block_id""",
)
def prepare_pretrain_end_to_end(spark: SparkSession, base: str) -> DataFrame:
    """Text files of up to a thousand documents each, numbered by line and packed in runs of lines."""
    from preftable.config import SequenceConfig
    from preftable.prepare import prepare_pretrain

    src = _scratch(spark, "pretrain-text")
    docs = V.table(spark, base, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / FILE_DOCS).cast("long").alias("file_no"))
    docs = docs.repartition("file_no").sortWithinPartitions("file_no", "doc_id").drop("doc_id")
    docs.write.partitionBy("file_no").text(src)
    blocks = prepare_pretrain(spark, V.document_vocab(spark, base), f"{src}/file_no=*", SequenceConfig(block_size=BLOCK), BATCH_LINES)
    return blocks.select(
        F.regexp_extract("file", "file_no=([0-9]+)/", 1).cast("long").alias("file_no"),
        "group_id",
        "block_id",
        F.size("input_ids").cast("long").alias("n_ids"),
        ids_text(F.col("input_ids")).alias("input_ids"),
    )


_EXTRA_SIZE = 3


@register(
    "ppo_with_extra",
    f"""WITH {Q.INSTRUCTION_CTE},
m AS (SELECT example_id, row_number() OVER (ORDER BY md5('42:0:' || example_id), example_id) - 1 AS i FROM inst),
mb AS (SELECT example_id, i // 4 AS batch_id, CAST(i % 4 AS INTEGER) AS idx_in_batch FROM m),
x AS (SELECT extra_id, row_number() OVER (ORDER BY md5('43:0:' || extra_id), extra_id) - 1 AS i
      FROM (SELECT CAST(example_id AS VARCHAR) AS extra_id FROM inst UNION ALL SELECT CAST(-example_id - 1 AS VARCHAR) FROM inst)),
xb AS (SELECT extra_id, i // {_EXTRA_SIZE} AS batch_id, CAST(i % {_EXTRA_SIZE} AS INTEGER) AS idx_in_batch FROM x),
lim AS (SELECT least((SELECT max(batch_id) FROM mb), (SELECT max(batch_id) FROM xb)) AS last)
SELECT coalesce(mb.batch_id, xb.batch_id) AS batch_id, coalesce(mb.idx_in_batch, xb.idx_in_batch) AS idx_in_batch, example_id, extra_id
FROM (SELECT * FROM mb WHERE batch_id <= (SELECT last FROM lim)) mb
FULL OUTER JOIN (SELECT * FROM xb WHERE batch_id <= (SELECT last FROM lim)) xb ON mb.batch_id = xb.batch_id AND mb.idx_in_batch = xb.idx_in_batch""",
)
def ppo_with_extra(spark: SparkSession, base: str) -> DataFrame:
    """Prompts beside auxiliary SFT records of two directories, one for each record layout."""
    from preftable.prepare import ppo_streams, prepare_extra, prepare_ppo

    one, two = _scratch(spark, "extra-a"), _scratch(spark, "extra-b")
    inst = V.instruction_rows(spark, base)
    inst.select("example_id", "instruction", "input", "output").write.json(one)
    V.prompt_rows(spark, base).select((-F.col("example_id") - 1).alias("example_id"), "prompt", "chosen").write.json(two)
    vocab = V.document_vocab(spark, base)
    prompts, _ = prepare_ppo(spark, vocab, one, _cfg())
    extra = prepare_extra(spark, vocab, [one, two], "sft", _cfg())
    both = ppo_streams(prompts, extra, 4, _EXTRA_SIZE)
    return both.select("batch_id", "idx_in_batch", "example_id", "extra_id")
