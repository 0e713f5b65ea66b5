"""End-to-end data preparation for the four training stages, composed from the operators.

Each function reads records the way the reference's launchers do (a directory of ``*.json``
files, or an explicit train/validation pair) and returns ``(prepared, quarantined)`` DataFrames.
Nothing is collected; the caller decides where to write.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from preftable.config import SequenceConfig
from preftable.operators import batching as B
from preftable.operators import sequences as S
from preftable.operators.encode import encode, encode_long, token_count
from preftable.operators.normalise import split_quarantine, to_pair_text, to_sft_text
from preftable.sources.readers import RAW_SCHEMA, read_json_dir, read_split_files, read_text_dir, resolve_source, union_datasets
from preftable.sources.sinks import materialise, prune_raw_columns, table_digest

KEY = "example_id"
ROW = "__pt_row"  # identifies a record while its tokens are gathered; users' ids may repeat across files


def _records(
    spark: SparkSession,
    dataset_dir: str | Sequence[str] | None,
    train_file: str | None,
    valid_file: str | None,
    multi_line: bool,
) -> tuple[DataFrame, bool]:
    """Raw records with a row key, and whether a split still has to be drawn."""
    schema = RAW_SCHEMA + f", {KEY} BIGINT"
    several = not isinstance(dataset_dir, str | None)
    mode = resolve_source(dataset_dir[0] if several else dataset_dir, train_file, valid_file)
    if several:
        raw = union_datasets(*[read_json_dir(spark, d, schema, multi_line) for d in dataset_dir])
    elif mode == "dir":
        raw = read_json_dir(spark, dataset_dir, schema, multi_line)
    else:
        raw = read_split_files(spark, train_file, valid_file, schema, multi_line)
    # A record without an id gets one from its content, so that neither it nor the split drawn by it
    # depends on how the files are cut. Ids needn't be unique: rows are told apart by ROW.
    content = F.to_json(F.struct(*[F.col(f.split()[0]) for f in RAW_SCHEMA.split(", ")]))
    raw = raw.withColumn(KEY, F.coalesce(F.col(KEY), F.xxhash64(content))).withColumn(ROW, F.monotonically_increasing_id())
    return raw, mode == "dir"


def _cached(
    spark: SparkSession,
    df: DataFrame,
    cache: str | None,
    vocab: DataFrame,
    sources: Sequence[str | Sequence[str] | None],
    cfg: SequenceConfig,
    **options: object,
) -> DataFrame:
    """``df`` from the table at ``cache`` if that was made from the same files, vocabulary and options."""
    if cache is None:
        return df
    inputs = [x for s in sources if s for x in ([s] if isinstance(s, str) else s)]
    told = {"config": asdict(cfg), "vocabulary": table_digest(vocab.select("token", "id")), **options}
    return materialise(df, cache, reuse=True, inputs=inputs, options=told)


def prepare_sft(
    spark: SparkSession,
    vocab: DataFrame,
    dataset_dir: str | Sequence[str] | None = None,
    train_file: str | None = None,
    valid_file: str | None = None,
    cfg: SequenceConfig = SequenceConfig(),
    compat: bool = False,
    strict: bool = False,
    multi_line: bool = False,
    cache: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """SFT: records → ``(example_id, split, input_ids, label_ids)`` and the quarantined rows.

    ``dataset_dir`` may be several directories, whose files are one dataset. With ``cache`` the encoded
    rows are kept there and read again as long as files, vocabulary and options stay the same.
    """
    raw, draw_split = _records(spark, dataset_dir, train_file, valid_file, multi_line)
    keep = (ROW, KEY) if draw_split else (ROW, KEY, "split")
    text, bad = split_quarantine(to_sft_text(raw, cfg.template, "sft", compat, keep=keep), strict)
    limits = {"prompt": cfg.max_prompt_length - 1, "response": cfg.max_response_length - 1}
    passthrough = () if draw_split else ("split",)
    enc = encode(text, ["prompt", "response"], vocab, [ROW], cfg.ids, passthrough=(KEY, *passthrough), max_ids=limits)
    seqs = S.build_sft_sequences(enc, ids=cfg.ids, max_prompt_length=cfg.max_prompt_length,
                                 max_response_length=cfg.max_response_length, keep=(KEY, *passthrough))
    if draw_split:
        seqs = B.train_test_split(seqs, KEY, cfg.split_ratio, cfg.seed)
    seqs = prune_raw_columns(seqs, (KEY, "split", "input_ids", "label_ids"))
    return _cached(spark, seqs, cache, vocab, (dataset_dir, train_file, valid_file), cfg, stage="sft", compat=compat, multi_line=multi_line), bad


def prepare_pairs(
    spark: SparkSession,
    vocab: DataFrame,
    dataset_dir: str | Sequence[str] | None = None,
    train_file: str | None = None,
    valid_file: str | None = None,
    cfg: SequenceConfig = SequenceConfig(),
    compat: bool = False,
    strict: bool = False,
    multi_line: bool = False,
    flat: bool = True,
    cache: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """RM / DPO: records → padded pairs (flat ``input_ids``/``label_ids`` by default); ``cache`` as for SFT."""
    raw, draw_split = _records(spark, dataset_dir, train_file, valid_file, multi_line)
    keep = (ROW, KEY) if draw_split else (ROW, KEY, "split")
    text, bad = split_quarantine(to_pair_text(raw, cfg.template, compat, keep=keep), strict)
    limits = {
        "prompt": cfg.max_prompt_length - 1,
        "chosen": cfg.max_response_length - 1,
        "rejected": cfg.max_response_length - 1,
    }
    passthrough = () if draw_split else ("split",)
    enc = encode(text, ["prompt", "chosen", "rejected"], vocab, [ROW], cfg.ids, passthrough=(KEY, *passthrough), max_ids=limits)
    pairs = S.pad_pair(
        S.build_pair_sequences(enc, ids=cfg.ids, max_prompt_length=cfg.max_prompt_length,
                               max_response_length=cfg.max_response_length, keep=(KEY, *passthrough)),
        cfg.ids,
    )
    out = S.flatten_pairs(pairs, keep=(KEY, *passthrough)) if flat else pairs
    if draw_split:
        out = B.train_test_split(out, KEY, cfg.split_ratio, cfg.seed)
    sources = (dataset_dir, train_file, valid_file)
    return _cached(spark, out, cache, vocab, sources, cfg, stage="pairs", compat=compat, multi_line=multi_line, flat=flat), bad


def prepare_ppo(
    spark: SparkSession,
    vocab: DataFrame,
    dataset_dir: str,
    cfg: SequenceConfig = SequenceConfig(),
    compat: bool = False,
    strict: bool = False,
    multi_line: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """PPO prompts: ``input_ids = prompt + [bos]``, ``label_ids = response + [bos]``; no split."""
    raw, _ = _records(spark, dataset_dir, None, None, multi_line)
    text, bad = split_quarantine(to_sft_text(raw, cfg.template, "ppo", compat, keep=(ROW, KEY)), strict)
    limits = {"prompt": cfg.max_prompt_length - 1, "response": cfg.max_response_length - 1}
    enc = encode(text, ["prompt", "response"], vocab, [ROW], cfg.ids, passthrough=(KEY,), max_ids=limits)
    return S.build_ppo_prompts(enc, ids=cfg.ids, max_prompt_length=cfg.max_prompt_length,
                               max_response_length=cfg.max_response_length), bad


def prepare_extra(
    spark: SparkSession, vocab: DataFrame, extra_dir: str | Sequence[str], kind: str | None = None, cfg: SequenceConfig = SequenceConfig()
) -> DataFrame:
    """The auxiliary PPO data of all files under ``extra_dir``: ``extra_id, input_ids, label_ids``.

    ``kind="sft"`` reads ``*.json`` records and makes SFT sequences (``extra_id`` is the record's id);
    any other kind reads ``*.txt`` and makes packed blocks, named by file, group and block.
    """
    dirs = [extra_dir] if isinstance(extra_dir, str) else list(extra_dir)
    if kind == "sft":
        seqs, _ = prepare_sft(spark, vocab, dataset_dir=dirs, cfg=cfg)
        return seqs.select(F.col(KEY).cast("string").alias("extra_id"), "input_ids", "label_ids")
    blocks = union_datasets(*[prepare_pretrain(spark, vocab, d, cfg) for d in dirs])
    name = F.concat_ws(":", "file", "group_id", "block_id")
    return blocks.select(name.alias("extra_id"), "input_ids", "label_ids")


def ppo_streams(
    prompts: DataFrame, extra: DataFrame | None, batch_size: int, extra_batch_size: int | None = None, seed: int = 42, epoch: int = 0
) -> DataFrame:
    """The prompts' batches, each beside the auxiliary batch that is trained with it.

    Both tables are shuffled by hash and cut in batches; the i-th batches meet, row by row, up to the
    shorter stream's end (``extra_`` columns; null where one batch is longer). Without auxiliary data
    (None) every prompt batch is alone.
    """
    main = B.assign_batches(B.shuffle(prompts, KEY, seed, epoch), ["shuffle_key", KEY], batch_size).drop("shuffle_key", "row_idx")
    if extra is None:
        return main
    side = B.assign_batches(B.shuffle(extra, "extra_id", seed + 1, epoch), ["shuffle_key", "extra_id"], extra_batch_size or batch_size)
    side = side.drop("shuffle_key", "row_idx").withColumnRenamed("extra_id", "id")
    return B.zip_streams(main, side, prefix="extra_")


def prepare_pretrain(
    spark: SparkSession,
    vocab: DataFrame,
    text_dir: str,
    cfg: SequenceConfig = SequenceConfig(),
    batch_rows: int = 1000,
) -> DataFrame:
    """Plain-text corpus → packed blocks ``(file, group_id, block_id, input_ids, label_ids)``: each line
    gets BOS, runs of up to ``batch_rows`` consecutive lines of a file are concatenated and cut into
    ``cfg.block_size`` blocks.

    Lines are numbered in each file, so the blocks don't depend on how the scan splits the files.
    Tokens stay in long form, so no line is built whole.
    """
    lines = read_text_dir(spark, text_dir)
    lines = lines.withColumn("group_id", F.floor(F.col("line_no") / batch_rows).cast("long"))
    lengths = lines.select("file", "group_id", "line_no", token_count(F.col("text"), with_bos=True).alias("n_ids"))
    lines = lines.join(S.row_starts(lengths, ["file", "group_id"], "line_no"), ["file", "group_id", "line_no"])
    toks = encode_long(lines, "text", vocab, ["file", "line_no", "group_id", "__st", "__tot"], cfg.ids, with_bos=True)
    return S.pack_blocks_long(toks, ["file", "group_id"], "line_no", "pos", "id", cfg.block_size)
