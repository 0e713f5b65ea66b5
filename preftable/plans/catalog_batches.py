"""Registered queries for batching, buffers, replay, collation and sequence joining (§2.5-§2.7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from preftable.functions.arrays import ids_text, right_pad, truncate_ids
from preftable.functions.rollout import response_mask
from preftable.operators import batching as B
from preftable.operators import collate as C
from preftable.operators import sequences as S
from preftable.operators.rollout import strip_and_join
from preftable.plans import oracle as Q
from preftable.plans import views as V
from preftable.plans.catalog import (
    _PAIR_ENC,
    _SFT_ENC,
    BLOCK,
    IDS,
    MAX_PROMPT,
    MAX_RESPONSE,
    PACK_GROUP,
    SEED,
    _pair_sequences,
    _sft_encoded,
    register,
)

BATCH = 4
MINI = 2
BUFFER = 3
PPO_EPOCHS = 2
RANKS = 4
ACCUM = 8


def _batched(df: DataFrame, key: str, epoch: int = 0, batch_size: int = BATCH, widths: tuple[str, ...] = ()) -> DataFrame:
    return B.shuffled_batches(df, key, batch_size, SEED, epoch, {c: F.size(c) for c in widths})


def _batched_by_order(df: DataFrame, key: str) -> DataFrame:
    """The same batches by numbering whole rows (``assign_batches``)."""
    shuffled = B.shuffle(df, key, SEED, 0)
    return B.assign_batches(shuffled, ["shuffle_key", key], BATCH).drop("shuffle_key")


def _row_idx_sql(key: str, epoch: int = 0) -> str:
    return f"row_number() OVER (ORDER BY md5('{SEED}:{epoch}:' || {key}), {key}) - 1"


_SFT_IDS = f"""{Q.INSTRUCTION_CTE}"""
_BATCHES_CTE = f"""b AS (SELECT example_id, {_row_idx_sql('example_id')} AS row_idx FROM inst),
bb AS (SELECT example_id, row_idx // {BATCH} AS batch_id, CAST(row_idx % {BATCH} AS INTEGER) AS idx_in_batch FROM b)"""


def _sft_examples(spark: SparkSession, base: str) -> DataFrame:
    return V.instruction_rows(spark, base).select("example_id")


@register(
    "batches",
    f"""WITH {_SFT_IDS}, {_BATCHES_CTE}
SELECT example_id, batch_id, idx_in_batch FROM bb""",
)
def batches(spark: SparkSession, base: str) -> DataFrame:
    return _batched(_sft_examples(spark, base), "example_id").select("example_id", "batch_id", "idx_in_batch")


@register(
    "batches_by_order",
    f"""WITH {_SFT_IDS}, {_BATCHES_CTE}
SELECT example_id, batch_id, idx_in_batch FROM bb""",
)
def batches_by_order(spark: SparkSession, base: str) -> DataFrame:
    return _batched_by_order(_sft_examples(spark, base), "example_id").select("example_id", "batch_id", "idx_in_batch")


@register(
    "mini_batches",
    f"""WITH {_SFT_IDS}, {_BATCHES_CTE}
SELECT example_id, batch_id, CAST(idx_in_batch // {MINI} AS BIGINT) AS mini_id FROM bb""",
)
def mini_batches(spark: SparkSession, base: str) -> DataFrame:
    b = B.make_mini_batches(_batched(_sft_examples(spark, base), "example_id"), MINI)
    return b.select("example_id", "batch_id", "mini_id")


_BUFFER_CTE = f"""m AS (SELECT example_id, batch_id, idx_in_batch // {MINI} AS mini_id, batch_id // {BUFFER} AS buffer_id FROM bb),
f AS (SELECT * FROM m WHERE buffer_id < ((SELECT max(batch_id) FROM m) + 1) // {BUFFER})"""


def _buffered(spark: SparkSession, base: str) -> DataFrame:
    b = B.make_mini_batches(_batched(_sft_examples(spark, base), "example_id"), MINI)
    return B.fill_buffer(b, BUFFER)


@register(
    "buffers",
    f"""WITH {_SFT_IDS}, {_BATCHES_CTE}, {_BUFFER_CTE}
SELECT example_id, batch_id, buffer_id FROM f""",
)
def buffers(spark: SparkSession, base: str) -> DataFrame:
    return _buffered(spark, base).select("example_id", "batch_id", "buffer_id")


@register(
    "replay",
    f"""WITH {_SFT_IDS}, {_BATCHES_CTE}, {_BUFFER_CTE},
r AS (SELECT f.*, e.ppo_epoch FROM f, (SELECT range AS ppo_epoch FROM range({PPO_EPOCHS})) e),
v AS (SELECT DISTINCT buffer_id, ppo_epoch, batch_id, mini_id FROM r),
s AS (SELECT *, row_number() OVER (ORDER BY buffer_id, ppo_epoch,
        md5('{SEED}:' || buffer_id || ':' || ppo_epoch || ':' || batch_id || ':' || mini_id), batch_id, mini_id) AS step FROM v)
SELECT r.example_id, CAST(r.ppo_epoch AS INTEGER) AS ppo_epoch, s.step
FROM r JOIN s ON r.buffer_id = s.buffer_id AND r.ppo_epoch = s.ppo_epoch AND r.batch_id = s.batch_id AND r.mini_id = s.mini_id""",
)
def replay(spark: SparkSession, base: str) -> DataFrame:
    r = B.replay_epochs(_buffered(spark, base), PPO_EPOCHS, SEED)
    return r.select("example_id", "ppo_epoch", "step")


@register(
    "shards",
    f"""SELECT doc_id, CAST(({_row_idx_sql('doc_id')}) % {RANKS} AS INTEGER) AS rank FROM documents""",
)
def shards(spark: SparkSession, base: str) -> DataFrame:
    docs = B.shuffle(V.table(spark, base, "documents").select("doc_id"), "doc_id", SEED, 0)
    return B.shard_to_ranks(docs, RANKS, ["shuffle_key", "doc_id"]).select("doc_id", "rank")


@register(
    "zip_streams",
    f"""WITH {_SFT_IDS}, {_BATCHES_CTE},
xb AS (SELECT doc_id, {_row_idx_sql('doc_id', 1)} AS row_idx FROM documents),
x AS (SELECT doc_id AS extra_doc_id, row_idx // {BATCH} AS batch_id, CAST(row_idx % {BATCH} AS INTEGER) AS idx_in_batch FROM xb),
lim AS (SELECT least((SELECT max(batch_id) FROM bb), (SELECT max(batch_id) FROM x)) AS last)
SELECT coalesce(bb.batch_id, x.batch_id) AS batch_id, coalesce(bb.idx_in_batch, x.idx_in_batch) AS idx_in_batch,
       bb.example_id, x.extra_doc_id
FROM (SELECT * FROM bb WHERE batch_id <= (SELECT last FROM lim)) bb
FULL OUTER JOIN (SELECT * FROM x WHERE batch_id <= (SELECT last FROM lim)) x
  ON bb.batch_id = x.batch_id AND bb.idx_in_batch = x.idx_in_batch""",
)
def zip_streams(spark: SparkSession, base: str) -> DataFrame:
    main = _batched(_sft_examples(spark, base), "example_id").select("example_id", "batch_id", "idx_in_batch")
    docs = V.table(spark, base, "documents").select("doc_id")
    extra = _batched(docs, "doc_id", epoch=1).select("doc_id", "batch_id", "idx_in_batch")
    return B.zip_streams(main, extra).select("batch_id", "idx_in_batch", "example_id", "extra_doc_id")


@register(
    "schedule",
    f"""WITH {_SFT_IDS}, {_BATCHES_CTE},
n AS (SELECT CAST(count(DISTINCT batch_id) AS DOUBLE) AS nb FROM bb),
u AS (SELECT nb, greatest(nb * {BATCH / 1} * 1 / {ACCUM}, 1.0) AS upe FROM n)
SELECT CAST(nb AS BIGINT) AS n_batches, upe AS updates_per_epoch, CAST(ceil(1.0 * upe) AS BIGINT) AS total_updates,
       CAST(ceil(1.0 * upe) AS BIGINT) * {ACCUM} AS micro_steps, CAST(1 AS BIGINT) AS train_epochs FROM u""",
)
def schedule(spark: SparkSession, base: str) -> DataFrame:
    b = _batched(_sft_examples(spark, base), "example_id")
    return B.update_schedule(b, "batch_id", BATCH, 1, 1, ACCUM, 1.0)


@register(
    "schedule_max_steps",
    f"""WITH {_SFT_IDS}, {_BATCHES_CTE},
n AS (SELECT CAST(count(DISTINCT batch_id) AS DOUBLE) AS nb FROM bb),
u AS (SELECT nb, greatest(nb * {BATCH / MINI} * {PPO_EPOCHS} / {ACCUM}, 1.0) AS upe FROM n)
SELECT CAST(nb AS BIGINT) AS n_batches, upe AS updates_per_epoch, CAST(50 AS BIGINT) AS total_updates, CAST({50 * ACCUM} AS BIGINT) AS micro_steps,
       CAST(floor(50 / upe) + CASE WHEN 50 - floor(50 / upe) * upe > 0 THEN 1 ELSE 0 END AS BIGINT) AS train_epochs FROM u""",
)
def schedule_max_steps(spark: SparkSession, base: str) -> DataFrame:
    b = _batched(_sft_examples(spark, base), "example_id")
    return B.update_schedule(b, "batch_id", BATCH, MINI, PPO_EPOCHS, ACCUM, 1.0, max_steps=50)


# ---------------------------------------------------------------------------------------------
# Collation
# ---------------------------------------------------------------------------------------------


def _sft_seq_batched(spark: SparkSession, base: str) -> DataFrame:
    seqs = S.build_sft_sequences(_sft_encoded(spark, base), "prompt_ids", "response_ids", IDS, MAX_PROMPT, MAX_RESPONSE)
    return _batched(seqs, "example_id", widths=("input_ids",))


_SFT_SEQ = f"""{_SFT_ENC},
seqs AS (SELECT example_id, {Q.seq_sft('src', 'tgt')} AS ids, {Q.seq_labels('src', 'tgt')} AS lab, src, tgt FROM enc),
{_BATCHES_CTE},
sb AS (SELECT seqs.*, bb.batch_id, bb.idx_in_batch FROM seqs JOIN bb ON seqs.example_id = bb.example_id)"""


def _mask_sql(expr: str) -> str:
    return f"list_transform({expr}, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)"


@register(
    "collate_sft",
    f"""{_SFT_SEQ},
p AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS m FROM sb)
SELECT example_id, batch_id, {Q.ids_text(Q.rpad('ids', 'm', 0))} AS input_ids,
       {Q.ids_text(Q.rpad('lab', 'm', -100))} AS labels, {Q.ids_text(_mask_sql(Q.rpad('ids', 'm', 0)))} AS attention_mask
FROM p""",
)
def collate_sft(spark: SparkSession, base: str) -> DataFrame:
    c = C.collate_sft(_sft_seq_batched(spark, base), "batch_id", "input_ids", "label_ids", IDS)
    return c.select("example_id", "batch_id", *[ids_text(F.col(x)).alias(x) for x in ("input_ids", "labels", "attention_mask")])


@register(
    "collate_pair",
    f"""{_PAIR_ENC},
pb AS (SELECT padded.*, ({_row_idx_sql('example_id')}) // 2 AS batch_id FROM padded),
p AS (SELECT *, max(len(accepts_ids)) OVER (PARTITION BY batch_id) AS ma,
             max(len(rejects_ids)) OVER (PARTITION BY batch_id) AS mr FROM pb)
SELECT example_id, batch_id,
       {Q.ids_text(Q.rpad('accepts_ids', 'ma', 0))} AS accepts_input_ids,
       {Q.ids_text(Q.rpad('accepts_labels', 'ma', -100))} AS accepts_labels,
       {Q.ids_text(_mask_sql(Q.rpad('accepts_ids', 'ma', 0)))} AS accepts_attention_mask,
       {Q.ids_text(Q.rpad('rejects_ids', 'mr', 0))} AS rejects_input_ids,
       {Q.ids_text(Q.rpad('rejects_labels', 'mr', -100))} AS rejects_labels,
       {Q.ids_text(_mask_sql(Q.rpad('rejects_ids', 'mr', 0)))} AS rejects_attention_mask
FROM p""",
)
def collate_pair(spark: SparkSession, base: str) -> DataFrame:
    flat = S.flatten_pairs(_pair_sequences(spark, base))
    half = F.floor(F.size("input_ids") / 2)  # a flat pair is both sides padded to one length
    b = B.shuffled_batches(flat, "example_id", 2, SEED, 0, {"accepts_ids": half, "rejects_ids": half})
    c = C.collate_pair(b, "batch_id", IDS, flat=True)
    cols = [f"{s}_{k}" for s in ("accepts", "rejects") for k in ("input_ids", "labels", "attention_mask")]
    return c.select("example_id", "batch_id", *[ids_text(F.col(x)).alias(x) for x in cols])


_LEFT = f"""{_SFT_ENC},
pr AS (SELECT example_id, list_concat(src, [1]) AS ids, tgt FROM enc),
{_BATCHES_CTE},
lb AS (SELECT pr.*, bb.batch_id FROM pr JOIN bb ON pr.example_id = bb.example_id),
lp AS (SELECT *, {Q.lpad('ids', 'max(len(ids)) OVER (PARTITION BY batch_id)', 0)} AS pids,
              {Q.rpad('tgt', 'max(len(tgt)) OVER (PARTITION BY batch_id)', 0)} AS rids FROM lb)"""


def _left_batched(spark: SparkSession, base: str) -> DataFrame:
    enc = _sft_encoded(spark, base)
    prompts = S.build_ppo_prompts(
        enc, "prompt_ids", "response_ids", IDS, MAX_PROMPT, MAX_RESPONSE, keep=("example_id", "response_ids")
    ).withColumn("tgt", truncate_ids(F.col("response_ids"), MAX_RESPONSE))
    return C.collate_prompts_left(_batched(prompts, "example_id", widths=("input_ids",)), "batch_id", "input_ids", IDS)


@register(
    "collate_left",
    f"""{_LEFT}
SELECT example_id, batch_id, {Q.ids_text('pids')} AS input_ids, {Q.ids_text(_mask_sql('pids'))} AS attention_mask FROM lp""",
)
def collate_left(spark: SparkSession, base: str) -> DataFrame:
    c = _left_batched(spark, base)
    return c.select("example_id", "batch_id", ids_text(F.col("input_ids")).alias("input_ids"), ids_text(F.col("attention_mask")).alias("attention_mask"))


@register(
    "pad_across_shards",
    f"""{_SFT_SEQ},
st AS (SELECT *, batch_id // 2 AS step, {_mask_sql('ids')} AS am FROM sb),
p AS (SELECT *, max(len(ids)) OVER (PARTITION BY step) AS m FROM st)
SELECT example_id, step, {Q.ids_text(Q.rpad('ids', 'm', 0))} AS input_ids, {Q.ids_text(Q.rpad('am', 'm', 0))} AS attention_mask FROM p""",
)
def pad_across_shards(spark: SparkSession, base: str) -> DataFrame:
    b = _sft_seq_batched(spark, base).drop(B.WIDTH + "input_ids")
    b = b.withColumn("step", F.floor(F.col("batch_id") / 2).cast("long")).withColumn(
        "attention_mask", F.transform("input_ids", lambda x: F.when(x != IDS.pad_id, 1).otherwise(0))
    )
    p = C.pad_across_shards(b, "step", "input_ids", "attention_mask", "right", IDS)
    return p.select("example_id", "step", ids_text(F.col("input_ids")).alias("input_ids"), ids_text(F.col("attention_mask")).alias("attention_mask"))


@register(
    "collate_blocks",
    f"""WITH {Q.VOCAB_CTE}, {Q.encode_cte('enc', 'documents', 'doc_id', 'text')},
toks AS (SELECT e.doc_id // {PACK_GROUP} AS group_id, e.doc_id, u.k FROM enc e, unnest(list_concat([1], e.ids)) WITH ORDINALITY AS u(id, k)),
g AS (SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY doc_id, k) - 1 AS gpos,
             count(*) OVER (PARTITION BY group_id) AS tot FROM toks),
blocks AS (SELECT group_id, gpos // {BLOCK} AS block_id, count(*) AS n FROM g
           WHERE tot < {BLOCK} OR gpos < (tot // {BLOCK}) * {BLOCK} GROUP BY 1, 2),
bt AS (SELECT *, (row_number() OVER (ORDER BY group_id, block_id) - 1) // {BATCH} AS batch_id FROM blocks)
SELECT group_id, block_id, batch_id, min(n) OVER (PARTITION BY batch_id) = max(n) OVER (PARTITION BY batch_id) AS uniform_length FROM bt""",
)
def collate_blocks(spark: SparkSession, base: str) -> DataFrame:
    from preftable.operators.encode import encode_with_specials

    docs = V.table(spark, base, "documents", spread=True).select("doc_id", "text")
    enc = encode_with_specials(docs, "text", V.document_vocab(spark, base), ["doc_id"], IDS, out="input_ids")
    enc = enc.withColumn("group_id", F.floor(F.col("doc_id") / PACK_GROUP).cast("long"))
    blocks = S.pack_blocks(enc, ["group_id"], "doc_id", "input_ids", BLOCK)
    b = B.assign_batches(blocks.drop("label_ids"), ["group_id", "block_id"], BATCH)
    return C.collate_blocks(b, "batch_id").select("group_id", "block_id", "batch_id", "uniform_length")


@register(
    "collate_blocks_ids",
    f"""WITH {Q.VOCAB_CTE}, {Q.encode_cte('enc', 'documents', 'doc_id', 'text')},
toks AS (SELECT e.doc_id // {PACK_GROUP} AS group_id, e.doc_id, u.id, u.k FROM enc e, unnest(list_concat([1], e.ids)) WITH ORDINALITY AS u(id, k)),
g AS (SELECT group_id, id, row_number() OVER (PARTITION BY group_id ORDER BY doc_id, k) - 1 AS gpos FROM toks),
blocks AS (SELECT group_id, gpos // {BLOCK} AS block_id, count(*) AS n, array_to_string(list(id ORDER BY gpos), ' ') AS input_ids FROM g GROUP BY 1, 2),
bt AS (SELECT *, (row_number() OVER (ORDER BY group_id, block_id) - 1) // {BATCH} AS batch_id FROM blocks)
SELECT group_id, block_id, batch_id, input_ids, min(n) OVER (PARTITION BY batch_id) = max(n) OVER (PARTITION BY batch_id) AS uniform_length FROM bt""",
)
def collate_blocks_ids(spark: SparkSession, base: str) -> DataFrame:
    """Blocks with their ids; each group's short rest is kept, so some batches aren't uniform."""
    from preftable.operators.encode import encode_long, token_count

    docs = V.table(spark, base, "documents", spread=True).select("doc_id", "text")
    docs = docs.withColumn("group_id", F.floor(F.col("doc_id") / PACK_GROUP).cast("long"))
    lengths = docs.select("group_id", "doc_id", token_count(F.col("text"), with_bos=True).alias("n_ids"))
    docs = docs.join(S.row_starts(lengths, ["group_id"], "doc_id"), ["group_id", "doc_id"])
    toks = encode_long(docs, "text", V.document_vocab(spark, base), ["doc_id", "group_id", "__st", "__tot"], IDS, with_bos=True)
    blocks = S.pack_blocks_long(toks, ["group_id"], "doc_id", "pos", "id", BLOCK, keep_rest=True).drop("label_ids")
    c = C.collate_blocks(B.assign_batches(blocks, ["group_id", "block_id"], BATCH), "batch_id")
    return c.select("group_id", "block_id", "batch_id", ids_text(F.col("input_ids")).alias("input_ids"), "uniform_length")


# ---------------------------------------------------------------------------------------------
# Generated sequences: strip padding, join, response mask
# ---------------------------------------------------------------------------------------------


@register(
    "strip_and_join",
    f"""{_LEFT},
sj AS (SELECT example_id, batch_id,
              list_slice(pids, len(list_filter(pids, lambda x: x = 0)) + 1, len(pids)) AS prompt,
              list_slice(rids, 1, len(list_filter(rids, lambda x: x <> 0))) AS resp FROM lp),
sq AS (SELECT *, list_concat(prompt, resp) AS seq FROM sj),
sp AS (SELECT *, {Q.rpad('seq', 'max(len(seq)) OVER (PARTITION BY batch_id)', 0)} AS sids FROM sq)
SELECT example_id, batch_id, len(prompt) AS prompt_len, {Q.ids_text('sids')} AS sequence_ids,
       {Q.ids_text(_mask_sql('sids'))} AS sequence_mask,
       {Q.ids_text(f"list_transform({_mask_sql('sids')}, lambda m, i: CASE WHEN i - 1 < len(prompt) THEN 0 ELSE m END)")} AS response_mask
FROM sp""",
)
def strip_join(spark: SparkSession, base: str) -> DataFrame:
    left = _left_batched(spark, base)
    gen = left.withColumn("__m", F.max(F.size("tgt")).over(Window.partitionBy("batch_id")))
    gen = gen.select(
        "example_id", "batch_id", F.col("input_ids").alias("prompt_ids"), right_pad(F.col("tgt"), F.col("__m"), IDS.pad_id).alias("response_ids")
    )
    sj = strip_and_join(gen, "batch_id", "prompt_ids", "response_ids", IDS)
    sj = sj.withColumn("response_mask", response_mask(F.col("sequence_mask"), F.size("prompt_ids")))
    return sj.select(
        "example_id",
        "batch_id",
        F.size("prompt_ids").cast("long").alias("prompt_len"),
        *[ids_text(F.col(c)).alias(c) for c in ("sequence_ids", "sequence_mask", "response_mask")],
    )



@register(
    "response_mask",
    f"""{_LEFT},
sj AS (SELECT example_id, list_slice(pids, len(list_filter(pids, lambda x: x = 0)) + 1, len(pids)) AS prompt,
              list_slice(rids, 1, len(list_filter(rids, lambda x: x <> 0))) AS resp, batch_id FROM lp),
sp AS (SELECT *, {Q.rpad('list_concat(prompt, resp)', 'max(len(list_concat(prompt, resp))) OVER (PARTITION BY batch_id)', 0)} AS sids FROM sj)
SELECT example_id, len(prompt) AS prompt_len,
       {Q.ids_text(f"list_transform({_mask_sql('sids')}, lambda m, i: CASE WHEN i - 1 < len(prompt) THEN 0 ELSE m END)")} AS response_mask,
       CAST(len(list_filter({_mask_sql('sids')}, lambda m: m = 1)) - len(list_filter(prompt, lambda x: x <> 0)) AS BIGINT) AS n_response_tokens
FROM sp""",
)
def response_mask_q(spark: SparkSession, base: str) -> DataFrame:
    left = _left_batched(spark, base)
    gen = left.withColumn("__m", F.max(F.size("tgt")).over(Window.partitionBy("batch_id")))
    gen = gen.select(
        "example_id", "batch_id", F.col("input_ids").alias("prompt_ids"), right_pad(F.col("tgt"), F.col("__m"), IDS.pad_id).alias("response_ids")
    )
    sj = strip_and_join(gen, "batch_id", "prompt_ids", "response_ids", IDS)
    rm = response_mask(F.col("sequence_mask"), F.size("prompt_ids"))
    ones = F.size(F.filter(F.col("sequence_mask"), lambda m: m == 1))
    prompt_nonpad = F.size(F.filter(F.col("prompt_ids"), lambda x: x != IDS.pad_id))
    return sj.select(
        "example_id",
        F.size("prompt_ids").cast("long").alias("prompt_len"),
        ids_text(rm).alias("response_mask"),
        (ones - prompt_nonpad).cast("long").alias("n_response_tokens"),
    )


@register(
    "slice_response",
    f"""{_LEFT}
SELECT example_id, {Q.ids_text('rids')} AS response_ids FROM lp""",
)
def slice_response_q(spark: SparkSession, base: str) -> DataFrame:
    from preftable.operators.rollout import slice_response

    left = _left_batched(spark, base)
    w = Window.partitionBy("batch_id")
    # What a generator returns: the left-padded prompt block followed by right-padded responses.
    gen = left.withColumn("__m", F.max(F.size("tgt")).over(w)).select(
        "example_id",
        F.size("input_ids").alias("width"),
        F.concat(F.col("input_ids"), right_pad(F.col("tgt"), F.col("__m"), IDS.pad_id)).alias("sequences"),
    )
    return gen.select("example_id", ids_text(slice_response("sequences", "width")).alias("response_ids"))
