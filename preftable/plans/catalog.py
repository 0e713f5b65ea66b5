"""Registered queries: a Spark plan per operator over the fixture tables, and its DuckDB oracle.

Every query reads the whole fixture tables (no id subsets, no row caps). Id arrays are rendered
as space-separated text and float arrays are exploded to ``(key, pos, value)`` rows, so both
engines produce plain scalar columns that compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from preftable.config import PROMPT_TEMPLATES, SpecialIds
from preftable.functions.arrays import ids_text
from preftable.operators import batching as B
from preftable.operators import sequences as S
from preftable.operators.encode import encode, encode_long, encode_with_specials, token_count
from preftable.operators.normalise import prompt_chosen_to_sft, split_quarantine, to_pair_text, to_sft_text
from preftable.plans import oracle as Q
from preftable.plans import views as V

IDS = SpecialIds()
TEMPLATE = "default"
MAX_PROMPT = 256
MAX_RESPONSE = 256
BLOCK = 256
PACK_GROUP = 1000
SPLIT_RATIO = 0.05
SEED = 42

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def _r(col):
    return Q.round6(col)


# ---------------------------------------------------------------------------------------------
# Normalisation and templates
# ---------------------------------------------------------------------------------------------


def sft_text(spark: SparkSession, base: str, template: str = TEMPLATE) -> DataFrame:
    ok, _ = split_quarantine(to_sft_text(V.instruction_rows(spark, base), template=template))
    return ok


register(
    "sft_text",
    f"""WITH {Q.INSTRUCTION_CTE}, {Q.sft_cte()}
SELECT example_id, prompt, response FROM sft""",
)(sft_text)


@register(
    "prompt_templates",
    f"""WITH {Q.INSTRUCTION_CTE}
"""
    + "\nUNION ALL\n".join(
        f"SELECT example_id, '{name}' AS template, {Q.render(Q.merge(), name)} AS prompt FROM inst"
        for name in PROMPT_TEMPLATES
    ),
)
def prompt_templates(spark: SparkSession, base: str) -> DataFrame:
    from preftable.functions.text import merge_instruction_input, render_prompt

    inst = V.instruction_rows(spark, base)
    merged = merge_instruction_input(F.col("instruction"), F.col("input"))
    # One pass over the records; the three renderings are stacked with explode (no union of scans).
    rendered = F.array(
        *[F.struct(F.lit(name).alias("template"), render_prompt(merged, name).alias("prompt")) for name in PROMPT_TEMPLATES]
    )
    return inst.select("example_id", F.inline(rendered))


@register(
    "prompt_chosen_sft",
    f"""WITH {Q.INSTRUCTION_CTE}
SELECT example_id, {Q.render('instruction')} AS prompt, response FROM inst""",
)
def prompt_chosen_sft(spark: SparkSession, base: str) -> DataFrame:
    ok, _ = split_quarantine(prompt_chosen_to_sft(V.prompt_rows(spark, base), template=TEMPLATE))
    return ok


# ---------------------------------------------------------------------------------------------
# Vocabulary and encoding
# ---------------------------------------------------------------------------------------------


@register("vocab", f"WITH {Q.VOCAB_CTE} SELECT token, count, id FROM vocab")
def vocab(spark: SparkSession, base: str) -> DataFrame:
    return V.document_vocab(spark, base)


@register(
    "encode_docs",
    f"""WITH {Q.VOCAB_CTE}, {Q.encode_cte('enc', 'documents', 'doc_id', 'text')}
SELECT doc_id, len(ids) AS n_ids, {Q.ids_text('ids')} AS ids FROM enc""",
)
def encode_docs(spark: SparkSession, base: str) -> DataFrame:
    docs = V.table(spark, base, "documents", spread=True).select("doc_id", "text")
    enc = encode(docs, "text", V.document_vocab(spark, base), ["doc_id"], IDS)
    return enc.select("doc_id", F.size("text_ids").cast("long").alias("n_ids"), ids_text(F.col("text_ids")).alias("ids"))


@register(
    "encode_with_specials",
    f"""WITH {Q.VOCAB_CTE}, {Q.encode_cte('enc', 'documents', 'doc_id', 'text')}
SELECT doc_id, {Q.ids_text('list_concat([1], ids)')} AS ids FROM enc""",
)
def encode_specials(spark: SparkSession, base: str) -> DataFrame:
    docs = V.table(spark, base, "documents", spread=True).select("doc_id", "text")
    enc = encode_with_specials(docs, "text", V.document_vocab(spark, base), ["doc_id"], IDS, out="ids")
    return enc.select("doc_id", ids_text(F.col("ids")).alias("ids"))


def _sft_encoded(spark: SparkSession, base: str) -> DataFrame:
    text = sft_text(spark, base)
    limits = {"prompt": MAX_PROMPT - 1, "response": MAX_RESPONSE - 1}
    return encode(text, ["prompt", "response"], V.document_vocab(spark, base), ["example_id"], IDS, max_ids=limits)


_SFT_ENC = f"""WITH {Q.INSTRUCTION_CTE}, {Q.sft_cte()}, {Q.VOCAB_CTE},
{Q.encode_cte('pe', 'sft', 'example_id', 'prompt')},
{Q.encode_cte('re', 'sft', 'example_id', 'response')},
enc AS (SELECT pe.example_id, {Q.trunc('pe.ids', MAX_PROMPT)} AS src, {Q.trunc('re.ids', MAX_RESPONSE)} AS tgt
        FROM pe JOIN re ON pe.example_id = re.example_id)"""


@register(
    "sft_sequences",
    f"""{_SFT_ENC}
SELECT example_id, {Q.ids_text(Q.seq_sft('src', 'tgt'))} AS input_ids,
       {Q.ids_text(Q.seq_labels('src', 'tgt'))} AS label_ids,
       len(src) + len(tgt) + 2 AS n_ids
FROM enc""",
)
def sft_sequences(spark: SparkSession, base: str) -> DataFrame:
    seqs = S.build_sft_sequences(
        _sft_encoded(spark, base), "prompt_ids", "response_ids", IDS, MAX_PROMPT, MAX_RESPONSE
    )
    return seqs.select(
        "example_id",
        ids_text(F.col("input_ids")).alias("input_ids"),
        ids_text(F.col("label_ids")).alias("label_ids"),
        F.size("input_ids").cast("long").alias("n_ids"),
    )


@register(
    "ppo_prompts",
    f"""{_SFT_ENC}
SELECT example_id, {Q.ids_text("list_concat(src, [1])")} AS input_ids,
       {Q.ids_text("list_concat(tgt, [1])")} AS label_ids
FROM enc""",
)
def ppo_prompts(spark: SparkSession, base: str) -> DataFrame:
    p = S.build_ppo_prompts(_sft_encoded(spark, base), "prompt_ids", "response_ids", IDS, MAX_PROMPT, MAX_RESPONSE)
    return p.select(
        "example_id", ids_text(F.col("input_ids")).alias("input_ids"), ids_text(F.col("label_ids")).alias("label_ids")
    )


# ---------------------------------------------------------------------------------------------
# Preference pairs
# ---------------------------------------------------------------------------------------------


def pair_text(spark: SparkSession, base: str) -> DataFrame:
    ok, _ = split_quarantine(
        to_pair_text(V.preference_rows(spark, base).withColumn("layout", F.lit("preference")), template=TEMPLATE)
    )
    return ok


register(
    "pair_text",
    f"""WITH {Q.PREFERENCE_CTE}
SELECT example_id, {Q.render('prompt')} AS prompt, chosen, rejected FROM pairs""",
)(pair_text)


def _pair_sequences(spark: SparkSession, base: str) -> DataFrame:
    limits = {"prompt": MAX_PROMPT - 1, "chosen": MAX_RESPONSE - 1, "rejected": MAX_RESPONSE - 1}
    enc = encode(
        pair_text(spark, base), ["prompt", "chosen", "rejected"], V.document_vocab(spark, base), ["example_id"], IDS, max_ids=limits
    )
    seqs = S.build_pair_sequences(enc, "prompt_ids", "chosen_ids", "rejected_ids", IDS, MAX_PROMPT, MAX_RESPONSE)
    return S.pad_pair(seqs, IDS)


_PAIR_ENC = f"""WITH {Q.PREFERENCE_CTE}, {Q.VOCAB_CTE},
pt AS (SELECT example_id, {Q.render('prompt')} AS prompt, chosen, rejected FROM pairs),
{Q.encode_cte('pe', 'pt', 'example_id', 'prompt')},
{Q.encode_cte('ce', 'pt', 'example_id', 'chosen')},
{Q.encode_cte('re', 'pt', 'example_id', 'rejected')},
enc AS (SELECT pe.example_id, {Q.trunc('pe.ids', MAX_PROMPT)} AS src, {Q.trunc('ce.ids', MAX_RESPONSE)} AS acc,
               {Q.trunc('re.ids', MAX_RESPONSE)} AS rej
        FROM pe JOIN ce ON pe.example_id = ce.example_id JOIN re ON pe.example_id = re.example_id),
sq AS (SELECT example_id, {Q.seq_sft('src', 'acc')} AS a_ids, {Q.seq_labels('src', 'acc')} AS a_lab,
              {Q.seq_sft('src', 'rej')} AS r_ids, {Q.seq_labels('src', 'rej')} AS r_lab FROM enc),
pp AS (SELECT example_id, greatest(len(a_ids), len(r_ids)) AS m, a_ids, a_lab, r_ids, r_lab FROM sq),
padded AS (SELECT example_id, {Q.rpad('a_ids', 'm', 0)} AS accepts_ids, {Q.rpad('a_lab', 'm', -100)} AS accepts_labels,
                  {Q.rpad('r_ids', 'm', 0)} AS rejects_ids, {Q.rpad('r_lab', 'm', -100)} AS rejects_labels FROM pp)"""


@register(
    "pair_sequences",
    f"""{_PAIR_ENC}
SELECT example_id, {Q.ids_text('accepts_ids')} AS accepts_ids, {Q.ids_text('accepts_labels')} AS accepts_labels,
       {Q.ids_text('rejects_ids')} AS rejects_ids, {Q.ids_text('rejects_labels')} AS rejects_labels
FROM padded""",
)
def pair_sequences(spark: SparkSession, base: str) -> DataFrame:
    p = _pair_sequences(spark, base)
    return p.select(
        "example_id", *[ids_text(F.col(c)).alias(c) for c in ("accepts_ids", "accepts_labels", "rejects_ids", "rejects_labels")]
    )


@register(
    "pair_flat",
    f"""{_PAIR_ENC}
SELECT example_id, {Q.ids_text('list_concat(accepts_ids, rejects_ids)')} AS input_ids,
       {Q.ids_text('list_concat(accepts_labels, rejects_labels)')} AS label_ids,
       len(accepts_ids) * 2 AS n_flat, true AS round_trip
FROM padded""",
)
def pair_flat(spark: SparkSession, base: str) -> DataFrame:
    p = _pair_sequences(spark, base)
    flat = S.flatten_pairs(p, keep=("example_id", "accepts_ids", "accepts_labels", "rejects_ids", "rejects_labels"))
    back = S.unflatten_pairs(
        flat.select(
            "example_id",
            "input_ids",
            "label_ids",
            *[F.col(c).alias(f"o_{c}") for c in ("accepts_ids", "accepts_labels", "rejects_ids", "rejects_labels")],
        ),
        keep=("example_id", "input_ids", "label_ids", "o_accepts_ids", "o_accepts_labels", "o_rejects_ids", "o_rejects_labels"),
    )
    # Round trip checked inside each row: no self-join, the pair encoding runs once.
    same = F.lit(True)
    for c in ("accepts_ids", "accepts_labels", "rejects_ids", "rejects_labels"):
        same = same & (F.col(c) == F.col(f"o_{c}"))
    return back.select(
        "example_id",
        ids_text(F.col("input_ids")).alias("input_ids"),
        ids_text(F.col("label_ids")).alias("label_ids"),
        F.size("input_ids").cast("long").alias("n_flat"),
        same.alias("round_trip"),
    )


# ---------------------------------------------------------------------------------------------
# Packing and splitting
# ---------------------------------------------------------------------------------------------


@register(
    "pt_blocks",
    f"""WITH {Q.VOCAB_CTE}, {Q.encode_cte('enc', 'documents', 'doc_id', 'text')},
toks AS (
  SELECT e.doc_id // {PACK_GROUP} AS group_id, e.doc_id, u.id, u.k
  FROM enc e, unnest(list_concat([1], e.ids)) WITH ORDINALITY AS u(id, k)),
g AS (
  SELECT group_id, id,
         row_number() OVER (PARTITION BY group_id ORDER BY doc_id, k) - 1 AS gpos,
         count(*) OVER (PARTITION BY group_id) AS tot
  FROM toks),
kept AS (
  SELECT group_id, gpos // {BLOCK} AS block_id, gpos, id FROM g
  WHERE tot < {BLOCK} OR gpos < (tot // {BLOCK}) * {BLOCK})
SELECT group_id, block_id, count(*) AS n_ids, array_to_string(list(id ORDER BY gpos), ' ') AS input_ids
FROM kept GROUP BY group_id, block_id""",
)
def pt_blocks(spark: SparkSession, base: str) -> DataFrame:
    docs = V.table(spark, base, "documents", spread=True).select("doc_id", "text")
    enc = encode_with_specials(docs, "text", V.document_vocab(spark, base), ["doc_id"], IDS, out="input_ids")
    enc = enc.withColumn("group_id", F.floor(F.col("doc_id") / PACK_GROUP).cast("long"))
    blocks = S.pack_blocks(enc, ["group_id"], "doc_id", "input_ids", BLOCK)
    return blocks.select(
        "group_id", "block_id", F.size("input_ids").cast("long").alias("n_ids"), ids_text(F.col("input_ids")).alias("input_ids")
    )


@register("pt_blocks_long", ORACLES["pt_blocks"])
def pt_blocks_long(spark: SparkSession, base: str) -> DataFrame:
    docs = V.table(spark, base, "documents", spread=True).select("doc_id", "text")
    docs = docs.withColumn("group_id", F.floor(F.col("doc_id") / PACK_GROUP).cast("long"))
    lengths = docs.select("group_id", "doc_id", token_count(F.col("text"), with_bos=True).alias("n_ids"))
    docs = docs.join(S.row_starts(lengths, ["group_id"], "doc_id"), ["group_id", "doc_id"])
    toks = encode_long(docs, "text", V.document_vocab(spark, base), ["doc_id", "group_id", "__st", "__tot"], IDS, with_bos=True)
    blocks = S.pack_blocks_long(toks, ["group_id"], "doc_id", "pos", "id", BLOCK)
    return blocks.select(
        "group_id", "block_id", F.size("input_ids").cast("long").alias("n_ids"), ids_text(F.col("input_ids")).alias("input_ids")
    )


_SPLIT_UNIT = f"(('0x' || substr(md5('{SEED}:' || doc_id), 1, 8))::BIGINT / 4294967296.0)"


@register(
    "split_rows",
    f"""SELECT doc_id, CASE WHEN {_SPLIT_UNIT} < {SPLIT_RATIO} THEN 'test' ELSE 'train' END AS split FROM documents""",
)
def split_rows(spark: SparkSession, base: str) -> DataFrame:
    docs = V.table(spark, base, "documents").select("doc_id")
    return B.train_test_split(docs, "doc_id", SPLIT_RATIO, SEED)


@register(
    "split_counts",
    f"""SELECT CASE WHEN {_SPLIT_UNIT} < {SPLIT_RATIO} THEN 'test' ELSE 'train' END AS split, count(*) AS n
FROM documents GROUP BY 1""",
)
def split_counts(spark: SparkSession, base: str) -> DataFrame:
    return split_rows(spark, base).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register(
    "split_exact",
    f"""SELECT CASE WHEN row_number() OVER (ORDER BY {_SPLIT_UNIT}, doc_id) - 1 < ceil(count(*) OVER () * {SPLIT_RATIO})
            THEN 'test' ELSE 'train' END AS split, doc_id FROM documents""",
)
def split_exact(spark: SparkSession, base: str) -> DataFrame:
    docs = V.table(spark, base, "documents").select("doc_id")
    return B.train_test_split(docs, "doc_id", SPLIT_RATIO, SEED, exact=True).select("split", "doc_id")
