"""Registered queries for record edge cases, sinks and per-row masked statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from preftable.functions import rollout as R
from preftable.operators import batching as B
from preftable.operators.normalise import normalise_output, split_quarantine, to_pair_text, to_sft_text
from preftable.plans import oracle as Q
from preftable.plans import views as V
from preftable.plans.catalog import SEED, SPLIT_RATIO, TEMPLATE, register
from preftable.plans.catalog_scores import _TOK, _experience
from preftable.session import scratch_table_path
from preftable.sources.readers import RAW_SCHEMA, read_split_files
from preftable.sources.sinks import write_rollouts


def followup_rows(spark: SparkSession, base: str) -> DataFrame:
    """Every user turn with ``output`` = its next two assistant replies, as far as they exist.

    Roles alternate, so the replies sit at ``turn + 1`` and ``turn + 3``; both are fetched with
    equi-joins on the unique key ``(conv_id, turn)``. A user turn without a reply gets an empty
    list and one with a single reply a one-element list (both end in quarantine for pairs).
    """
    x = V.conversation_neighbours(spark, base, (1, 3))
    first = F.when(F.col("role_1") == "assistant", F.col("text_1"))
    second = F.when(first.isNotNull() & (F.col("role_3") == "assistant"), F.col("text_3"))
    return x.filter(F.col("role") == "user").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("example_id"),
        F.col("text").alias("instruction"),
        F.coalesce(F.col("sys_text"), F.lit("")).alias("input"),
        F.filter(F.array(first, second), lambda t: t.isNotNull()).alias("output"),
        F.lit(False).alias("output_is_scalar"),
    )


_FOLLOWUP_CTE = """fu AS (
  SELECT c.conv_id * 100 + c.turn AS example_id, c.text AS instruction, coalesce(s.sys_text, '') AS input,
         CASE WHEN n1.role = 'assistant' AND n3.role = 'assistant' THEN [n1.text, n3.text]
              WHEN n1.role = 'assistant' THEN [n1.text] ELSE []::VARCHAR[] END AS outs
  FROM conversations c
  LEFT JOIN conversations n1 ON n1.conv_id = c.conv_id AND n1.turn = c.turn + 1
  LEFT JOIN conversations n3 ON n3.conv_id = c.conv_id AND n3.turn = c.turn + 3
  LEFT JOIN (SELECT conv_id, max(text) AS sys_text FROM conversations WHERE role = 'system' GROUP BY conv_id) s
    ON s.conv_id = c.conv_id
  WHERE c.role = 'user')"""


@register(
    "quarantine_reasons",
    f"""WITH {_FOLLOWUP_CTE}
SELECT 'sft' AS task, CASE WHEN len(outs) = 0 THEN 'empty output list' ELSE 'ok' END AS reason, count(*) AS n FROM fu GROUP BY 1, 2
UNION ALL
SELECT 'pair' AS task, CASE WHEN len(outs) <= 1 THEN 'fewer than 2 responses' ELSE 'ok' END AS reason, count(*) AS n FROM fu GROUP BY 1, 2""",
)
def quarantine_reasons(spark: SparkSession, base: str) -> DataFrame:
    from preftable.functions.text import pair_reason, response_reason

    rows = followup_rows(spark, base)
    out, scalar = F.col("output"), F.col("output_is_scalar")
    # Both tasks' reasons come from one pass over the records, stacked with explode.
    reasons = F.array(
        F.struct(F.lit("sft").alias("task"), response_reason(out, scalar).alias("r")),
        F.struct(F.lit("pair").alias("task"), pair_reason(out, scalar).alias("r")),
    )
    both = rows.select(F.inline(reasons)).withColumn("reason", F.coalesce(F.col("r"), F.lit("ok")))
    return both.groupBy("task", "reason").agg(F.count(F.lit(1)).alias("n"))


@register(
    "pair_from_followups",
    f"""WITH {_FOLLOWUP_CTE}
SELECT example_id, {Q.render(Q.merge())} AS prompt, outs[1] AS chosen, outs[2] AS rejected FROM fu WHERE len(outs) > 1""",
)
def pair_from_followups(spark: SparkSession, base: str) -> DataFrame:
    ok, _ = split_quarantine(to_pair_text(followup_rows(spark, base), template=TEMPLATE))
    return ok


@register(
    "sft_text_compat",
    f"""WITH {Q.INSTRUCTION_CTE}
SELECT example_id, CASE WHEN length(response) > 1 THEN substr(response, 1, 1) ELSE response END AS response_compat,
       response AS response_default FROM inst""",
)
def sft_text_compat(spark: SparkSession, base: str) -> DataFrame:
    from preftable.functions.text import pick_response

    # Scalar (string) outputs: the reference yields the first character of a longer string.
    inst = V.instruction_rows(spark, base).select("example_id", F.get(F.col("output"), 0).alias("output"))
    norm = normalise_output(inst)
    out, scalar = F.col("output"), F.col("output_is_scalar")
    return norm.select(
        "example_id",
        pick_response(out, scalar, compat=True).alias("response_compat"),
        pick_response(out, scalar).alias("response_default"),
    )


@register(
    "rollout_buffers",
    f"""{_TOK},
per_seq AS (SELECT seq, any_value(batch_id) // 2 AS buffer_id, any_value(reward) AS reward, count(*) AS n_tok FROM tok GROUP BY seq)
SELECT buffer_id, count(*) AS n_seqs, {Q.rnd('sum(reward)')} AS reward_sum, CAST(sum(n_tok) AS BIGINT) AS n_tokens FROM per_seq GROUP BY 1""",
)
def rollout_buffers(spark: SparkSession, base: str) -> DataFrame:
    exp = _experience(spark, base).withColumn("buffer_id", F.floor(F.col("batch_id") / 2).cast("long"))
    path = scratch_table_path(spark, f"rollouts-{uuid.uuid4().hex}")
    write_rollouts(exp.select("buffer_id", "seq", "reward_score", "advantages"), path, mode="overwrite")
    back = spark.read.parquet(path).filter(F.col("buffer_id") >= 0)  # partition filter: pruned by buffer
    return back.groupBy(F.col("buffer_id").cast("long").alias("buffer_id")).agg(
        F.count(F.lit(1)).alias("n_seqs"),
        Q.round6(F.sum("reward_score")).alias("reward_sum"),
        F.sum(F.size("advantages")).cast("long").alias("n_tokens"),
    )


_SPLIT_SQL = f"CASE WHEN (('0x' || substr(md5('{SEED}:' || example_id), 1, 8))::BIGINT / 4294967296.0) < {SPLIT_RATIO} THEN 'test' ELSE 'train' END"


@register(
    "split_files_round_trip",
    f"""WITH {Q.INSTRUCTION_CTE}
SELECT {_SPLIT_SQL} AS split, count(*) AS n_rows, count(DISTINCT {Q.render(Q.merge())}) AS n_prompts FROM inst GROUP BY 1""",
)
def split_files_round_trip(spark: SparkSession, base: str) -> DataFrame:
    rows = B.train_test_split(V.instruction_rows(spark, base), "example_id", SPLIT_RATIO, SEED)
    root = scratch_table_path(spark, f"split-files-{uuid.uuid4().hex}")
    cols = ["example_id", "instruction", "input", "output"]
    rows.filter(F.col("split") == "train").select(*cols).write.json(f"{root}/train")
    rows.filter(F.col("split") == "test").select(*cols).write.json(f"{root}/valid")
    back = read_split_files(spark, f"{root}/train", f"{root}/valid", RAW_SCHEMA + ", example_id BIGINT")
    text = to_sft_text(back.drop("prompt", "chosen", "rejected"), template=TEMPLATE, keep=("example_id", "split"))
    ok, _ = split_quarantine(text)
    return ok.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("prompt").alias("n_prompts"))


@register(
    "masked_stats_row",
    f"""{_TOK}, {Q.gae_ctes('abs', 0.1, 1.0, 0.95)},
m AS (SELECT seq, sum(a * ms) / (sum(ms) + 1e-8) AS mean FROM ret GROUP BY seq)
SELECT ret.seq, {Q.rnd('any_value(m.mean)')} AS adv_mean,
       {Q.rnd('sum(ret.ms * (ret.a - m.mean) * (ret.a - m.mean)) / (sum(ret.ms) + 1e-8)')} AS adv_var
FROM ret JOIN m ON ret.seq = m.seq GROUP BY ret.seq""",
)
def masked_stats_row(spark: SparkSession, base: str) -> DataFrame:
    exp = _experience(spark, base)
    return exp.select(
        F.col("seq").cast("long").alias("seq"),
        Q.round6(R.masked_mean(F.col("advantages"), F.col("ms"))).alias("adv_mean"),
        Q.round6(R.masked_var(F.col("advantages"), F.col("ms"))).alias("adv_var"),
    )
