"""Record layouts and normalisation into prompt/response text (§2.2).

Three layouts are accepted: instruction ``{instruction, input, output}``, prompt
``{prompt, chosen}`` and preference ``{prompt, chosen, rejected}``. The layout is decided from the
columns that are present, per file when one directory mixes layouts. Rows that cannot be used are
not dropped silently: they carry a ``quarantine_reason`` and ``split_quarantine`` separates them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preftable.functions.text import (
    merge_instruction_input,
    pair_reason,
    pick_pair,
    pick_response,
    render_prompt,
    response_reason,
)

INSTRUCTION_COLUMNS = ("instruction", "input", "output")
PROMPT_COLUMNS = ("prompt", "chosen")
PREFERENCE_COLUMNS = ("prompt", "chosen", "rejected")
REASON = "quarantine_reason"


def validate_columns(df: DataFrame, layout: str) -> None:
    """Raise ``ValueError`` when a layout's required columns are missing."""
    required = {
        "instruction": INSTRUCTION_COLUMNS,
        "prompt": PROMPT_COLUMNS,
        "preference": PREFERENCE_COLUMNS,
    }[layout]
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{layout} layout needs columns {missing}; got {df.columns}")


def normalise_output(df: DataFrame) -> DataFrame:
    """Turn ``output`` (VARIANT, STRING or ARRAY<STRING>) into ``ARRAY<STRING>`` + ``output_is_scalar``."""
    if "output" not in df.columns:
        return df
    dtype = df.schema["output"].dataType.simpleString()
    if dtype == "variant":
        kind = F.schema_of_variant(F.col("output"))
        arr = (
            F.when(kind == "STRING", F.array(F.try_variant_get(F.col("output"), "$", "string")))
            .when(kind.startswith("ARRAY"), F.try_variant_get(F.col("output"), "$", "array<string>"))
        )
        return df.withColumn("output_is_scalar", F.coalesce(kind == "STRING", F.lit(False))).withColumn("output", arr)
    if dtype == "string":
        return df.withColumn("output_is_scalar", F.col("output").isNotNull()).withColumn(
            "output", F.when(F.col("output").isNotNull(), F.array(F.col("output")))
        )
    if "output_is_scalar" not in df.columns:
        df = df.withColumn("output_is_scalar", F.lit(False))
    return df


def detect_layout(df: DataFrame, task: str = "sft", file_col: str = "file") -> DataFrame:
    """Add ``layout``: ``instruction``, ``prompt`` (SFT/PPO) or ``preference`` (RM/DPO).

    With a single-layout schema the answer is a constant. A superset schema read from a mixed
    directory decides per file from which columns hold values in that file (every key column has
    to, so a file with ``chosen`` alone keeps the instruction layout): a one-row-per-file
    aggregate joined back on the file (no window over a possibly huge file).
    """
    pair_task = task in ("rm", "dpo")
    key = ("chosen", "rejected") if pair_task else ("prompt",)
    present = all(c in df.columns for c in key)
    if not present:
        return df.withColumn("layout", F.lit("instruction"))
    other = F.lit("preference" if pair_task else "prompt")
    has_key = reduce(Column.__and__, [F.col(c).isNotNull() for c in key])
    if "instruction" not in df.columns:
        return df.withColumn("layout", other)
    if file_col not in df.columns:
        # No file to group by: decide per row from the columns that hold values.
        return df.withColumn("layout", F.when(has_key, other).otherwise(F.lit("instruction")))
    in_file = [F.max(F.when(F.col(c).isNotNull(), 1).otherwise(0)) for c in key]
    flags = df.groupBy(file_col).agg((F.least(*in_file) if len(in_file) > 1 else in_file[0]).alias("__pt_has"))
    return (
        df.join(flags, file_col, "left")
        .withColumn("layout", F.when(F.col("__pt_has") == 1, other).otherwise(F.lit("instruction")))
        .drop("__pt_has")
    )


def _ensure(df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    for c in cols:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def to_sft_text(
    df: DataFrame,
    template: str = "default",
    task: str = "sft",
    compat: bool = False,
    keep: tuple[str, ...] = ("example_id",),
) -> DataFrame:
    """Instruction or prompt records → ``(keep…, prompt, response, quarantine_reason)``.

    ``prompt`` is rendered through ``template``. Instruction rows merge ``instruction`` and
    ``input``; prompt rows take ``chosen`` as the response.
    """
    if "layout" not in df.columns:
        df = detect_layout(df, task)
    df = normalise_output(_ensure(df, ("instruction", "input", "prompt", "chosen")))
    if "output" not in df.columns:
        df = df.withColumn("output", F.lit(None).cast("array<string>")).withColumn("output_is_scalar", F.lit(False))
    inst = F.col("layout") == "instruction"
    prompt = F.when(inst, merge_instruction_input(F.col("instruction"), F.col("input"))).otherwise(F.col("prompt"))
    response = F.when(inst, pick_response(F.col("output"), F.col("output_is_scalar"), compat)).otherwise(
        F.col("chosen")
    )
    reason = F.when(inst, response_reason(F.col("output"), F.col("output_is_scalar"))).otherwise(
        F.when(F.col("chosen").isNull(), F.lit("null chosen"))
    )
    reason = F.when(prompt.isNull(), F.lit("null prompt")).otherwise(reason)
    return df.select(
        *[c for c in keep if c in df.columns],
        render_prompt(prompt, template).alias("prompt"),
        response.alias("response"),
        reason.alias(REASON),
    )


def prompt_chosen_to_sft(df: DataFrame, template: str = "default", keep: tuple[str, ...] = ("example_id",)) -> DataFrame:
    """Prompt layout: the response is ``chosen``."""
    validate_columns(df, "prompt")
    return to_sft_text(df.withColumn("layout", F.lit("prompt")), template=template, keep=keep)


def to_pair_text(
    df: DataFrame,
    template: str = "default",
    compat: bool = False,
    keep: tuple[str, ...] = ("example_id",),
) -> DataFrame:
    """Instruction or preference records → ``(keep…, prompt, chosen, rejected, quarantine_reason)``."""
    if "layout" not in df.columns:
        df = detect_layout(df, "rm")
    df = normalise_output(_ensure(df, ("instruction", "input", "prompt", "chosen", "rejected")))
    if "output" not in df.columns:
        df = df.withColumn("output", F.lit(None).cast("array<string>")).withColumn("output_is_scalar", F.lit(False))
    inst = F.col("layout") == "instruction"
    c0, c1 = pick_pair(F.col("output"), F.col("output_is_scalar"), compat)
    prompt = F.when(inst, merge_instruction_input(F.col("instruction"), F.col("input"))).otherwise(F.col("prompt"))
    chosen = F.when(inst, c0).otherwise(F.col("chosen"))
    rejected = F.when(inst, c1).otherwise(F.col("rejected"))
    reason = F.when(inst, pair_reason(F.col("output"), F.col("output_is_scalar"), compat)).otherwise(
        F.when(F.col("chosen").isNull() | F.col("rejected").isNull(), F.lit("null chosen or rejected"))
    )
    reason = F.when(prompt.isNull(), F.lit("null prompt")).otherwise(reason)
    return df.select(
        *[c for c in keep if c in df.columns],
        render_prompt(prompt, template).alias("prompt"),
        chosen.alias("chosen"),
        rejected.alias("rejected"),
        reason.alias(REASON),
    )


def split_quarantine(df: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(usable rows without the reason column, quarantined rows). ``strict`` raises on any bad row."""
    bad = df.filter(F.col(REASON).isNotNull())
    if strict and bad.limit(1).count() > 0:
        reason = bad.select(REASON).first()[0]
        raise ValueError(f"record rejected: {reason}")
    return df.filter(F.col(REASON).isNull()).drop(REASON), bad
