"""Record normalisation column functions (§2.2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from preftable.config import template_parts


def merge_instruction_input(instruction: Column, input_: Column) -> Column:
    """``instruction + '\\n' + input`` when input is neither null nor empty, else ``instruction``."""
    return F.when(
        input_.isNotNull() & (input_ != F.lit("")),
        F.concat(instruction, F.lit("\n"), input_),
    ).otherwise(instruction)


def pick_response(output: Column, output_is_scalar: Column, compat: bool = False) -> Column:
    """Response of an instruction record.

    ``output`` is ``ARRAY<STRING>``; a scalar string arrives as a one-element array with
    ``output_is_scalar`` true. Default: scalar -> the string, list -> element 0, empty -> NULL.
    ``compat=True``: a scalar longer than one character yields its first character.
    """
    first = F.get(output, 0)
    if compat:
        scalar = F.when(F.length(first) > 1, F.substring(first, 1, 1)).otherwise(first)
        return F.when(output_is_scalar, scalar).otherwise(first)
    return first


def response_reason(output: Column, output_is_scalar: Column) -> Column:
    """Quarantine reason for SFT/PPO records (NULL when the record is usable)."""
    return (
        F.when(output.isNull(), F.lit("missing output"))
        .when(~output_is_scalar & (F.size(output) == 0), F.lit("empty output list"))
        .when(F.get(output, 0).isNull(), F.lit("null response"))
    )


def pick_pair(output: Column, output_is_scalar: Column, compat: bool = False) -> tuple[Column, Column]:
    """(chosen, rejected) = elements 0 and 1; ``compat`` lets a scalar yield characters 0 and 1."""
    if compat:
        s = F.get(output, 0)
        chosen = F.when(output_is_scalar, F.substring(s, 1, 1)).otherwise(F.get(output, 0))
        rejected = F.when(output_is_scalar, F.substring(s, 2, 1)).otherwise(F.get(output, 1))
        return chosen, rejected
    return F.get(output, 0), F.get(output, 1)


def pair_reason(output: Column, output_is_scalar: Column, compat: bool = False) -> Column:
    """Quarantine reason for RM/DPO records: the output must hold at least two responses."""
    if compat:
        length = F.when(output_is_scalar, F.length(F.get(output, 0))).otherwise(F.size(output))
        return F.when(output.isNull(), F.lit("missing output")).when(length <= 1, F.lit("fewer than 2 responses"))
    return (
        F.when(output.isNull(), F.lit("missing output"))
        .when(output_is_scalar, F.lit("scalar output"))
        .when(F.size(output) <= 1, F.lit("fewer than 2 responses"))
    )


def render_prompt(prompt: Column, template: str = "default") -> Column:
    """Insert ``prompt`` into a named template. Plain concatenation: braces in the text stay as is."""
    prefix, suffix = template_parts(template)
    return F.concat(F.lit(prefix), prompt, F.lit(suffix))
