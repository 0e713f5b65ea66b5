"""DuckDB SQL fragments that restate the fixture views and operators for the correctness oracle.

They are written from the operator definitions (not generated from the Spark plans), so a
mismatch points at a real difference. Floats are rounded to 6 decimals on both sides and ``+ 0.0``
turns ``-0.0`` into ``0.0``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from preftable.config import IGNORE_INDEX, template_parts

TOKEN_RE = "'[ \\n]+'"


def sql_lit(s: str) -> str:
    """A Python string as a DuckDB expression (newlines via ``chr(10)``)."""
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def render(expr: str, template: str = "default") -> str:
    prefix, suffix = template_parts(template)
    return f"({sql_lit(prefix)} || {expr} || {sql_lit(suffix)})"


def merge(instruction: str = "instruction", input_: str = "input") -> str:
    return (
        f"(CASE WHEN {input_} IS NOT NULL AND {input_} <> '' "
        f"THEN {instruction} || chr(10) || {input_} ELSE {instruction} END)"
    )


def rnd(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


def round6(col: Column) -> Column:
    """Report a double at 6 decimals the way ``rnd`` does in DuckDB: scale by 10^6, round half
    away from zero, scale back (``+ 0.0`` turns ``-0.0`` into ``0.0``). Rounding the shortest
    decimal form instead can differ within one ulp of a tie."""
    return F.round(col.cast("double") * F.lit(1e6), 0) / F.lit(1e6) + F.lit(0.0)


def ids_text(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


def rep(value: int, n: str) -> str:
    """``array_repeat(value, n)`` as a DuckDB list."""
    return f"list_transform(range(greatest({n}, 0)), lambda _x: {value})"


def seq_sft(src: str, tgt: str, bos: int = 1, eos: int = 2) -> str:
    return f"list_concat(list_concat({src}, [{bos}]), list_concat({tgt}, [{eos}]))"


def seq_labels(src: str, tgt: str, bos: int = 1, eos: int = 2) -> str:
    return f"list_concat(list_concat({rep(IGNORE_INDEX, f'len({src})')}, [{bos}]), list_concat({tgt}, [{eos}]))"


def trunc(expr: str, n: int) -> str:
    return f"list_slice({expr}, 1, {n - 1})"


def rpad(expr: str, m: str, value: int) -> str:
    return f"list_concat({expr}, {rep(value, f'{m} - len({expr})')})"


def lpad(expr: str, m: str, value: int) -> str:
    return f"list_concat({rep(value, f'{m} - len({expr})')}, {expr})"


INSTRUCTION_CTE = """inst AS (
  SELECT conv_id * 100 + turn AS example_id, text AS instruction, coalesce(sys_text, '') AS input,
         next_text AS response
  FROM (SELECT conv_id, turn, role, text,
               lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
               lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text,
               max(CASE WHEN role = 'system' THEN text END) OVER (PARTITION BY conv_id) AS sys_text
        FROM conversations) c
  WHERE role = 'user' AND next_role = 'assistant')"""


def sft_cte(template: str = "default") -> str:
    return f"""sft AS (
  SELECT example_id, {render(merge(), template)} AS prompt, response FROM inst)"""


VOCAB_CTE = f"""vocab AS (
  SELECT token, cnt AS count, CAST(row_number() OVER (ORDER BY cnt DESC, token) + 2 AS INTEGER) AS id
  FROM (SELECT t.token, count(*) AS cnt
        FROM documents d, unnest(regexp_split_to_array(d.text, {TOKEN_RE})) AS t(token)
        WHERE t.token <> '' GROUP BY t.token) x)"""


def encode_cte(name: str, src: str, key: str, text: str) -> str:
    """``name(key, ids)``: tokens looked up in ``vocab``; unknown → 0."""
    return f"""{name} AS (
  SELECT s.{key} AS {key},
         coalesce(list(coalesce(v.id, 0) ORDER BY t.pos) FILTER (WHERE t.token <> ''), []::INTEGER[]) AS ids
  FROM {src} s, unnest(regexp_split_to_array(s.{text}, {TOKEN_RE})) WITH ORDINALITY AS t(token, pos)
  LEFT JOIN vocab v ON v.token = t.token
  GROUP BY s.{key})"""


PREFERENCE_CTE = """lab AS (
  SELECT d.doc_id, d.text, d.lang, l.quality,
         row_number() OVER (PARTITION BY d.lang, l.quality ORDER BY d.doc_id) - 1 AS rn
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IN (0, 1)),
dealt AS (SELECT lang, count(*) AS n FROM lab WHERE quality = 0 GROUP BY lang),
pairs AS (
  SELECT c.doc_id AS example_id, 'Write in ' || c.lang AS prompt, c.text AS chosen, r.text AS rejected,
         r.doc_id AS rejected_doc_id, c.lang AS lang
  FROM lab c JOIN dealt ON dealt.lang = c.lang
  JOIN lab r ON c.lang = r.lang AND c.rn % dealt.n = r.rn AND c.quality = 1 AND r.quality = 0)"""

# Per-token score rows: t = 0..T-2 of each sequence, with the shifted response mask ms = mask[t+1].
SCORES_CTE = """ev AS (
  SELECT user_id AS seq, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
         count(*) OVER (PARTITION BY user_id) AS T,
         -((event_id * 37 + 11) % 1000) / 250.0 AS actor,
         -((event_id * 53 + 29) % 1000) / 250.0 AS ref,
         -((event_id * 37 + 11) % 1000) / 250.0 + ((event_id % 21) - 10) / 50.0 AS new,
         ((event_id * 17) % 200 - 100) / 100.0 AS value,
         ((event_id * 17) % 200 - 100) / 100.0 + ((event_id % 9) - 4) / 10.0 AS new_value,
         ((user_id * 13) % 41 - 20) / 10.0 AS reward,
         user_id // 8 AS batch_id
  FROM events),
tok AS (
  SELECT *, CASE WHEN pos + 1 < 8 THEN 0 ELSE 1 END AS ms FROM ev WHERE pos < T - 1)"""


def penalty_expr(method: str | None, beta: float) -> str:
    k = "(actor - ref)"
    if method == "abs":
        k = f"abs{k}"
    elif method == "mse":
        k = f"({k} * {k} * 0.5)"
    return f"(-{beta} * {k})"


def gae_ctes(method: str | None = "abs", beta: float = 0.1, gamma: float = 1.0, lam: float = 0.95, clip: float | None = None) -> str:
    """``rk``: penalised, masked rewards and masked values; ``adv``: advantages and returns.

    Advantages follow the backward recursion ``A_t = δ_t + γλ·A_{t+1}`` (a recursive CTE; the
    enclosing ``WITH`` must be ``WITH RECURSIVE``).
    """
    reward = "reward" if clip is None else f"greatest(-{clip}, least({clip}, reward))"
    c = gamma * lam
    return f"""rk AS (
  SELECT *, {penalty_expr(method, beta)} AS pen,
         ({penalty_expr(method, beta)} + CASE WHEN pos = T - 2 THEN {reward} ELSE 0 END) AS rkl_raw,
         ({penalty_expr(method, beta)} + CASE WHEN pos = T - 2 THEN {reward} ELSE 0 END) * ms AS rkl,
         value * ms AS v, {reward} AS score
  FROM tok),
dl AS (
  SELECT *, rkl + {gamma} * coalesce(lead(v) OVER (PARTITION BY seq ORDER BY pos), 0) - v AS delta FROM rk),
rec(seq, pos, a) AS (
  SELECT seq, pos, delta FROM dl WHERE pos = T - 2
  UNION ALL
  SELECT d.seq, d.pos, d.delta + {c} * rec.a FROM rec JOIN dl d ON d.seq = rec.seq AND d.pos = rec.pos - 1),
adv AS (SELECT dl.*, rec.a FROM dl JOIN rec ON dl.seq = rec.seq AND dl.pos = rec.pos),
ret AS (SELECT *, a + v AS r FROM adv)"""
