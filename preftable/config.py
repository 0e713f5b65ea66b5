"""Constants, prompt templates and option dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# ---------------------------------------------------------------------------
# Label id that loss functions ignore.
IGNORE_INDEX = -100
# Epsilon added to the mask count in masked means.
MASKED_MEAN_EPS = 1e-8
# Epsilon added to the variance before the reciprocal square root in whitening.
WHITEN_EPS = 1e-6
# Prompt templates; ``{instruction}`` is the single slot.
PROMPT_TEMPLATES = {
    "chinese_llama_alpaca": (
        "Below is an instruction that describes a task. "
        "Write a response that appropriately completes the request.\n\n"
        "### Instruction:\n{instruction}\n\n### Response: "
    ),
    "chinese_llama2_alpaca": (
        "[INST] <<SYS>>\n"
        "You are a helpful assistant. 你是一个乐于助人的助手。\n"
        "<</SYS>>\n\n{instruction} [/INST]"
    ),
    "default": "Human: {instruction}\nAssistant: ",
}
# ---------------------------------------------------------------------------

TEMPLATE_SLOT = "{instruction}"

# Token pattern used by the vocabulary encoder (kept identical in the DuckDB oracles).
TOKEN_PATTERN = "[ \n]+"


def template_parts(name: str) -> tuple[str, str]:
    """Split a named template into (prefix, suffix) around its single slot."""
    if name not in PROMPT_TEMPLATES:
        raise ValueError(f"unknown template {name!r}; choose one of {sorted(PROMPT_TEMPLATES)}")
    prefix, suffix = PROMPT_TEMPLATES[name].split(TEMPLATE_SLOT)
    return prefix, suffix


@dataclass(frozen=True)
class SpecialIds:
    """Special token ids. ``pad`` defaults to 0, which is also the unknown token."""

    bos: int = 1
    eos: int = 2
    pad: int | None = None
    unk: int = 0

    @property
    def pad_id(self) -> int:
        return self.unk if self.pad is None else self.pad

    @property
    def first_free_id(self) -> int:
        return max(self.bos, self.eos, self.pad_id, self.unk) + 1


def resolve_special_ids(bos: int = 1, eos: int = 2, pad: int | None = None, unk: int = 0) -> SpecialIds:
    """Pad falls back to the unknown token (0) when unset."""
    return SpecialIds(bos=bos, eos=eos, pad=pad, unk=unk)


@dataclass(frozen=True)
class SequenceConfig:
    template: str = "default"
    max_prompt_length: int = 256
    max_response_length: int = 256
    block_size: int = 512
    split_ratio: float = 0.05
    seed: int = 42
    ids: SpecialIds = field(default_factory=resolve_special_ids)


@dataclass(frozen=True)
class RolloutConfig:
    gamma: float = 1.0
    lam: float = 0.95
    kl_penalty_beta: float = 0.1
    kl_penalty_method: str | None = None  # None (raw difference), "abs" or "mse"
    reward_score_clip: float | None = None
    value_clip: float = 0.2
    ratio_clip: float = 0.2
    entropy_beta: float = 0.0
    actor_loss_weight: float = 1.0
    critic_loss_weight: float = 1.0
    extra_loss_weight: float = 1.0
    extra_warmup_steps_ratio: float | None = None
    use_advantage_norm: bool = False
    compat: bool = False


@dataclass(frozen=True)
class PairConfig:
    dpo_beta: float = 1.0
    average_log_prob: bool = False
    reference_free: bool = False
    clm_loss_weight: float = 0.0
    use_last_reward: bool = False
