"""Constants of the corpus pipeline, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CorpusConfig:
    min_chars: int = 200
    shard_bytes: int = 256 * 1024 * 1024
    val_ratio: float = 0.001
    flush_docs: int = 50_000


@dataclass(frozen=True)
class TokenizerConfig:
    vocab_size: int = 32_000
    min_frequency: int = 2
    train_bytes: int = 500 * 1024 * 1024
    pad: int = 0
    bos: int = 1
    eos: int = 2
    max_id: int = 65_535
    compression_gate: float = 2.4


@dataclass(frozen=True)
class ModelConfig:
    vocab_size: int = 32_000
    block_size: int = 1_024
    layers: int = 12
    width: int = 768
    tied: bool = True
    bias: bool = False


@dataclass(frozen=True)
class TrainConfig:
    micro_batch: int = 8
    accumulation: int = 8
    target_tokens: int = 2_200_000_000
    tokens_per_second: int = 22_000
    warmup_steps: int = 2_000
    lr: float = 6e-4
    min_lr: float = 6e-5
    max_keep: int = 3


@dataclass(frozen=True)
class SamplingProfile:
    name: str
    temperature: float
    top_k: int | None
    top_p: float | None
    penalty: float


SPECIAL_TOKENS = ("<pad>", "<bos>", "<eos>")

# Distinct-2 of human-written text by length in words (largest number of words, p10, median, p90).
HUMAN_RANGES = (
    (60, 0.746, 0.932, 1.000),
    (120, 0.782, 0.899, 0.975),
    (400, 0.777, 0.867, 0.940),
    (10_000, 0.732, 0.832, 0.898),
)

# The code points of white space that Unicode stripping removes.
WHITE_SPACE_POINTS = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
WHITE_SPACE = "".join(chr(c) for low, high in WHITE_SPACE_POINTS for c in range(low, high + 1))

DEFAULT_PROFILE = SamplingProfile("default", 0.9, None, 0.92, 1.05)
LEGACY_PROFILE = SamplingProfile("legacy", 0.8, 50, None, 1.0)
PROFILES = (DEFAULT_PROFILE, LEGACY_PROFILE)

CORPUS, TOKENIZER, MODEL, TRAIN = CorpusConfig(), TokenizerConfig(), ModelConfig(), TrainConfig()
