"""Scalar expressions of training plans."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.config import ModelConfig, TrainConfig


def learning_rate(step: Column, total: Column | int, train: TrainConfig) -> Column:
    """Linear warm-up, then a cosine down to the least rate, which it keeps."""
    total = F.lit(total) if isinstance(total, int) else total
    warm = F.lit(train.lr) * (step + 1) / F.lit(train.warmup_steps)
    share = (step - train.warmup_steps) / F.greatest(F.lit(1), total - train.warmup_steps)
    cosine = F.lit(train.min_lr) + F.lit(0.5) * (1 + F.cos(F.lit(math.pi) * share)) * F.lit(train.lr - train.min_lr)
    return F.when(step < train.warmup_steps, warm).when(step >= total, F.lit(train.min_lr)).otherwise(cosine)


def parameters(vocab: Column, block: Column, layers: Column, width: Column, tied: bool = True) -> Column:
    """Parameters of a decoder without biases."""
    vocab, block, layers, width = (c.cast("long") for c in (vocab, block, layers, width))
    embedding = vocab * width * (1 if tied else 2) + block * width
    return embedding + layers * (12 * width * width + 2 * width) + width


def vram_gb(params: Column, micro_batch: Column, block: Column, layers: Column, width: Column) -> Column:
    """16 bytes a parameter, and activations at the measured factor of 36 in two bytes."""
    return (16 * params.cast("long") + micro_batch.cast("long") * block * width * layers * 36 * 2) / F.lit(float(1024**3))


def checkpoint_gb(params: Column, keep: Column) -> Column:
    """Disk of `keep` checkpoints and the one being written, at 12 bytes a parameter."""
    return 12 * params * (keep + 1) / F.lit(float(1024**3))


def tokens_per_step(train: TrainConfig, model: ModelConfig) -> int:
    return train.micro_batch * train.accumulation * model.block_size


def remaining(done: Column, total: Column, hours: Column) -> tuple[Column, Column]:
    """Steps and hours that are left."""
    left = F.greatest(F.lit(0), total - done)
    return left, hours * left / total


def format_params(n: Column) -> Column:
    return F.format_string("%.1fM", n / F.lit(1e6))


def throughput(tokens_step: int, steps: Column, seconds: Column) -> Column:
    """Tokens a second over the steps really taken since the last log row."""
    return F.lit(tokens_step) * steps / seconds
