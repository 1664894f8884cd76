"""Preference-tuning report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sftprep.operators.metrics import epoch_metrics, long_metrics, pair_sums, preference_means

STEP_KEYS = ("run", "split", "epoch", "step")


def step_metrics(
    logits: DataFrame, beta: float, keys: Sequence[str] = STEP_KEYS, pair: str = "pair"
) -> DataFrame:
    """The logged rows ``keys, metric, value, batch_size`` from logits that carry ``keys``."""
    means = preference_means()
    steps = pair_sums(logits, beta).groupBy(*keys).agg(
        F.count_distinct(pair).alias("batch_size"),
        *[value.alias(name) for name, value in means.items()],
    )
    return long_metrics(steps, [*keys, "batch_size"], list(means))


def preference_report(
    logits: DataFrame, beta: float, keys: Sequence[str] = STEP_KEYS, pair: str = "pair"
) -> DataFrame:
    """Per-split epoch means of loss, log-probabilities, reward accuracy and margin."""
    by = [k for k in keys if k != "step"] + ["metric"]
    return epoch_metrics(step_metrics(logits, beta, keys, pair), by)
