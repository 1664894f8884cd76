"""Preference metrics, per-epoch means, trial selection, row counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftprep.functions.preference import log_softmax, preference_sums, relative_logprob

POLICY_AND_REFERENCE = ("chosen", "rejected", "ref_chosen", "ref_rejected")


def relative_logprobs(df: DataFrame) -> DataFrame:
    """Add ``relative_chosen`` and ``relative_rejected`` from the four logit arrays."""
    probs = df.withColumns({f"__{c}": log_softmax(F.col(c)) for c in POLICY_AND_REFERENCE})
    return probs.withColumns(
        {
            "relative_chosen": relative_logprob(F.col("__chosen"), F.col("__ref_chosen")),
            "relative_rejected": relative_logprob(F.col("__rejected"), F.col("__ref_rejected")),
        }
    ).drop(*[f"__{c}" for c in POLICY_AND_REFERENCE])


def pair_sums(df: DataFrame, beta: float) -> DataFrame:
    """Add the struct ``sums`` (see ``preference_sums``) of each row."""
    return df.withColumn("sums", preference_sums(*map(F.col, POLICY_AND_REFERENCE), beta))


def preference_means() -> dict[str, Column]:
    """Aggregates over ``sums``: element-wise means over all rows of the group."""
    elements = F.sum("sums.elements")

    def mean(total: Column) -> Column:
        return F.sum(total) / elements

    chosen, rejected = F.col("sums.chosen"), F.col("sums.rejected")
    return {
        "loss": mean(F.col("sums.loss")),
        "chosen_logprob": mean(chosen),
        "rejected_logprob": mean(rejected),
        "reward_accuracy": mean(F.col("sums.accurate")),
        "reward_margin": mean(chosen - rejected),
    }


def preference_metrics(df: DataFrame, beta: float, by: Sequence[str] = ()) -> DataFrame:
    """Loss, mean relative log-probabilities, reward accuracy and margin of each group."""
    means = [value.alias(name) for name, value in preference_means().items()]
    return pair_sums(df, beta).groupBy(*by).agg(*means)


def long_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row ``(keys, metric, value)`` for every metric column."""
    return df.unpivot(list(keys), list(metrics), "metric", "value")


def epoch_metrics(
    df: DataFrame,
    by: Sequence[str] = ("run", "split", "epoch", "metric"),
    value: str = "value",
    weight: str = "batch_size",
) -> DataFrame:
    """Mean of each logged metric over steps and devices, weighted by batch size."""
    weights = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    mean = F.try_divide(F.sum(F.col(value) * F.col(weight)), weights)
    return df.groupBy(*by).agg(mean.alias(value))


def best_trial(
    trials: DataFrame,
    params: Sequence[str],
    direction: str = "min",
    trial: str = "trial",
    value: str = "value",
) -> DataFrame:
    """One row ``(trial, value, params)``: the best trial, the lower number on ties.

    ``params`` becomes a JSON object. Trials without a usable value did not finish and
    cannot win.
    """
    if direction not in ("min", "max"):
        raise ValueError(f"direction must be min or max, not {direction!r}")
    finished = trials.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    row = F.struct(trial, value, F.struct(*params).alias("params"))
    if direction == "min":
        best = F.min_by(row, F.struct(F.col(value), F.col(trial)))
    else:
        best = F.max_by(row, F.struct(F.col(value), -F.col(trial)))
    return (
        finished.agg(best.alias("best"))
        .filter(F.col("best").isNotNull())
        .select(f"best.{trial}", f"best.{value}", F.to_json("best.params").alias("params"))
    )


def row_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"))
