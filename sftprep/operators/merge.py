"""Predictions back onto the table they were made for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_shards(*frames: DataFrame) -> DataFrame:
    """Concatenate frames by column name, duplicates kept."""
    return reduce(DataFrame.unionByName, frames)


def sort_by_index(df: DataFrame, index: str = "index") -> DataFrame:
    """Global order, for use in front of a sink."""
    return df.orderBy(index)


def merge_predictions(
    base: DataFrame,
    shards: DataFrame,
    target: str,
    pos: str = "pos",
    index: str = "index",
) -> DataFrame:
    """Overwrite ``target`` of ``base`` with the prediction whose index is the row's position.

    The column keeps its place; a ``target`` that ``base`` lacks comes last.

    A position without a prediction, or with two, is an error when the row is read.
    Predictions beyond the base (the padding rows) match nothing and fall away. A null
    prediction stays null. The pre-aggregation and the join share one exchange.
    """
    predictions = shards.groupBy(F.col(index).alias("__index")).agg(
        F.count("*").alias("__copies"), F.max(target).alias("__prediction")
    )
    joined = base.drop(target).join(predictions, base[pos] == predictions["__index"], "left")

    def fail(what: str):
        return F.raise_error(F.concat(F.lit(what), F.col(pos).cast("string"))).cast("string")

    checked = (
        F.when(F.col("__copies").isNull(), fail("no prediction for position "))
        .when(F.col("__copies") > 1, fail("several predictions for position "))
        .otherwise(F.col("__prediction"))
    )
    checked = checked.alias(target)
    columns = [checked if c == target else F.col(c) for c in base.columns]
    return joined.select(*columns, *([] if target in base.columns else [checked]))


def coverage(
    base: DataFrame, shards: DataFrame, pos: str = "pos", index: str = "index"
) -> DataFrame:
    """One row: base rows, predictions, missing and surplus positions, duplicates."""
    expected = base.select(F.col(pos).alias("at"), F.lit(1).alias("wanted"), F.lit(0).alias("given"))
    actual = shards.select(F.col(index).alias("at"), F.lit(0).alias("wanted"), F.lit(1).alias("given"))
    each = (
        expected.unionAll(actual)
        .groupBy("at")
        .agg(F.sum("wanted").alias("wanted"), F.sum("given").alias("given"))
    )
    missing = (F.col("wanted") > 0) & (F.col("given") == 0)

    def total(value):
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    return each.agg(
        total(F.col("wanted")).alias("base_rows"),
        total(F.col("given")).alias("predictions"),
        total(missing.cast("int")).alias("missing"),
        total(F.when(F.col("wanted") == 0, F.col("given"))).alias("surplus"),
        total(F.greatest(F.col("given") - 1, F.lit(0))).alias("duplicates"),
        F.min(F.when(missing, F.col("at"))).alias("first_missing"),
    )


def count_guard(
    base: DataFrame, shards: DataFrame, pos: str = "pos", index: str = "index"
) -> DataFrame:
    """Raise on a shortfall or on duplicates; otherwise return the shards the base needs."""
    found = coverage(base, shards, pos, index).first()
    if found.missing:
        raise ValueError(
            f"{found.missing} of {found.base_rows} positions have no prediction, "
            f"the first is {found.first_missing}"
        )
    if found.duplicates:
        raise ValueError(f"{found.duplicates} predictions repeat a position")
    if not found.surplus:
        return shards
    return shards.join(base.select(F.col(pos).alias(index)), index, "left_semi")
