"""Batch inference, from a table to a submission."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sftprep.config import Recipe
from sftprep.functions.text import clean_generation
from sftprep.functions.tokens import strip_prompt
from sftprep.operators.generation import GenerationOptions, Generator, generate
from sftprep.operators.merge import merge_predictions
from sftprep.operators.order import index_rows
from sftprep.plans.encoding import Encoder, single_id
from sftprep.plans.prepare import Prepared, prepare_chat_sft, prepare_preference, prepare_sft
from sftprep.sources.readers import read_prediction_shards
from sftprep.sources.writers import write_prediction_shards, write_submission


def prepare_predict(
    df: DataFrame,
    key: str,
    encoder: Encoder,
    recipe: Recipe,
    data_type: str = "structural",
    preference: bool = False,
) -> Prepared:
    """Prompts without the last turn, open for generation, padded and dealt to devices."""
    recipe = replace(recipe, split="predict")
    if preference:
        return prepare_preference(df, key, encoder, recipe, data_type)
    if data_type == "structural":
        return prepare_sft(df, key, encoder, recipe)
    if data_type == "conversational":
        return prepare_chat_sft(df, key, encoder, recipe)
    raise ValueError(f"unknown data type: {data_type!r}")


def _target(recipe: Recipe, preference: bool) -> str:
    return recipe.names.chosen if preference else recipe.names.target


def predict(
    prepared: DataFrame,
    encoder: Encoder,
    recipe: Recipe,
    factory: Callable[[], Generator],
    options: GenerationOptions,
    preference: bool = False,
) -> DataFrame:
    """``index, <target>, device_num, batch_idx``: cleaned text of the new tokens.

    Of preference records the chosen side is continued, and its column is the target.
    """
    encoded = "encoded_choice" if preference else "encoded"
    special = [single_id(encoder, token) for token in recipe.tokens.special]
    place = ["pos", "device_num", "batch_idx"]
    prompts = prepared.select(*place, f"{encoded}.input_ids", f"{encoded}.attention_mask")
    length = F.lit(recipe.tokens.data_max_length)
    new_ids = generate(prompts, factory, options, keep=place).select(
        *place, strip_prompt(F.col("sequences"), length).alias("new_ids")
    )
    decoded = encoder.decode(new_ids, "pos", "new_ids", "text", special)
    return decoded.select(
        F.col("pos").alias("index"),
        clean_generation(F.col("text")).alias(_target(recipe, preference)),
        "device_num",
        "batch_idx",
    )


def predict_and_merge(
    df: DataFrame,
    key: str,
    encoder: Encoder,
    recipe: Recipe,
    factory: Callable[[], Generator],
    options: GenerationOptions,
    shard_path: str,
    data_type: str = "structural",
    preference: bool = False,
    per_batch: bool = False,
    submission_path: str | None = None,
) -> DataFrame:
    """Generate for every row of ``df``, keep the shards, and put them back onto ``df``.

    The table with its target column overwritten, and ``pos`` for the order. The shards
    are written first and read again: they are the durable output of the costly step.
    With ``submission_path`` the merged table is written there as CSV as well.
    """
    recipe = replace(recipe, split="predict")
    prepared = prepare_predict(df, key, encoder, recipe, data_type, preference)
    predictions = predict(prepared.frame, encoder, recipe, factory, options, preference)
    target = _target(recipe, preference)
    write_prediction_shards(predictions, shard_path, target, per_batch)
    shards = read_prediction_shards(df.sparkSession, shard_path, target)
    base = index_rows(df, [key], "pos", prepared.rows).frame
    merged = merge_predictions(base, shards, target)
    if submission_path is not None:
        write_submission(merged, submission_path)
    return merged
