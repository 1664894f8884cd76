"""Training and inference sets from the four record kinds.

Every plan takes a table with a unique ``key`` column, which stands for the file order,
and returns one row per example: ``key, pos``, the encoded structs, and in predict mode
``device_num`` and ``batch_idx``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftprep.config import Recipe
from sftprep.functions.chat import drop_last_turn, project_turns, render_chat, to_messages
from sftprep.functions.templates import render_template
from sftprep.functions.text import fill_missing, strip_text
from sftprep.operators.order import assign_batches, index_rows, pad_tail
from sftprep.operators.split import split_part
from sftprep.plans.encoding import Encoder, encode_prompt, encode_prompts


class Prepared(NamedTuple):
    """The prepared rows and their number before padding to the devices."""

    frame: DataFrame
    rows: int


def _positions(df: DataFrame, key: str, recipe: Recipe) -> Prepared:
    """Split, number, and in predict mode pad and deal the rows to devices."""
    part, rows = split_part(df, recipe.split, key, recipe.splits)
    frame, rows = index_rows(part, [key], "pos", rows)
    if recipe.predicting:
        batches = recipe.batches
        if batches.devices > 1:
            frame = pad_tail(frame, rows, batches.devices)
        frame = assign_batches(frame, batches.devices, batches.batch_size)
    return Prepared(frame, rows)


def _rendered(messages: Column, recipe: Recipe) -> Column:
    if recipe.template is None:
        return render_chat(messages, recipe.markers, recipe.names, recipe.predicting)
    return render_template(
        messages, recipe.template, recipe.names, recipe.predicting, recipe.thinking
    )


def _structural_prompt(recipe: Recipe, target: str) -> Column:
    names = recipe.names
    messages = to_messages(
        strip_text(F.col(names.instruction)),
        strip_text(F.col(names.data)),
        None if recipe.predicting else strip_text(F.col(target)),
        recipe.markers,
        names,
    )
    return _rendered(messages, recipe)


def _conversation_prompt(recipe: Recipe, column: str) -> Column:
    messages = project_turns(F.col(column), recipe.names)
    if recipe.predicting:
        messages = drop_last_turn(messages)
    text = _rendered(messages, recipe)
    return F.coalesce(text, F.raise_error(F.lit(f"a row has no conversation in {column}")))


def _prepare(
    df: DataFrame, key: str, recipe: Recipe, prompts: dict[str, Column], inputs: list[str]
) -> Prepared:
    frame, rows = _positions(df.select(key, *inputs), key, recipe)
    return Prepared(frame.withColumns(prompts).drop(*inputs), rows)


def structural_prompts(df: DataFrame, key: str, recipe: Recipe) -> Prepared:
    """``key, pos, prompt`` from instruction, input and response columns."""
    names = recipe.names
    inputs = [names.instruction, names.data, names.target]
    filled = fill_missing(df, inputs)
    return _prepare(
        filled, key, recipe, {"prompt": _structural_prompt(recipe, names.target)}, inputs
    )


def conversation_prompts(
    df: DataFrame, key: str, recipe: Recipe, on_null: str = "raise"
) -> Prepared:
    """``key, pos, prompt`` from message lists; turns are not stripped.

    A null conversation is an error, unless ``on_null`` is ``drop``.
    """
    column = recipe.names.messages
    rows = df.dropna(subset=[column]) if on_null == "drop" else df
    return _prepare(rows, key, recipe, {"prompt": _conversation_prompt(recipe, column)}, [column])


def preference_prompts(df: DataFrame, key: str, recipe: Recipe, data_type: str) -> Prepared:
    """``key, pos, prompt_chosen, prompt_rejected`` from either kind of preference record."""
    names = recipe.names
    pair = {"prompt_chosen": names.chosen, "prompt_rejected": names.rejected}
    if data_type == "structural":
        inputs = [names.instruction, names.data, *pair.values()]
        prompts = {out: _structural_prompt(recipe, column) for out, column in pair.items()}
        df = fill_missing(df, inputs)
    elif data_type == "conversational":
        inputs = list(pair.values())
        prompts = {out: _conversation_prompt(recipe, column) for out, column in pair.items()}
    else:
        raise ValueError(f"unknown data type: {data_type!r}")
    return _prepare(df, key, recipe, prompts, inputs)


def prepare_sft(df: DataFrame, key: str, encoder: Encoder, recipe: Recipe) -> Prepared:
    frame, rows = structural_prompts(df, key, recipe)
    return Prepared(encode_prompt(frame, "pos", "prompt", encoder, recipe), rows)


def prepare_chat_sft(
    df: DataFrame, key: str, encoder: Encoder, recipe: Recipe, on_null: str = "raise"
) -> Prepared:
    frame, rows = conversation_prompts(df, key, recipe, on_null)
    return Prepared(encode_prompt(frame, "pos", "prompt", encoder, recipe), rows)


def prepare_preference(
    df: DataFrame, key: str, encoder: Encoder, recipe: Recipe, data_type: str = "structural"
) -> Prepared:
    frame, rows = preference_prompts(df, key, recipe, data_type)
    outs = {"prompt_chosen": "encoded_choice", "prompt_rejected": "encoded_rejection"}
    return Prepared(encode_prompts(frame, "pos", outs, encoder, recipe), rows)
