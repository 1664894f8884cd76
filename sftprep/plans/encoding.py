"""Prompts to fixed-length token structs."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftprep.config import Recipe
from sftprep.functions.added import AddedTokens
from sftprep.functions.tokens import (
    TOKEN_PATTERN,
    attention_mask,
    detokenizer_udf,
    full_labels,
    mask_padded_labels,
    pad_ids,
    tokenizer_udf,
    truncate,
)
from sftprep.operators.vocabulary import Vocabulary


class Encoder(Protocol):
    def encode(self, df: DataFrame, key: str, text: str, out: str, length: int) -> DataFrame:
        """Add the ids ``out`` of the column ``text``, cut to ``length``."""

    def decode(
        self, df: DataFrame, key: str, ids: str, out: str, skip: Sequence[int]
    ) -> DataFrame:
        """Add the text ``out`` of the ids, without those in ``skip``."""

    def literal_ids(self, text: str) -> list[int]:
        """Ids of a short constant."""


def single_id(encoder: Encoder, token: str) -> int:
    """The id of a token that must be one for this encoder, such as the padding."""
    ids = encoder.literal_ids(token)
    if len(ids) != 1:
        raise ValueError(f"the tokenizer splits {token!r} into {len(ids)} tokens")
    return ids[0]


class TableEncoder:
    """The regex tokenizer with the ids of a vocabulary table.

    Cut before the lookup, so that tokens beyond ``length`` are never looked up. ``added``
    tokens are found in the text before the pattern is.
    """

    def __init__(
        self, vocabulary: Vocabulary, pattern: str = TOKEN_PATTERN, added: Sequence[str] | AddedTokens = ()
    ) -> None:
        self.vocabulary = vocabulary
        self.pattern = pattern
        self.added = added if isinstance(added, AddedTokens) else AddedTokens(added)
        self.literal_ids = functools.cache(self._literal_ids)

    def encode(
        self, df: DataFrame, key: str, text: str, out: str, length: int, keep: bool = True
    ) -> DataFrame:
        """Without ``keep`` the column ``text`` is left out, which saves storing it."""
        cut = self.added.tokenize(df, text, "__tokens", self.pattern)
        cut = cut.withColumn("__tokens", truncate(F.col("__tokens"), length))
        return self.vocabulary.encode(cut if keep else cut.drop(text), key, "__tokens", out, keep=False)

    def decode(
        self, df: DataFrame, key: str, ids: str, out: str, skip: Sequence[int]
    ) -> DataFrame:
        return self.vocabulary.decode(df, key, ids, out, skip)

    def _literal_ids(self, text: str) -> list[int]:
        return self.vocabulary.ids(self.added.tokenize_literal(text, self.pattern))


class PluginEncoder:
    """Any tokenizer: ``factory()`` returns a function from texts to id lists.

    ``decoder()``, needed for predictions only, returns one from id lists to texts.
    """

    def __init__(
        self,
        factory: Callable[[], Callable[[list[str]], Sequence[Sequence[int]]]],
        decoder: Callable[[], Callable[[list[list[int]]], Sequence[str]]] | None = None,
    ) -> None:
        self.factory = factory
        self.decoder = decoder
        self.literal_ids = functools.cache(self._literal_ids)

    def encode(self, df: DataFrame, key: str, text: str, out: str, length: int) -> DataFrame:
        return df.withColumn(out, truncate(tokenizer_udf(self.factory)(F.col(text)), length))

    def decode(
        self, df: DataFrame, key: str, ids: str, out: str, skip: Sequence[int]
    ) -> DataFrame:
        if self.decoder is None:
            raise ValueError("this encoder has no decoder")
        kept = F.filter(ids, lambda i: ~i.isin(list(skip))) if skip else F.col(ids)
        return df.withColumn(out, detokenizer_udf(self.decoder)(kept))

    @functools.cached_property
    def _tokenizer(self) -> Callable[[list[str]], Sequence[Sequence[int]]]:
        return self.factory()

    def _literal_ids(self, text: str) -> list[int]:
        return list(self._tokenizer([text])[0])


def _label_column(ids: Column, padded: Column, encoder: Encoder, recipe: Recipe) -> Column:
    spec = recipe.tokens
    if not recipe.is_sft:
        return full_labels(padded)
    return mask_padded_labels(
        ids,
        start=encoder.literal_ids(recipe.markers.response_start),
        end=encoder.literal_ids(spec.eos_token),
        length=recipe.max_length,
        pad=single_id(encoder, spec.pad),
        left=spec.left_padding,
        ignore_index=spec.ignore_index,
    )


def encode_prompt(
    df: DataFrame, key: str, prompt: str, encoder: Encoder, recipe: Recipe, out: str = "encoded"
) -> DataFrame:
    """Replace ``prompt`` by the struct ``input_ids, attention_mask[, labels]``."""
    return encode_prompts(df, key, {prompt: out}, encoder, recipe)


def encode_prompts(
    df: DataFrame, key: str, outs: dict[str, str], encoder: Encoder, recipe: Recipe
) -> DataFrame:
    """``encode_prompt`` for several columns: all ids first, so that no encoder moves the
    padded structs of another column."""
    spec, length = recipe.tokens, recipe.max_length
    pad = single_id(encoder, spec.pad)
    for prompt, out in outs.items():
        if isinstance(encoder, TableEncoder):
            df = encoder.encode(df, key, prompt, f"__ids_{out}", length, keep=False)
        else:
            df = encoder.encode(df, key, prompt, f"__ids_{out}", length).drop(prompt)
    for out in outs.values():
        ids = F.col(f"__ids_{out}")
        padded = pad_ids(ids, length, pad, spec.left_padding)
        fields = [
            padded.alias("input_ids"),
            attention_mask(ids, length, spec.left_padding).alias("attention_mask"),
        ]
        if not recipe.predicting or recipe.label_predict:
            fields.append(_label_column(ids, padded, encoder, recipe).alias("labels"))
        df = df.withColumn(out, F.struct(*fields))
    return df.drop(*[f"__ids_{out}" for out in outs.values()])
