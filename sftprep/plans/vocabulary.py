"""Vocabulary building and extension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sftprep.functions.added import AddedTokens
from sftprep.functions.text import HANGUL
from sftprep.functions.tokens import TOKEN_PATTERN, tokenize
from sftprep.operators.vocabulary import (
    GROUP,
    Vocabulary,
    append_special,
    count_tokens,
    extend_vocab,
    number_tokens,
)
from sftprep.plans.encoding import TableEncoder
from sftprep.storage import stored


def corpus_tokens(
    corpus: DataFrame, text: str = "text", pattern: str = TOKEN_PATTERN
) -> DataFrame:
    """``(token, freq)`` of a text column."""
    return count_tokens(corpus.select(tokenize(F.col(text), pattern).alias("tokens")))


def corpus_vocabulary(
    corpus: DataFrame,
    text: str = "text",
    reserved: Sequence[str] = (),
    pattern: str = TOKEN_PATTERN,
) -> DataFrame:
    """The stored vocabulary of a text column."""
    return stored(number_tokens(corpus_tokens(corpus, text, pattern), reserved), "vocabulary")


def extend_vocabulary(
    base_corpus: DataFrame,
    other_corpus: DataFrame,
    special: Sequence[str] = ("<think>", "</think>"),
    text: str = "text",
    char_class: str = HANGUL,
    group: int = GROUP,
    reserved: Sequence[str] = (),
    pattern: str = TOKEN_PATTERN,
) -> DataFrame:
    """Vocabulary of one corpus, extended by the script tokens of another and by ``special``."""
    base = corpus_vocabulary(base_corpus, text, reserved, pattern)
    return _extended(base, other_corpus, special, text, char_class, group, pattern)


def _extended(base, other_corpus, special, text, char_class, group, pattern) -> DataFrame:
    candidates = corpus_tokens(other_corpus, text, pattern)
    extended = stored(extend_vocab(base, candidates, char_class, group), "extended-vocabulary")
    return append_special(extended, special)


def extended_encoder(
    base: DataFrame,
    other_corpus: DataFrame,
    unk: str,
    special: Sequence[str] = ("<think>", "</think>"),
    text: str = "text",
    char_class: str = HANGUL,
    group: int = GROUP,
    pattern: str = TOKEN_PATTERN,
) -> TableEncoder:
    """An encoder with the vocabulary ``base``, extended as by ``extend_vocabulary``.

    The new tokens are found in texts before the pattern cuts them, so each one's id is given
    wherever it stands, also in longer words and between signs.
    """
    whole = stored(_extended(base, other_corpus, special, text, char_class, group, pattern), "vocabulary")
    return TableEncoder(Vocabulary(whole, unk), pattern, AddedTokens.beyond(base, whole))
