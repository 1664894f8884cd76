"""Token and id arrays."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: markers, whitespace runs, words, lone "<". Every character of a text
# falls in exactly one token, so joining the tokens gives the text back.
TOKEN_PATTERN = r"<\|[a-z_]+\|>|[ \t\n\r]+|[^ \t\n\r<]+|<"

EMPTY_INTS = "array<int>"
#: Characters or ids, about, that a plug-in or mask works on at a time.
STEP = 1 << 19


def tokenize(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokenize_literal(text: str, pattern: str = TOKEN_PATTERN) -> list[str]:
    """The same cut for a short constant such as a marker, on the driver."""
    return [m.group(0) for m in re.finditer(pattern, text)]


def _steps(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of rows of about ``STEP`` in size each; a larger row is one by itself."""
    run = np.cumsum(sizes, dtype=np.int64) // STEP
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
    for lo, hi in zip(edges, edges[1:]):
        if lo < hi:
            yield slice(lo, hi)


def _lengths(values: pd.Series) -> np.ndarray:
    return np.array([0 if v is None else len(v) for v in values], dtype=np.int64)


def _filled(present: pd.Series, rows: list) -> pd.Series:
    """``rows`` in the places that ``present`` marks, null elsewhere."""
    values = pd.Series([None] * len(present), index=present.index, dtype=object)
    values[present] = pd.Series(rows, index=present.index[present], dtype=object)
    return values


def tokenizer_udf(factory: Callable[[], Callable[[list[str]], Sequence[Sequence[int]]]]):
    """Wrap any tokenizer as a text -> ids column function.

    ``factory`` runs once per Python worker and returns a function from a list of
    texts to a list of id lists. It gets about ``STEP`` characters at a time, and what it
    returns goes on before the next ones, so memory does not follow the rows of a batch.
    """

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between steps
        encoder = factory()
        for batch in batches:
            for step in _steps(_lengths(batch)):
                texts = batch.iloc[step]
                present = texts.notna()
                rows = encoder(texts[present].tolist())
                yield _filled(present, [list(row) for row in rows])

    return encode


def detokenizer_udf(factory: Callable[[], Callable[[list[list[int]]], Sequence[str]]]):
    """Wrap any decoder as an ids -> text column function; null ids give null.

    The decoder gets about ``STEP`` ids at a time.
    """

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pa.set_memory_pool(pa.system_memory_pool())
        decoder = factory()
        for batch in batches:
            for step in _steps(_lengths(batch)):
                ids = batch.iloc[step]
                present = ids.notna()
                yield _filled(present, list(decoder([[int(i) for i in row] for row in ids[present]])))

    return decode


def truncate(items: Column, length: int) -> Column:
    return F.slice(items, 1, length)


def pad_ids(ids: Column, length: int, pad: int, left: bool = False) -> Column:
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def attention_mask(ids: Column, length: int, left: bool = False) -> Column:
    """From the unpadded ids: a real token may carry the padding id, so ids cannot tell."""
    ones = F.array_repeat(F.lit(1), F.size(ids))
    zeros = F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))
    return F.concat(zeros, ones) if left else F.concat(ones, zeros)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once, so that lambdas below do not evaluate it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_pattern(ids: Column, pattern: Sequence[int]) -> Column:
    """All 0-based starts of ``pattern`` in ``ids``, overlaps included."""
    if not pattern:
        raise ValueError("the pattern to find is empty")

    def search(items: Column) -> Column:
        last = F.size(items) - F.lit(len(pattern))

        def matches(i: Column) -> Column:
            hit = F.get(items, i) == F.lit(pattern[0])
            for offset, token in enumerate(pattern[1:], start=1):
                hit = hit & (F.get(items, i + F.lit(offset)) == F.lit(token))
            return hit

        # sequence() counts downwards when its end is below its start
        return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), matches)).otherwise(
            F.array().cast(EMPTY_INTS)
        )

    return _let(ids, search)


def _starts_of(items: np.ndarray, pattern: np.ndarray) -> np.ndarray:
    """0-based starts of ``pattern`` in ``items``, overlaps included."""
    places = len(items) - len(pattern) + 1
    if places <= 0:
        return np.zeros(0, dtype=np.int64)
    hit = np.ones(places, dtype=bool)
    for offset, token in enumerate(pattern):
        hit &= items[offset : offset + places] == token
    return np.flatnonzero(hit)


def span_labels(
    ids: np.ndarray, start: np.ndarray, end: np.ndarray, ignore_index: int
) -> np.ndarray:
    """Copy the response spans of one array, ``ignore_index`` elsewhere.

    The starts are taken in order. Each takes the first end behind it that no earlier start
    has taken, and opens the span from behind the start pattern up to that end; with no end
    left, the span runs to the end of the array. So start ``i`` takes end number
    ``max(ends before start i, number of the previous start + 1)``, which is ``i`` plus a
    running maximum. The work is linear in the array.
    """
    starts, ends = _starts_of(ids, start), _starts_of(ids, end)
    order = np.arange(len(starts))
    behind = np.searchsorted(ends, starts, side="right")
    taken = order + np.maximum.accumulate(behind - order) if len(starts) else order
    stops = np.append(ends, len(ids))[np.minimum(taken, len(ends))]
    opened = starts + len(start)
    real = opened < stops
    depth = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(depth, opened[real], 1)
    np.add.at(depth, stops[real], -1)
    return np.where(np.cumsum(depth[:-1]) > 0, ids, ignore_index)


def _masker(start, end, ignore_index, length=None, pad=0, left=False):
    """An Arrow function ids -> labels, of the array padded to ``length`` if that is given."""
    if not start or not end:
        raise ValueError("the pattern to find is empty")
    first, last = np.array(start), np.array(end)

    def masked(row: np.ndarray) -> np.ndarray:
        if length is not None and len(row) < length:
            fill = np.full(length - len(row), pad, dtype=row.dtype)
            row = np.concatenate([fill, row] if left else [row, fill])
        return span_labels(row, first, last, ignore_index).astype(np.int32)

    @F.arrow_udf(EMPTY_INTS)
    def labels(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between steps
        for batch in batches:
            sizes = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for step in _steps(np.maximum(sizes, length or 0)):
                ids = batch[step]
                flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                ends = np.cumsum(sizes[step])
                rows = [masked(flat[hi - n : hi]) for hi, n in zip(ends, sizes[step])]
                offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
                values = np.concatenate([*rows, np.zeros(0, dtype=np.int32)])
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=ids.is_null())

    return labels


def mask_labels(
    ids: Column, start: Sequence[int], end: Sequence[int], ignore_index: int = -100
) -> Column:
    """Ids inside assistant responses, ``ignore_index`` elsewhere (see ``span_labels``).

    Runs on Arrow batches. A null array gives null.
    """
    return _masker(start, end, ignore_index)(ids)


def mask_padded_labels(
    ids: Column,
    start: Sequence[int],
    end: Sequence[int],
    length: int,
    pad: int,
    left: bool = False,
    ignore_index: int = -100,
) -> Column:
    """``mask_labels`` of the array padded to ``length``.

    Padding takes part in a match if a pattern contains the padding id: with an end
    pattern that is the padding id (pad = eos) every padding position is one more end.
    """
    return _masker(start, end, ignore_index, length, pad, left)(ids)


def full_labels(ids: Column) -> Column:
    """Labels when no mask is wanted: the input ids, padding included."""
    return ids


def strip_prompt(sequence: Column, prompt_length: Column) -> Column:
    """Drop the first ``prompt_length`` ids of a generated sequence."""
    return F.slice(
        sequence, prompt_length + F.lit(1), F.greatest(F.size(sequence) - prompt_length, F.lit(0))
    )


def argmax(values: Column) -> Column:
    """0-based position of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - F.lit(1)).cast("int")


def drop_token_types(df: DataFrame) -> DataFrame:
    return df.drop("token_type_ids")
