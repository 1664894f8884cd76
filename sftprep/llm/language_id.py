"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent character n-grams, in order of their
frequency in all learned texts. A text has such a list of its own. Its out-of-place distance
from a profile is the sum, over the text's n-grams, of how far each stands from its place in
the profile; one that the profile lacks counts as the profile's length. The language with the
smallest distance is predicted, of equal ones the first by name.

An n-gram lies in one word with a mark on either side, so ``_th``, ``the`` and ``he_`` are
n-grams of ``the``. Words are runs of letters and combining marks, in lower case; anything
else parts them. N-grams are held as 64-bit polynomials of their code points, and n-grams of
equal frequency are ordered by that number. In a short text most n-grams are equally frequent,
so those share the middle of the places they take together.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sftprep.storage import stored

UNDETERMINED = "und"
#: Multiplier of the polynomial, odd, and the code of the mark between words.
BASE, MARK = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
#: Starting places of n-grams that are gathered at once; n-grams a task holds before it
#: passes their counts on; profiles that a task compares with at once.
WINDOW, HELD, BLOCK = 1 << 20, 1 << 20, 4096


@dataclass(frozen=True)
class Settings:
    """longest: characters of an n-gram. profile: n-grams of a language. of_text: of a text."""

    longest: int = 5
    profile: int = 400
    of_text: int = 300


@functools.cache
def _kinds() -> np.ndarray:
    """For every code point 2 for a letter, 1 for a combining mark, 0 for anything else."""
    first = (unicodedata.category(chr(c))[0] for c in range(0x110000))
    return np.fromiter(({"L": 2, "M": 1}.get(k, 0) for k in first), dtype=np.uint8)


def letters_of(text: str) -> np.ndarray:
    """The codes of a text's words with a mark before, between and after them.

    Empty if the text has no letter.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _kinds()[codes]
    if not (kind == 2).any():
        return np.zeros(0, dtype=np.uint64)
    inside = np.concatenate([[False], kind > 0, [False]])
    out = np.full(len(inside), MARK, dtype=np.uint64)
    out[1:-1][inside[1:-1]] = codes[inside[1:-1]] + np.uint32(2)
    return out[inside | np.concatenate([[True], inside[:-1]])]


def counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order, and the sum of the counts of each."""
    if len(keys) == 1:
        return keys[0], counts[0]
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    own, first = np.unique(key[order], return_index=True)
    return own, np.add.reduceat(count[order], first) if len(own) else count


def grams(text: str, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text, in rising order of their numbers, and their counts."""
    codes = letters_of(text)
    keys, counts = [], []
    for lo in range(0, len(codes), WINDOW):
        part = codes[lo : lo + WINDOW + longest - 1]
        here = len(codes[lo : lo + WINDOW])
        key = part
        inner = np.ones(len(part), dtype=bool)  # no mark but at the ends
        found = [key[:here][key[:here] != MARK]]
        for n in range(2, longest + 1):
            key = key[: len(part) - n + 1] * BASE + part[n - 1 :]
            inner = inner[: len(key)]
            if n > 2:
                inner = inner & (part[n - 2 : len(part) - 1] != MARK)
            found.append(key[:here][inner[:here]])
        own, count = np.unique(np.concatenate(found), return_counts=True)
        keys.append(own)
        counts.append(count)
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return counted(keys, counts)


def ranked(keys: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most frequent n-grams and their places; equally frequent ones share theirs."""
    order = np.argsort(-counts, kind="stable")[:most]
    frequent = counts[order]
    edge = np.flatnonzero(np.concatenate([[True], frequent[1:] != frequent[:-1], [True]]))
    places = np.repeat((edge[:-1] + edge[1:] - 1) / 2, np.diff(edge)) if len(order) else frequent
    return keys[order], places


class Profiles:
    """Profiles of some languages: each n-gram with the languages that have it and its places."""

    def __init__(self, rows: pd.DataFrame, settings: Settings):
        self.settings = settings
        self.names = sorted(rows["lang"].unique())
        lang = np.searchsorted(np.array(self.names, dtype=object), rows["lang"].to_numpy(dtype=object))
        gram = rows["gram"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.lexsort((lang, gram))
        self.grams, first = np.unique(gram[order], return_index=True)
        self.starts = np.append(first, len(gram))
        self.lang = lang[order].astype(np.int32)
        self.place = rows["place"].to_numpy(dtype=np.float32)[order]

    def distances(self, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The out-of-place distance of a text's n-grams from each language."""
        absent = self.settings.profile
        at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        held = self.grams[at] == keys
        at, own = at[held], places[held]
        many = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(many)
        each = np.repeat(self.starts[at] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
        saved = np.abs(self.place[each] - np.repeat(own, many)) - absent
        total = np.bincount(self.lang[each], weights=np.minimum(saved, 0), minlength=len(self.names))
        return total + absent * len(keys)

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and what is left of the largest distance, from 0 to 1."""
        keys, counts = grams(text or "", self.settings.longest)
        if not len(keys):
            return UNDETERMINED, 0.0
        keys, places = ranked(keys, counts, self.settings.of_text)
        d = self.distances(keys, places)
        best = int(d.argmin())
        score = 1 - d[best] / (self.settings.profile * len(keys))
        return self.names[best], min(1.0, max(0.0, float(score)))


def learn(
    docs: DataFrame, text: Column, lang: Column, settings: Settings = Settings()
) -> DataFrame:
    """The profiles ``(lang, gram, place)`` of all languages in ``docs``, a stored table.

    All rows with a text and a language count, whole; repeated rows as often as they are there.
    Tasks add counts up before the shuffle, so a language may hold any share of the rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def passed() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                keys, counts = counted([k for k, _ in parts], [c for _, c in parts])
                columns = [pa.array([name]).take(pa.array(np.zeros(len(keys), dtype=np.int32)))]
                columns += [pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for name, whole in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, counts = grams(whole.as_py(), settings.longest)
                held.setdefault(name, []).append((keys, counts))
                size += len(keys)
                if size >= HELD:
                    for own, parts in held.items():
                        held[own] = [counted([k for k, _ in parts], [c for _, c in parts])]
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size >= HELD // 2:
                        yield from passed()
                        size = 0
        yield from passed()

    given = docs.select(lang.cast("string").alias("lang"), text.alias("text"))
    counts = (
        given.filter("lang is not null and text is not null")
        .mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    unsigned = F.col("gram").bitwiseXOR(F.lit(-(1 << 63)))
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), unsigned)
    first = counts.withColumn("place", F.row_number().over(by_count) - 1)
    return stored(
        first.filter(F.col("place") < settings.profile).select("lang", "gram", "place"), "profiles"
    )


def identify(
    docs: DataFrame, text: Column, profiles: DataFrame, settings: Settings = Settings()
) -> DataFrame:
    """``docs`` with the columns ``lang_pred`` and ``score``; columns of these names go.

    ``lang_pred`` is a learned language, or ``und`` for null texts, texts without a letter, and
    where nothing was learned. ``score`` is 1 for a text whose n-grams all stand at their places
    and 0 for one that shares none (then the first language by name is predicted) or is ``und``.
    An empty table gives no rows, repeated rows give repeated rows.

    Profiles have a bounded length. They go to the tasks 4,096 languages at a time; with more,
    texts are held against one such block after the other and keep the nearest so far.
    """
    names = [r[0] for r in profiles.select("lang").distinct().orderBy("lang").collect()]
    given = docs.drop("lang_pred", "score")
    out = given.withColumn("__best", F.lit(None).cast("struct<lang: string, score: double>"))
    for lo in range(0, len(names), BLOCK):
        block = names[lo : lo + BLOCK]
        within = profiles.filter(F.col("lang").between(block[0], block[-1]))
        if lo:
            out = stored(out, "languages")
        nearest = _nearest_of(Profiles(within.toPandas(), settings))
        better = F.col("__best").isNull() | (F.col("__new.score") > F.col("__best.score"))
        best = F.when(better, F.col("__new")).otherwise(F.col("__best"))
        out = out.withColumn("__new", nearest(text)).withColumn("__best", best).drop("__new")
    kept = [F.col(f"`{c}`") for c in given.columns]
    return out.select(
        *kept,
        F.coalesce("__best.lang", F.lit(UNDETERMINED)).alias("lang_pred"),
        F.coalesce("__best.score", F.lit(0.0)).alias("score"),
    )


def _nearest_of(profiles: Profiles):
    @F.pandas_udf("lang string, score double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(map(profiles.nearest, texts), columns=["lang", "score"])

    return nearest
