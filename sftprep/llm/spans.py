"""Matches of a pattern with their places and surroundings, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of text that a match carries from either side; values of an array that are added
#: up by copying. Blocks of those are added up in turn, so work stays linear in the array.
AROUND, RUN = 40, 256


def with_running(
    df: DataFrame, name: str, values: str, combine: Callable[[Column, Column], Column], start: int
) -> DataFrame:
    """Add ``name``: for each of the whole numbers ``values`` all earlier ones combined.

    ``combine`` is associative, and ``start`` leaves a value as it is. Helper columns are named
    more than once, as the optimizer would else put their work into the loops over them.
    """
    first, local, before = F.lit(start).cast("int"), f"__{name}_local", f"__{name}_before"
    fold = F.struct(first.alias("at"), F.array().cast("array<int>").alias("seen"))

    def append(acc: Column, at: Column) -> Column:
        return F.struct(
            combine(acc["at"], at).alias("at"), F.array_append(acc["seen"], acc["at"]).alias("seen")
        )

    last = F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / RUN).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), last), lambda b: F.slice(values, b * RUN + 1, F.lit(RUN))
    )
    df = df.withColumn(local, F.transform(blocks, lambda x: F.aggregate(x, fold, append)))
    totals = F.aggregate(local, fold, lambda acc, x: append(acc, x["at"]))["seen"]
    df = df.withColumn(before, F.when(F.size(local) > 0, totals))
    parts = F.zip_with(
        local, before, lambda x, o: F.transform(x["seen"], lambda s: combine(s, o))
    )
    return df.withColumn(name, F.flatten(parts)).drop(local, before)


def with_matches(df: DataFrame, text: str, pattern: str, name: str, guard: Column) -> DataFrame:
    """Add ``name``: leftmost matches that do not overlap, in order, as an array of structs
    ``(start, end, value, left, right)``.

    Places count code points from 0, the end exclusive; ``left`` and ``right`` are up to
    ``AROUND`` characters of the text between the match and the next one on either side. The
    array is empty where ``guard`` is not true, which must hold wherever there is a match.
    Work is linear in the text: matches and the texts between them come from two scans.
    """
    hits, gaps = f"__{name}_hits", f"__{name}_gaps"
    none = F.array().cast("array<string>")
    df = df.withColumns(
        {
            hits: F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
            gaps: F.when(guard, F.split(text, pattern, -1)).otherwise(none),
        }
    )
    steps = F.zip_with(
        hits, F.slice(F.col(gaps), F.lit(1), F.size(hits)), lambda m, g: F.length(m) + F.length(g)
    )
    df = df.withColumn(f"__{name}_steps", steps)
    df = with_running(df, f"__{name}_past", f"__{name}_steps", lambda a, b: a + b, 0)
    starts = F.zip_with(
        f"__{name}_past",
        F.slice(F.col(gaps), F.lit(1), F.size(hits)),
        lambda at, g: at + F.length(g),
    )
    df = df.withColumn(f"__{name}_starts", starts)
    n = F.size(hits)
    # side by side: what a loop only names, the optimizer may work out in each of its turns
    side = F.arrays_zip(
        F.col(hits).alias("value"),
        F.col(f"__{name}_starts").alias("start"),
        F.slice(F.col(gaps), F.lit(1), n).alias("left"),
        F.slice(F.col(gaps), F.lit(2), n).alias("right"),
    )
    found = F.transform(
        side,
        lambda x: F.struct(
            x["start"].alias("start"),
            (x["start"] + F.length(x["value"])).alias("end"),
            x["value"].alias("value"),
            F.right(x["left"], F.lit(AROUND)).alias("left"),
            F.left(x["right"], F.lit(AROUND)).alias("right"),
        ),
    )
    return df.withColumn(name, found).drop(
        *[f"__{name}_{x}" for x in ("starts", "past", "steps")]
    )


def drop_scans(df: DataFrame, *names: str) -> DataFrame:
    """Without the helper columns of ``with_matches``."""
    return df.drop(*[f"__{n}_{x}" for n in names for x in ("hits", "gaps")])


def spelled(spans: Column, kind: str) -> Column:
    """``kind:start:end`` of each span."""
    return F.transform(
        spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))
    )
