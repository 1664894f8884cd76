"""Batch inference through a generator the user supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sftprep.functions.tokens import STEP


@dataclass(frozen=True)
class GenerationOptions:
    max_new_tokens: int = 2048
    min_new_tokens: int = 16
    batch_size: int = 16


# A batch (columns input_ids and attention_mask) and the options -> one id list per row,
# each starting with the prompt as it was given.
Generator = Callable[[pd.DataFrame, GenerationOptions], Sequence[Sequence[int]]]


def generate(
    df: DataFrame,
    factory: Callable[[], Generator],
    options: GenerationOptions,
    keep: Sequence[str] = ("pos",),
    out: str = "sequences",
    partitions: int | None = None,
) -> DataFrame:
    """Run the generator over every row of ``df``; ``factory`` runs once per partition.

    Only ``keep`` and the model inputs cross to Python. A task holds one Arrow batch of
    prompts and the sequences of some batches of ``batch_size``, about ``STEP`` ids. ``partitions`` deals the rows
    to that many tasks, which a costly generator wants, as input files may make few. Rows
    come back in any order and carry ``keep`` as their identity, so a retried task changes
    nothing.
    """
    inputs = ["input_ids", "attention_mask"]
    schema = T.StructType(
        [df.schema[name] for name in keep] + [T.StructField(out, T.ArrayType(T.IntegerType()))]
    )

    def made(done: list[pd.DataFrame], rows: list[list[int]]) -> pd.DataFrame:
        result = pd.concat(done)
        result[out] = pd.Series(rows, index=result.index, dtype=object)
        return result

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = factory()
        for frame in frames:
            frame = frame.reset_index(drop=True)
            done, rows, size = [], [], 0
            for first in range(0, len(frame), options.batch_size):
                batch = frame.iloc[first : first + options.batch_size]
                sequences = generator(batch[inputs], options)
                if len(sequences) != len(batch):
                    raise ValueError(f"{len(sequences)} sequences for {len(batch)} prompts")
                done.append(batch[list(keep)])
                rows += [list(s) for s in sequences]
                size += sum(map(len, rows[-len(batch) :]))
                if size >= STEP:
                    yield made(done, rows)
                    done, rows, size = [], [], 0
            if done:
                yield made(done, rows)

    rows = df.select(*keep, *inputs)
    if partitions is not None:
        rows = rows.repartition(partitions, *keep)
    return rows.mapInPandas(run, schema)
