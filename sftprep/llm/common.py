"""What several operators of this subpackage share."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of these characters part words: space, tab, line feed, vertical tab, form feed, return.
SPACES = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class WorkerMemory:
    """What a Python worker has worked out about words, in two generations of bounded size.

    When the younger generation is full it becomes the older one, and what was older is
    forgotten; a word met again moves back to the younger one. So frequent words stay.
    """

    def __init__(self, limit: int):
        self.half, self.known, self.old = limit // 2, {}, {}

    def look_up(self, lists: list[list], work_out) -> list[list]:
        """For each list of words the list of what is known about them.

        ``work_out`` gets the distinct words not known yet, in a list, and returns a mapping
        of them; None is no value.
        """
        if len(self.known) > self.half:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        found = [list(map(known.get, words)) for words in lists]
        open_ = [k for k, values in enumerate(found) if None in values]
        new = {w for k in open_ for w, v in zip(lists[k], found[k]) if v is None}
        rest = []
        for w in new:
            if w in old:
                known[w] = old[w]
            else:
                rest.append(w)
        if rest:
            known.update(work_out(rest))
        for k in open_:
            found[k] = [known[w] if v is None else v for w, v in zip(lists[k], found[k])]
        return found


def worker_memory(purpose: tuple, limit: int) -> WorkerMemory:
    """The memory for a purpose, which outlives the task in a worker that is used again.

    A worker holds one at a time: the next operator's replaces it, so that they never add up.
    """
    place = sys.modules.setdefault("_sftprep_worker", types.ModuleType("_sftprep_worker"))
    held = place.__dict__.setdefault("held", {})
    if purpose not in held:
        held.clear()
        gc.collect()
        held[purpose] = WorkerMemory(limit)
    return held[purpose]


def steps(batch: pa.RecordBatch, column: str, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``rows`` rows and, but for single long texts, about
    ``size`` bytes of text."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = int(np.searchsorted(ends, before + size, side="right"))
        hi = min(max(hi, lo + 1), lo + rows)
        yield batch.slice(lo, hi - lo)
        lo = hi
