"""Seeded train/validation split of exact size.

Rows are ranked by ``md5(seed:key)``, ties by key; the first ``ceil(ratio * n)`` are
validation. The rank is never materialised: the hash and key of the last validation row
are found by counting hash prefixes, and membership is then a row-local comparison with
two constants. No sort, join or shuffle of the rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftprep.config import SplitSpec, check_split
from sftprep.operators.order import shuffle_key

PREFIX_STEP = 4
SMALL_BUCKET = 50_000
MD5_DIGITS = 32


class SplitCut(NamedTuple):
    """The last validation row in hash order, and the sizes of both parts."""

    key: str
    seed: int
    last_hash: str
    last_key: object
    rows: int
    val_rows: int

    @property
    def train_rows(self) -> int:
        return self.rows - self.val_rows

    def is_val(self) -> Column:
        digest = shuffle_key(self.key, self.seed)
        at_cut = (digest == F.lit(self.last_hash)) & (F.col(self.key) <= F.lit(self.last_key))
        return (digest < F.lit(self.last_hash)) | at_cut


def split_cut(df: DataFrame, key: str, spec: SplitSpec) -> SplitCut:
    """Find the cut by passes over ``key`` alone; each returns at most 65,536 counts.

    ``key`` identifies a row. If rows with the same key lie on both sides of the cut no
    exact split exists, and that is an error.
    """
    hashed = df.select(F.col(key).alias("key"), shuffle_key(key, spec.seed).alias("digest"))
    prefix, skipped, rows, wanted = "", 0, None, None
    while True:
        digits = len(prefix) + PREFIX_STEP
        inside = hashed.filter(F.col("digest").startswith(prefix)) if prefix else hashed
        counts = inside.groupBy(F.substring("digest", 1, digits).alias("prefix")).count().collect()
        if rows is None:
            if any(found is None for found, _ in counts):
                raise ValueError(f"cannot split: column {key!r} has nulls")
            rows = sum(count for _, count in counts)
            wanted = math.ceil(spec.ratio * rows)
            if not 0 < wanted < rows:
                raise ValueError(f"cannot split {rows} rows with ratio {spec.ratio}: a part is empty")
        for prefix, count in sorted(counts):
            if skipped + count >= wanted:
                break
            skipped += count
        if count <= SMALL_BUCKET or digits == MD5_DIGITS:
            break

    rest = wanted - skipped
    tail = (
        hashed.filter(F.col("digest").startswith(prefix))
        .groupBy("digest", "key")
        .count()
        .orderBy("digest", "key")
        .limit(count)
        .collect()
    )
    for row in tail:
        rest -= row["count"]
        if rest <= 0:
            break
    if rest != 0:
        raise ValueError(f"no exact split: key {row.key!r} identifies more than one row")
    return SplitCut(key, spec.seed, row.digest, row.key, rows, wanted)


def with_split(df: DataFrame, key: str, spec: SplitSpec) -> DataFrame:
    """Add ``split`` (``train`` or ``val``), so that one pass can write both parts."""
    cut = split_cut(df, key, spec)
    return df.withColumn("split", F.when(cut.is_val(), "val").otherwise("train"))


def split_part(
    df: DataFrame, split: str, key: str, spec: SplitSpec
) -> tuple[DataFrame, int | None]:
    """``split_rows``, with the number of rows where finding the cut has counted them."""
    check_split(split)
    if split == "val":
        cut = split_cut(df, key, spec)
        return df.filter(cut.is_val()), cut.val_rows
    if split == "train" and spec.strict:
        cut = split_cut(df, key, spec)
        return df.filter(~cut.is_val()), cut.train_rows
    return df, None


def split_rows(df: DataFrame, split: str, key: str, spec: SplitSpec) -> DataFrame:
    """The rows one mode sees.

    ``val`` sees the validation part, ``train`` the rest if the split is strict and all
    rows otherwise; ``test`` and ``predict`` see all rows.
    """
    return split_part(df, split, key, spec)[0]
