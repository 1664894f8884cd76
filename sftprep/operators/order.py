"""Dense row positions, epoch order, device padding and batch assignment."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ROWS_PER_BUCKET = 200_000
MAX_BUCKETS = 32_768
SAMPLES_PER_BUCKET = 24
BOUND_CHARS = 64


class Indexed(NamedTuple):
    """A frame with positions 0 .. rows-1, and that number of rows."""

    frame: DataFrame
    rows: int


def _bucket_count(df: DataFrame, rows: int) -> int:
    """Enough buckets to keep each sort small, and a few for every shuffle partition."""
    spread = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(MAX_BUCKETS, max(math.ceil(rows / ROWS_PER_BUCKET), min(spread, rows // 64))))


def _bounds(ranked: DataFrame, names: Sequence[str], rows: int, buckets: int) -> list[str]:
    """Bucket bounds as JSON structs, from a hash sample of about 24 keys a bucket.

    The sample depends on the keys alone, not on partitions or task order, and its size
    on the number of buckets, not on the data. Only the order of the bounds matters for
    the result, so an uneven sample costs balance, never correctness.
    """
    thin = max(1, rows // (buckets * SAMPLES_PER_BUCKET))
    sample = ranked.filter(F.pmod(F.xxhash64(*names), F.lit(thin)) == 0)
    keys = F.sort_array(F.collect_set(F.struct(*names)))
    every = F.greatest(F.lit(1), F.ceil(F.size("keys") / F.lit(buckets)))
    cuts = F.filter("keys", lambda _, i: (i > 0) & (i % every == 0))
    found = sample.agg(keys.alias("keys")).select(F.transform(cuts, lambda key: F.to_json(key)).alias("cuts"))
    return found.first().cuts


def _bucket_of(names: Sequence[str], bounds: list[str], key_type: T.StructType) -> Column:
    """Number of bounds at or below the key: a binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    table = F.from_json(F.lit("[" + ",".join(bounds) + "]"), T.ArrayType(key_type))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])

    def search(table: Column, key: Column) -> Column:
        def descend(last: Column, step: Column) -> Column:
            # get() beyond the table is null, which is not below any key
            return F.when(F.get(table, last + step) <= key, last + step).otherwise(last)

        return F.aggregate(steps, F.lit(-1), descend, lambda last: last + F.lit(1))

    if len(names) == 1:
        return search(table[names[0]], F.col(names[0]))
    # bound once, or every step would build the struct again
    return F.get(F.transform(F.array(F.struct(*names)), lambda key: search(table, key)), F.lit(0))


def index_rows(
    df: DataFrame, keys: Sequence[str | Column], name: str = "pos", rows: int | None = None
) -> Indexed:
    """Number the rows 0, 1, 2, ... in the order of ``keys``, which must be unique.

    A row's bucket is a pure function of its key (explicit bounds in the plan), so the
    pass that counts buckets and the pass that numbers rows agree whatever is retried or
    recomputed. Strings count with their first 64 characters there. Cost: passes over the keys alone for count, bounds and bucket sizes, and
    one shuffle of the rows; no task ever holds more than some buckets. Nulls in a key
    sort first. A key that occurs twice is an error, as its rows have no order.
    """
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    names = [f"__key{i}" for i in range(len(columns))]
    ranked = df.select("*", *[c.alias(n) for c, n in zip(columns, names)])
    # buckets go by a prefix of the key, so that bounds stay short however long a string is
    cut_names = []
    for n in names:
        cut_names.append(f"__cut{n}")
        text = isinstance(ranked.schema[n].dataType, T.StringType)
        ranked = ranked.withColumn(cut_names[-1], F.left(n, F.lit(BOUND_CHARS)) if text else F.col(n))
        if text:
            break
    only_keys = ranked.select(*cut_names)
    if rows is None:
        rows = only_keys.count()
    buckets = _bucket_count(df, rows)
    bounds = _bounds(only_keys, cut_names, rows, buckets) if buckets > 1 else []
    key_type = T.StructType([T.StructField(n, ranked.schema[n].dataType) for n in cut_names])
    key = F.struct(*names)
    bucket = _bucket_of(cut_names, bounds, key_type)

    sizes = dict(only_keys.groupBy(bucket.alias("bucket")).count().collect()) if bounds else {}
    first, offsets = 0, []
    for b in range(len(bounds) + 1):
        offsets.append(first)
        first += sizes.get(b, 0)
    offset = F.from_json(F.lit(str(offsets)), "array<bigint>")

    by_key = Window.partitionBy("__bucket").orderBy(*names)
    duplicate = key == F.lag(key).over(by_key)
    frame = (
        ranked.withColumn("__bucket", bucket)
        .withColumn("__rank", F.row_number().over(by_key))
        .withColumn("__duplicate", duplicate)
        .withColumn(
            name,
            F.when(
                F.col("__duplicate"),
                F.raise_error(F.concat(F.lit("row key occurs twice: "), F.to_json(key))).cast("bigint"),
            ).otherwise(F.get(offset, F.col("__bucket")) + F.col("__rank") - F.lit(1)),
        )
        .select(*[c for c in df.columns if c != name], name)
    )
    return Indexed(frame, rows)


def row_index(df: DataFrame, keys: Sequence[str | Column], name: str = "pos") -> DataFrame:
    return index_rows(df, keys, name).frame


def shuffle_key(key: str | Column, *salt: object) -> Column:
    """md5 of ``salt:...:key``: the same order on every engine and at every scale."""
    column = F.col(key) if isinstance(key, str) else key
    prefix = "".join(f"{part}:" for part in salt)
    return F.md5(F.concat(F.lit(prefix), column.cast("string")))


def epoch_order(
    df: DataFrame, key: str, split: str, seed: int, epoch: int, name: str = "visit"
) -> Indexed:
    """Position of each row in one epoch: shuffled anew for train, key order otherwise."""
    keys = [shuffle_key(key, seed, epoch), F.col(key)] if split == "train" else [F.col(key)]
    return index_rows(df, keys, name)


def pad_tail(df: DataFrame, rows: int, devices: int, pos: str = "pos") -> DataFrame:
    """Append copies of the last row until the number of rows is a multiple of ``devices``.

    The copies come out of the last row where it lies: no second scan and no union.
    """
    if rows == 0:
        raise ValueError("cannot pad an empty dataset")
    missing = -rows % devices
    if missing == 0:
        return df
    copies = F.when(F.col(pos) == rows - 1, F.lit(missing)).otherwise(F.lit(0))
    return df.withColumn(pos, F.explode(F.sequence(F.col(pos), F.col(pos) + copies)))


def assign_batches(
    df: DataFrame, devices: int, batch_size: int, pos: str = "pos"
) -> DataFrame:
    """Deal positions round-robin to the devices and cut each device's rows into batches."""
    return df.withColumns(
        {
            "device_num": F.pmod(F.col(pos), F.lit(devices)).cast("int"),
            "batch_idx": F.floor(F.col(pos) / F.lit(devices * batch_size)).cast("bigint"),
        }
    )
