"""Prediction shards, submissions, sharded exports."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_writer(df: DataFrame):
    return (
        df.write.mode("errorifexists")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def write_prediction_shards(
    df: DataFrame,
    path: str,
    target: str = "response",
    per_batch: bool = False,
    files_per_device: int = 16,
) -> None:
    """Write ``index, target`` as CSV by device and batch; an existing ``path`` is an error.

    Directories go by device, and the batch is a column of the files. A device's batches go
    in turn to at most ``files_per_device`` files, however many tasks made them.
    ``per_batch=True`` makes a directory for every batch as well, which is only for small
    outputs.
    """
    levels = ["device_num", "batch_idx"] if per_batch else ["device_num"]
    shards = df.select("index", target, "batch_idx", "device_num")
    if per_batch:
        shards = shards.repartition(*levels)
    else:
        run = F.pmod(F.col("batch_idx"), F.lit(files_per_device))
        shards = shards.repartition("device_num", run)
    csv_writer(shards).partitionBy(*levels).csv(path)


def write_best_trial(best: DataFrame, path: str, params: str = "params") -> None:
    """Write the parameters of the best trial, one JSON object in one line, as a text file.

    ``best`` is the row of ``best_trial``; without one there is no line.
    """
    best.select(params).coalesce(1).write.mode("errorifexists").text(path)


def write_submission(df: DataFrame, path: str, pos: str = "pos") -> None:
    """Write the merged table as CSV part files with a header, in row order, without ``pos``.

    Part files are range partitioned, so reading them by name gives the order back.
    """
    columns = [c for c in df.columns if c != pos]
    csv_writer(df.orderBy(pos).select(*columns)).csv(path)


def shard_number(pos: Column, rows: int, shards: int) -> Column:
    """Contiguous runs of ``rows // shards`` items; the last shard takes the rest.

    With fewer items than shards every run is empty and the last shard takes all.
    """
    size = rows // shards
    if size == 0:
        return F.lit(shards - 1)
    return F.least(F.floor(pos / F.lit(size)), F.lit(shards - 1)).cast("int")


def shard_name(shard: Column, shards: int, stem: str = "model") -> Column:
    return F.format_string(f"{stem}-%05d-of-{shards:05d}", shard + F.lit(1))


class Export(NamedTuple):
    """Item -> file, and the total size in bytes (one row)."""

    manifest: DataFrame
    total_size: DataFrame


def export_manifest(
    df: DataFrame,
    key: str,
    size: Column,
    rows: int,
    shards: int,
    pos: str = "pos",
    stem: str = "model",
) -> Export:
    """Which file each item goes to, and how many bytes all of them take."""
    name = shard_name(shard_number(F.col(pos), rows, shards), shards, stem)
    return Export(
        df.select(key, name.alias("file")),
        df.agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("total_size")),
    )


def write_sharded_export(
    df: DataFrame,
    path: str,
    rows: int,
    shards: int,
    pos: str = "pos",
    stem: str = "model",
) -> None:
    """Write the items as Parquet, one directory ``file=<name>`` for every shard.

    Rows are range partitioned and sorted by position, so a part file holds a run of one
    shard in order, and there are at most as many part files as shards and partitions. A
    shard may take many of them, so its size is not that of a task.
    """
    name = shard_name(shard_number(F.col(pos), rows, shards), shards, stem)
    runs = df.withColumn("file", name).repartitionByRange("file", pos)
    runs = runs.sortWithinPartitions("file", pos)
    runs.write.mode("errorifexists").partitionBy("file").parquet(path)
