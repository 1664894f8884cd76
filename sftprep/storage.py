"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that removes an execution's shuffle files when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the rows in a batch that goes to a Python worker.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="sftprep-")


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_root()


_scopes: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end of the block, every table that was stored within it.

    Results that read such tables must have been written by then.
    """
    _scopes.append([])
    try:
        yield
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _scopes.pop():
            place = hadoop(path)
            place.getFileSystem(conf).delete(place, True)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; nothing is ever written twice to it."""
    path = f"{shared_root(spark)}/sftprep/{label}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get at most so many rows at once in what is stored within the block."""
    given = int(spark.conf.get(BATCH_ROWS))
    with _setting(spark, BATCH_ROWS, str(min(given, rows) if given > 0 else rows)):
        yield


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives later reads column
    pruning and pushdown. For results that several passes read again. The shuffle
    files of the write go with its end, not when the driver collects its garbage.
    """
    path = shared_path(df.sparkSession, label)
    with _setting(df.sparkSession, DROP_SHUFFLES, "true"):
        df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
