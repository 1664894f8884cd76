"""Records of delimited files whose quoted cells hold line breaks, in as many tasks as splits.

Whether a line begins inside a quoted cell depends on all quotes before it. Counting quotes
needs no order: one pass adds them up for each split of a file, and the running sum over the
splits tells for each one whether it begins inside a cell. With that every task puts its own
lines together to records. A record that crosses the end of its split is left in pieces, at
most two for each split, which are joined in a small table of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIELDS = "file string, split long, part int, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files as they stand, with the file and the start of their split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("value"),
    )


def _open_splits(lines: DataFrame, quote: str) -> list[tuple[str, int]]:
    """The splits that begin inside a quoted cell; the driver gets one row for each."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit(quote)))
    odd = lines.groupBy("file", "split").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1
    rows = odd.select("file", "split", inside.alias("inside")).filter("inside").collect()
    return [(r["file"], r["split"]) for r in rows]


def _records_of(inside: set[tuple[str, int]], quote: str):
    def flush(file: str, split: int, part: int, pieces: list[str]) -> tuple:
        return file, split, part, "\n".join(pieces)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, open_, first, top = None, [], False, False, False

        def end(out: list[tuple]) -> None:
            """What the split leaves open goes on in the next one."""
            if held:
                out.append(flush(*at, 2 if not first else 0, held))

        for batch in batches:
            files = batch.column(0).to_pylist()
            splits = batch.column(1).to_numpy(zero_copy_only=False)
            values = batch.column(2).to_pylist()
            odd = pc.count_substring(batch.column(2), quote).to_numpy(zero_copy_only=False) % 2
            out: list[tuple] = []
            edges = np.flatnonzero(np.diff(splits) != 0) + 1
            edges = sorted({0, *edges.tolist(), *(k for k in range(1, len(files)) if files[k] != files[k - 1])})
            for lo, hi in zip(edges, [*edges[1:], len(values)]):
                if at != (files[lo], int(splits[lo])):
                    end(out)
                    at, held = (files[lo], int(splits[lo])), []
                    open_ = first = at in inside  # first: in the end of an earlier split's record
                    top = at[1] == 0  # the file's first record is still to come
                for value, change in zip(values[lo:hi], odd[lo:hi]):
                    held.append(value)
                    open_ ^= bool(change)
                    if not open_:
                        named = top and any(x.strip() for x in held)
                        out.append(flush(*at, 0 if first else 3 if named else 1, held))
                        held, first, top = [], False, top and not named
            if out:
                yield _batch(out)
        if at is not None and held:
            out = []
            end(out)
            yield _batch(out)

    return records


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
    columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["file", "split", "part", "record"])


def quoted_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """The records ``(file, split, record)`` of delimited files, but for each file's header.

    The header is the first record that is not blank, and lies in the file's first split.

    Quotes within a cell are doubled, and cells that hold a quote are quoted, as writers do.
    Lines end at a line feed; a carriage return before it stays in the record. A file may be
    one record, then its pieces meet in one row. Blank lines are records.
    """
    lines = _lines(spark, path)
    inside = set(_open_splits(lines, quote))
    found = lines.mapInArrow(_records_of(inside, quote), FIELDS)
    whole = found.filter("part = 1").select("file", "split", "record")
    # part 3 is a header; part 2 opens a record that part 0 of later splits goes on with
    pieces = found.filter("part in (0, 2)")
    in_order = Window.partitionBy("file").orderBy("split", "part")
    pieces = pieces.withColumn("nth", F.sum((F.col("part") == 2).cast("int")).over(in_order))
    joined = pieces.groupBy("file", "nth").agg(
        F.min("split").alias("split"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("split", "part", "record"))), lambda x: x["record"]
            ),
            "\n",
        ).alias("record"),
    )
    return whole.unionByName(joined.select("file", "split", "record"))
