"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; print one JSON line.

The given tables hold one row group each, which would bind every scan to one task. They
are first rewritten, untimed, as several files, the way tables of a cluster are stored;
BENCH_LAYOUT=given times them as they are. The better run counts; first runs stand beside it.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from catalog import shapes
from catalog.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
GIVEN = os.environ.get("BENCH_LAYOUT") == "given"
TABLES = ["documents", "conversations", "labels", "embeddings", "events", "orders"]
HEADLINE = [
    "prepare_sft",
    "prepare_sft_documents",
    "prepare_chat_sft",
    "prepare_preference",
    "prepare_predict",
    "predict_and_merge",
    "extend_vocabulary",
    "preference_report",
    "build_vocab",
    "lookup_ids",
    "decode_ids",
    "mask_labels",
    "row_index",
    "split_exact",
    "epoch_shuffle",
    "merge_predictions",
    "sharded_export",
    "epoch_metrics",
]


def session() -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def spread_tables(spark: SparkSession) -> str:
    if GIVEN:
        return SF_DIR
    folder = tempfile.mkdtemp(prefix="bench-")
    for name in TABLES:
        df = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        df.repartition(4 * int(CPUS)).write.parquet(f"{folder}/{name}.parquet")
    return folder


def run(spark: SparkSession, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    names = sys.argv[1:] or HEADLINE
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    folder = spread_tables(spark)
    start = time.perf_counter()
    shapes.encoder(spark, folder)  # the vocabulary, stored once for each session
    vocabulary = round(time.perf_counter() - start, 3)
    run(spark, folder, "prepare_sft")  # start the Python workers, compile the hot paths
    times, cold = {}, {}
    for name in names:
        each = [run(spark, folder, name) for _ in range(RUNS)]
        times[name], cold[name] = round(min(each), 3), round(each[0], 3)
        print(f"{name}: {min(each):.2f} s, first {each[0]:.2f} s", file=sys.stderr)
    spark.stop()
    sf = Path(SF_DIR).name.removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": total,
                "unit": "sec",
                "queries": times,
                "first_runs": cold,
                "vocabulary": vocabulary,
                "layout": "as given" if GIVEN else "32 files a table",
                "sf": sf,
            }
        )
    )


if __name__ == "__main__":
    main()
