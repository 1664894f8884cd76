from types import SimpleNamespace

import pytest

from sftprep import storage


def session(setting, master):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: setting),
        sparkContext=SimpleNamespace(master=master),
    )


def test_the_folder_of_the_cluster_comes_first():
    assert storage.shared_root(session("s3a://bucket/shared/", "yarn")) == "s3a://bucket/shared"
    assert storage.shared_root(session("/shared", "local[2]")) == "/shared"


def test_only_a_local_session_makes_its_own():
    assert storage.shared_root(session(None, "local[2]")) == storage.shared_root(session(None, "local"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_root(session(None, "yarn"))


def test_stored_tables_are_new_each_time(spark):
    df = spark.range(3)
    first, second = storage.stored(df, "t"), storage.stored(df, "t")
    assert first.inputFiles() != second.inputFiles()
    assert sorted(r.id for r in second.collect()) == [0, 1, 2]


def test_temporary_tables_are_removed(spark):
    import os

    from sftprep import storage

    with storage.temporary_tables(spark):
        path = storage.shared_path(spark, "gone")
        spark.range(3).write.parquet(path)
        assert os.path.isdir(path)
    assert not os.path.exists(path)


def test_stored_tables_leave_no_shuffle_files(tmp_path):
    """In a process of its own, whose folders hold nothing else."""
    import subprocess
    import sys
    import textwrap
    from pathlib import Path

    job = """
        import sys, time
        from pathlib import Path
        from pyspark.sql import SparkSession
        from sftprep import storage

        local, shared = sys.argv[1:]
        spark = (
            SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
            .config("spark.local.dir", local).config("spark.checkpoint.dir", shared).getOrCreate()
        )
        before = spark.conf.get(storage.DROP_SHUFFLES, None)
        df = spark.range(50_000).selectExpr("id % 20000 as k", "id").groupBy("k").count()
        table = storage.stored(df.repartition(3, "count"), "t")
        files = lambda: list(Path(local).rglob("shuffle_*.data"))
        for _ in range(50):
            if not files():
                break
            time.sleep(0.2)
        assert not files(), files()
        assert spark.conf.get(storage.DROP_SHUFFLES, None) == before
        assert table.count() == 20_000 and df.count() == 20_000
    """
    args = [sys.executable, "-c", textwrap.dedent(job), str(tmp_path / "local"), str(tmp_path / "shared")]
    root = Path(__file__).resolve().parent.parent
    done = subprocess.run(args, cwd=root, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]


def test_what_is_stored_goes_to_workers_in_small_batches(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    @F.arrow_udf("int")
    def together(ids: pa.Array) -> pa.Array:
        return pa.array([len(ids)] * len(ids), pa.int32())

    df = spark.range(0, 100, 1, 1).select(together("id").alias("n"))
    before = spark.conf.get(storage.BATCH_ROWS)
    with storage.small_batches(spark, 30):
        small = storage.stored(df, "small")
    assert {r.n for r in small.collect()} == {30, 10} and spark.conf.get(storage.BATCH_ROWS) == before
    assert {r.n for r in storage.stored(df, "whole").collect()} == {100}
