import csv
import random

import pytest

from sftprep.sources import readers
from sftprep.sources.quoted_lines import quoted_records


def cells(rng):
    kinds = ["a", 'say ""x""', "line\nbreak", "b,c", "d\r\ne", "", '"', "\n\n", "é" * rng.randrange(40)]
    return "".join(rng.choice(kinds) for _ in range(rng.randrange(1, 5)))


def written(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator=end, quoting=csv.QUOTE_ALL).writerows(rows)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_in_many_tasks_gives_the_same_rows(spark, tmp_path, small_splits, end):
    rng = random.Random(len(end))
    rows = [[str(k), "x" + cells(rng), "y" + cells(rng)] for k in range(400)]
    written(tmp_path / "d.csv", [["id", "a,b", "c"], *rows], end)
    read = readers.read_csv(spark, str(tmp_path / "d.csv"), ",", multi_line=True)
    assert read.columns == ["id", "a,b", "c"]
    assert sorted(map(list, read.collect())) == sorted(rows)
    lines = spark.read.text(str(tmp_path / "d.csv"))
    assert lines.rdd.getNumPartitions() > 10
    assert quoted_records(spark, str(tmp_path / "d.csv")).count() == 400


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    rows = [["1", "short"], ["2", "long\n" * 2000 + "end"], ["3", "x\ny"], ["4", "\n" * 3000]]
    written(tmp_path / "d.csv", [["id", "t"], *rows])
    read = readers.read_csv(spark, str(tmp_path / "d.csv"), ",", na_values=[], multi_line=True)
    assert sorted(map(list, read.collect())) == rows


def test_several_files_with_a_header_each(spark, tmp_path, small_splits):
    folder = tmp_path / "many"
    folder.mkdir()
    rows = [[[f"{f}-{k}", f"a\nb{k}" * 5] for k in range(60)] for f in range(3)]
    for f, own in enumerate(rows):
        written(folder / f"{f}.csv", [["id", "t"], *own])
    written(folder / "none.csv", [["id", "t"]])
    rows[2].append(["id", "t"])  # a row like the header is a row
    written(folder / "2.csv", [["id", "t"], *reversed(rows[2])])
    read = readers.read_csv(spark, str(folder), ",", multi_line=True)
    assert sorted(map(list, read.collect())) == sorted(sum(rows, []))
