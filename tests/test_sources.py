import json

import pytest

from sftprep.config import ColumnNames
from sftprep.operators import metrics
from sftprep.sources import readers, writers


def structural(spark):
    return spark.createDataFrame(
        [("i", 'a, "b" \\', "x\ny"), (None, "NA", ""), (" s ", "null", "한")],
        "instruction string, input string, response string",
    )


def test_csv_cells(spark, tmp_path):
    (tmp_path / "d.csv").write_text(
        'instruction,input,response\n"a, ""b"" \\","x\ny",\nNA,null,None\n s ,#N/A,"NA"\n"",1,nan\n',
        encoding="utf-8",
    )
    df = readers.load_dataset(spark, str(tmp_path), "d", "csv", "train", multi_line=True)
    rows = [tuple(r) for r in df.collect()]
    assert rows == [
        ('a, "b" \\', "x\ny", None),
        (None, None, None),
        (" s ", None, None),
        (None, "1", None),
    ]


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_the_delimiter_is_guessed(spark, tmp_path, sep):
    (tmp_path / "d.csv").write_text(sep.join(["instruction", "input", "response"]) + f"\na{sep}b{sep}c\n")
    df = readers.load_dataset(spark, str(tmp_path), "d", "csv", "val", multi_line=True)
    assert df.columns == ["instruction", "input", "response"]
    assert [tuple(r) for r in df.collect()] == [("a", "b", "c")]


def test_tsv(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("a\tb\n1,2\tx\n")
    assert [tuple(r) for r in readers.load_dataset(spark, str(tmp_path), "d", "tsv", "test", multi_line=True).collect()] == [
        ("1,2", "x")
    ]


def test_columns_go_by_name(spark, tmp_path):
    (tmp_path / "d.csv").write_text("response,extra,input\nr,e,d\n")
    row = readers.load_dataset(spark, str(tmp_path), "d", "csv", "test", multi_line=True).select("input", "response").first()
    assert tuple(row) == ("d", "r")


def test_json_array_and_lines(spark, tmp_path):
    records = [{"messages": [{"role": "user", "content": "a\nb"}]}, {"messages": []}, {"messages": None}]
    (tmp_path / "d.json").write_text(json.dumps(records, indent=1))
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, records)))
    schema = readers.record_schema("conversational")
    for fmt in ("json", "jsonl"):
        rows = readers.load_dataset(spark, str(tmp_path), "d", fmt, "train", schema, multi_line=True).collect()
        assert [r.messages and [tuple(t) for t in r.messages] for r in rows] == [[("user", "a\nb")], [], None]


def test_wrong_arguments_fail_before_any_job(spark):
    with pytest.raises(ValueError, match="invalid split"):
        readers.load_dataset(spark, "/nowhere", "d", "csv", "training")
    with pytest.raises(ValueError, match="unsupported dataset format"):
        readers.load_dataset(spark, "/nowhere", "d", "xlsx", "train")
    with pytest.raises(ValueError, match="unknown data type"):
        readers.record_schema("tabular")


def test_record_schemas():
    names = ColumnNames(chosen="good", rejected="bad")
    assert readers.record_schema("structural", True, names).names == ["instruction", "input", "good", "bad"]
    assert readers.record_schema("conversational", True, names).names == ["good", "bad"]


def test_messages_in_a_cell(spark):
    df = spark.createDataFrame([('[{"role": "user", "content": "x"}]',)], "messages string")
    assert [tuple(t) for t in readers.parse_messages(df, "messages").first().messages] == [("user", "x")]


@pytest.mark.parametrize("per_batch", [True, False])
def test_shards_round_trip(spark, tmp_path, per_batch):
    path = str(tmp_path / "shards")
    rows = [(0, ' a, "q" ', 0, 0), (1, None, 1, 0), (2, "", 0, 1), (3, "NA", 1, 1)]
    df = spark.createDataFrame(rows, "index bigint, response string, device_num int, batch_idx bigint")
    writers.write_prediction_shards(df, path, per_batch=per_batch)
    got = sorted(tuple(r) for r in readers.read_prediction_shards(spark, path).collect())
    batch = [0, 0, 1, 1]
    assert got == [
        (0, ' a, "q" ', 0, batch[0]),
        (1, None, 1, batch[1]),
        (2, None, 0, batch[2]),
        (3, None, 1, batch[3]),
    ]
    with pytest.raises(Exception, match="already exists"):
        writers.write_prediction_shards(df, path, per_batch=per_batch)


@pytest.mark.parametrize("rows", [200, 2000])
def test_shard_files_are_bounded(spark, tmp_path, rows):
    path = str(tmp_path / "shards")
    df = spark.range(rows, numPartitions=16).selectExpr(
        "id as index", "string(id) as response", "int(id % 3) as device_num", "id div 10 as batch_idx"
    )
    writers.write_prediction_shards(df, path, files_per_device=2)
    assert len(list((tmp_path / "shards").glob("*/part-*.csv"))) <= 6
    assert readers.read_prediction_shards(spark, path).count() == rows


def test_best_trial_is_one_json_object(spark, tmp_path):
    trials = spark.createDataFrame([(0, 2.0, 0.1), (1, 1.0, 0.2)], "trial int, value double, lr double")
    writers.write_best_trial(metrics.best_trial(trials, ["lr"]), str(tmp_path / "best"))
    (part,) = (tmp_path / "best").glob("part-*")
    assert json.loads(part.read_text()) == {"lr": 0.2}
    empty = metrics.best_trial(trials.filter("false"), ["lr"])
    writers.write_best_trial(empty, str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none")).count() == 0


def test_flat_shard_names(spark, tmp_path):
    (tmp_path / "device_num=2-batch_idx=13.csv").write_text("index,answer\n5,x\n6,\n")
    (tmp_path / "notes.txt").write_text("no shard")
    rows = readers.read_prediction_shards(spark, str(tmp_path), "answer").collect()
    assert sorted(tuple(r) for r in rows) == [(5, "x", 2, 13), (6, None, 2, 13)]


def test_submission_keeps_row_order(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(500).selectExpr("id as pos", "concat(' ', id) as response").repartition(5)
    writers.write_submission(df, path)
    lines = [
        line
        for part in sorted((tmp_path / "out").glob("part-*.csv"))
        for line in part.read_text().splitlines()
        if line != "response"
    ]
    assert lines == [f" {i}" for i in range(500)]


def test_structural_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "d.csv")
    writers.csv_writer(structural(spark)).csv(path)
    rows = [tuple(r) for r in readers.read_csv(spark, path, ",", multi_line=True).collect()]
    assert set(rows) == {("i", 'a, "b" \\', "x\ny"), (None, None, None), (" s ", None, "한")}
