import hashlib
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sftprep.config import SplitSpec
from sftprep.operators import order, split
from sftprep.sources import writers

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def test_positions_are_dense_and_in_key_order(spark):
    df = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("key"), (F.col("id") % 3).alias("g"))
    indexed = order.index_rows(df.repartition(7), [-F.col("g"), F.col("key")])
    rows = indexed.frame.collect()
    expected = sorted(rows, key=lambda r: (-r.g, r.key))
    assert indexed.rows == 5000
    assert [r.pos for r in expected] == list(range(5000))


def test_many_small_buckets_agree_with_one(spark, monkeypatch):
    df = spark.range(900).select((F.col("id") * 37 % 901).alias("k"), F.lit("x").alias("v"))
    monkeypatch.setattr(order, "_bucket_count", lambda *_: 50)
    many = {r.k: r.pos for r in order.row_index(df, ["k"]).collect()}
    monkeypatch.setattr(order, "_bucket_count", lambda *_: 1)
    assert many == {r.k: r.pos for r in order.row_index(df, ["k"]).collect()}


def test_a_third_of_the_rows_with_one_leading_key_stay_spread(spark, monkeypatch):
    monkeypatch.setattr(order, "_bucket_count", lambda *_: 16)
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    positioned = order.row_index(df, ["k", "id"])
    assert [r.pos for r in positioned.orderBy("k", "id").collect()] == list(range(3000))
    names = ["__key0", "__key1"]
    keys = df.select(F.col("k").alias("__key0"), F.col("id").alias("__key1"))
    bounds = order._bounds(keys, names, 3000, 16)
    sizes = keys.groupBy(order._bucket_of(names, bounds, keys.schema)).count().collect()
    assert max(r["count"] for r in sizes) < 3000 / 6


def test_null_keys_and_null_neighbours(spark):
    df = spark.createDataFrame([(None, "a"), ("x", "b"), ("", "c")], "k string, v string")
    assert {r.v: r.pos for r in order.row_index(df, ["k"]).collect()} == {"a": 0, "c": 1, "b": 2}


def test_a_repeated_key_is_an_error(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    with pytest.raises(Exception, match="row key occurs twice"):
        order.row_index(df, ["k"]).collect()


def test_an_empty_table_has_no_positions(spark):
    assert order.index_rows(spark.range(0), ["id"]).frame.collect() == []


@given(n=st.integers(1, 40), devices=st.integers(1, 9))
@SLOW
def test_padding_repeats_the_last_row(spark, n, devices):
    df = spark.range(n).withColumn("pos", F.col("id"))
    rows = order.pad_tail(df, n, devices).orderBy("pos").collect()
    assert len(rows) % devices == 0 and len(rows) - n < devices
    assert [r.pos for r in rows] == list(range(len(rows)))
    assert [r.id for r in rows[n:]] == [n - 1] * (len(rows) - n)


def test_padding_nothing_is_an_error(spark):
    with pytest.raises(ValueError, match="empty"):
        order.pad_tail(spark.range(0).withColumn("pos", F.col("id")), 0, 4)


def test_batches(spark):
    df = order.assign_batches(spark.range(11).withColumn("pos", F.col("id")), 2, 3)
    got = {r.pos: (r.device_num, r.batch_idx) for r in df.collect()}
    assert got == {p: (p % 2, p // 2 // 3) for p in range(11)}


def test_epochs_differ_and_repeat(spark):
    df = spark.range(200)
    visits = [
        {r.id: r.visit for r in order.epoch_order(df, "id", "train", 1, e).frame.collect()} for e in (0, 1, 0)
    ]
    assert visits[0] == visits[2] != visits[1]
    assert sorted(visits[0].values()) == list(range(200))
    plain = order.epoch_order(df, "id", "val", 1, 0).frame.collect()
    assert all(r.id == r.visit for r in plain)


@pytest.mark.parametrize("n, ratio", [(2, 0.01), (1000, 0.1), (1000, 0.333), (777, 0.01), (50, 0.98)])
def test_split_is_exact(spark, n, ratio, monkeypatch):
    monkeypatch.setattr(split, "SMALL_BUCKET", 3)  # refine prefixes even on small data
    spec = SplitSpec(ratio, seed=7)
    parts = {r.id: r.split for r in split.with_split(spark.range(n), "id", spec).collect()}
    ranked = sorted(range(n), key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i))
    assert {i for i, s in parts.items() if s == "val"} == set(ranked[: math.ceil(ratio * n)])


def test_modes(spark):
    df, spec = spark.range(100), SplitSpec(0.25)
    ids = {m: {r.id for r in split.split_rows(df, m, "id", spec).collect()} for m in ("train", "val", "test")}
    assert len(ids["val"]) == 25 and not ids["val"] & ids["train"]
    assert ids["val"] | ids["train"] == ids["test"] == set(range(100))
    loose = split.split_rows(df, "train", "id", SplitSpec(0.25, strict=False))
    assert loose.count() == 100
    with pytest.raises(ValueError, match="invalid split"):
        split.split_rows(df, "training", "id", spec)


def test_no_split_of_too_few_rows_or_repeated_keys(spark):
    with pytest.raises(ValueError, match="a part is empty"):
        split.split_cut(spark.range(1), "id", SplitSpec(0.5))
    same = spark.range(10).select(F.lit(1).alias("id"))
    with pytest.raises(ValueError, match="more than one row"):
        split.split_cut(same, "id", SplitSpec(0.5))


@given(n=st.integers(0, 60), shards=st.integers(1, 12))
@SLOW
def test_export_shards(spark, n, shards):
    df = spark.range(n).withColumn("pos", F.col("id"))
    export = writers.export_manifest(df, "id", F.lit(3), n, shards, stem="part")
    files = [r.file for r in export.manifest.orderBy("id").collect()]
    size = n // shards
    expected = [min(i // size, shards - 1) if size else shards - 1 for i in range(n)]
    assert files == [f"part-{s + 1:05d}-of-{shards:05d}" for s in expected]
    assert export.total_size.first().total_size == 3 * n


def test_split_rejects_null_keys(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",), ("c",)], "key string")
    with pytest.raises(ValueError, match="nulls"):
        split.with_split(df, "key", SplitSpec(ratio=0.5, seed=1))


def test_row_index_of_long_strings(spark):
    keys = [("x" * 100 + str(i),) for i in range(600)] + [("y" * 200_000,), ("a",)]
    df = spark.createDataFrame(keys, "key string")
    got = [r.key for r in order.row_index(df, ["key"]).orderBy("pos").collect()]
    assert got == sorted(k for k, in keys)
