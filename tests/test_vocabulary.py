import os

import pytest
from pyspark.sql import functions as F

from sftprep.functions.tokens import tokenize
from sftprep.operators.vocabulary import (
    VOCAB_SCHEMA,
    Vocabulary,
    _found_in,
    append_special,
    build_vocab,
    count_tokens,
    extend_vocab,
)


def vocab(spark, tokens, freq=1):
    return spark.createDataFrame([(t, i, freq) for i, t in enumerate(tokens)], VOCAB_SCHEMA)


def ids_of(df):
    return {r.token: r.id for r in df.collect()}


def test_build(spark):
    df = spark.createDataFrame([(["b", "a", "b", "<r>"],), (["c", "a", "<r>"],), ([],), (None,)], "tokens array<string>")
    built = {r.token: (r.id, r.freq) for r in build_vocab(df, reserved=["<p>", "<r>"]).collect()}
    assert built == {"<p>": (0, 0), "<r>": (1, 2), "a": (2, 2), "b": (3, 2), "c": (4, 1)}


@pytest.mark.parametrize("new", [0, 127, 128, 129, 300])
def test_extension_is_cut_to_whole_groups(spark, new):
    base = vocab(spark, ["a", "가"])
    words = ["가", "b", *[chr(0xAC01 + i) for i in range(new)]]
    other = vocab(spark, words).withColumn("freq", F.col("id").cast("bigint"))
    extended = ids_of(extend_vocab(base, other))
    kept = new // 128 * 128
    assert len(extended) == 2 + kept
    newest = [chr(0xAC01 + i) for i in reversed(range(new))][:kept]
    assert [extended[t] for t in newest] == list(range(2, 2 + kept))


def test_special_tokens_are_added_once(spark):
    assert ids_of(append_special(vocab(spark, ["a", "<t>"]), ["<t>", "<u>", "<u>", "<v>"])) == {
        "a": 0,
        "<t>": 1,
        "<u>": 2,
        "<v>": 3,
    }
    assert ids_of(append_special(vocab(spark, []), ["x"])) == {"x": 0}


WORDS = ["<pad>", "<unk>", " ", *[f"w{i}" for i in range(40)]]


@pytest.mark.parametrize("shipped", [1000, 8, 1])
def test_lookups_round_trip(spark, shipped):
    table = Vocabulary(vocab(spark, WORDS), "<unk>", max_tokens=shipped)
    assert table._head[1] is (shipped == 1000)
    texts = ["w1 w39 w1", "", "w7 other w30", None, "w12"]
    df = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    cut = df.select("key", "text", tokenize(F.col("text")).alias("tokens"))
    ids = table.encode(cut, "key", "tokens", "ids")
    back = table.decode(ids, "key", "ids", "back", skip=[1])
    rows = {r.key: r for r in back.collect()}
    index = {w: i for i, w in enumerate(WORDS)}
    assert rows[0].ids == [index["w1"], 2, index["w39"], 2, index["w1"]]
    assert rows[1].ids == [] and rows[1].back == ""
    assert rows[2].ids == [index["w7"], 2, 1, 2, index["w30"]]
    assert rows[3].ids is None and rows[3].back is None
    assert [rows[k].back for k in (0, 2, 4)] == ["w1 w39 w1", "w7  w30", "w12"]


def test_the_head_keeps_the_byte_bound(spark):
    table = Vocabulary(vocab(spark, ["x" * 10] * 1 + [f"{i:010d}" for i in range(63)]), "x", max_bytes=320)
    assert table._head == (32, False)


def test_markers_must_be_known(spark):
    with pytest.raises(ValueError, match="lacks"):
        Vocabulary(vocab(spark, ["a"]), "a").ids(["b"])


def test_counts_shrink_before_the_shuffle(spark):
    df = spark.range(10).select(F.array(F.lit("a"), F.lit("b")).alias("tokens"))
    plan = count_tokens(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange hashpartitioning(token")


def test_hot_and_unknown_items_of_the_tail(spark):
    table = Vocabulary(vocab(spark, WORDS), "<unk>", max_tokens=8)
    rows = [(k, ["nowhere"] * 30 + ["w39"] * 20 + [f"w{k % 40}", f"new{k}"]) for k in range(120)]
    df = spark.createDataFrame(rows, "key int, tokens array<string>")
    index = {w: i for i, w in enumerate(WORDS)}
    found = {r.key: r.ids for r in table.encode(df, "key", "tokens", "ids").collect()}
    assert found == {k: [index.get(t, 1) for t in own] for k, own in rows}


def test_the_table_of_the_tail_shuffles_once_for_any_partitions(spark):
    elements = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "__key int, __at int, __item string")
    rest = spark.createDataFrame([("a", 7)], "__item string, __found int")
    plan = _found_in(rest, elements)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "Generate" not in plan
    assert [tuple(r) for r in _found_in(rest, elements).collect()] == [("a", 1, 0, 7)]


def test_unknown_items_are_not_shuffled_and_odd_keys_keep_their_ids(spark, tmp_path):
    """Elements that the table lacks stay out of the stored ones; null and repeated keys work."""
    table = Vocabulary(vocab(spark, WORDS), "<unk>", max_tokens=8)
    rows = [(k if k % 10 else None, ["w39", *[f"new{k}-{i}" for i in range(200)], "w1"]) for k in range(40)]
    rows.append((1, ["w38", "w39"]))
    df = spark.createDataFrame(rows, "key int, tokens array<string>")
    root = spark.conf.get("spark.checkpoint.dir") + "/sftprep"
    before = set(os.listdir(root)) if os.path.exists(root) else set()
    encoded = table.encode(df, "key", "tokens", "ids", keep=False)
    assert encoded.columns == ["key", "ids"]
    index = {w: i for i, w in enumerate(WORDS)}
    expect = sorted(([index.get(t, 1) for t in own], key or -1) for key, own in rows)
    assert sorted((r.ids, -1 if r.key is None else r.key) for r in encoded.collect()) == expect
    stored = [p for p in set(os.listdir(root)) - before if p.startswith("open-items")]
    assert spark.read.parquet(f"{root}/{stored[0]}").count() < 100  # of 8,042, 42 of them known
    back = table.decode(encoded, "key", "ids", "back").collect()
    assert sorted(r.back for r in back if "w38" in r.back) == ["w38w39"]
    assert len(back) == len(rows)
