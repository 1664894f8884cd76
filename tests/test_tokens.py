from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sftprep.functions import tokens

SLOW = settings(
    max_examples=6,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)
ARRAYS = st.lists(st.lists(st.integers(0, 3), max_size=20), min_size=1, max_size=60)


def starts_of(ids, pattern):
    return [i for i in range(len(ids) - len(pattern) + 1) if ids[i : i + len(pattern)] == pattern]


def expected_labels(ids, start, end):
    """Each start, in order, uses up the first end behind it."""
    labels, ends = [-100] * len(ids), starts_of(ids, end)
    for s in starts_of(ids, start):
        while ends and ends[0] <= s:
            ends.pop(0)
        stop = ends.pop(0) if ends else len(ids)
        labels[s + len(start) : stop] = ids[s + len(start) : stop]
    return labels


def frame(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, ids array<int>")


PATTERNS = [([1], [2]), ([1, 2], [3]), ([1, 1], [1]), ([0], [0, 1]), ([1, 2], [2])]


@given(rows=ARRAYS, patterns=st.sampled_from(PATTERNS))
@SLOW
def test_search_and_mask(spark, rows, patterns):
    start, end = patterns
    found = frame(spark, rows).select(
        "ids",
        tokens.find_pattern(F.col("ids"), start).alias("starts"),
        tokens.mask_labels(F.col("ids"), start, end).alias("labels"),
    )
    for row in found.collect():
        assert row.starts == starts_of(row.ids, start)
        assert row.labels == expected_labels(row.ids, start, end)


@given(rows=ARRAYS, patterns=st.sampled_from(PATTERNS), pad=st.integers(0, 4), left=st.booleans())
@SLOW
def test_masking_searches_real_tokens_only_but_agrees_with_the_padded_array(
    spark, rows, patterns, pad, left
):
    start, end = patterns
    labels = tokens.mask_padded_labels(F.col("ids"), start, end, 24, pad, left)
    for row in frame(spark, rows).select("ids", labels.alias("labels")).collect():
        fill = [pad] * (24 - len(row.ids))
        padded = fill + row.ids if left else row.ids + fill
        assert row.labels == expected_labels(padded, start, end)


def test_mask_examples(spark):
    start, end = [8, 7], [9]
    cases = {
        "no start": ([1, 2, 9], [-100, -100, -100]),
        "no end": ([8, 7, 1, 0, 0], [-100, -100, 1, 0, 0]),
        "end before start": ([9, 8, 7, 1], [-100, -100, -100, 1]),
        "two starts, one end": ([8, 7, 1, 8, 7, 2, 9, 3], [-100, -100, 1, 8, 7, 2, 9, 3]),
        "two turns": ([8, 7, 1, 9, 5, 8, 7, 2, 9], [-100, -100, 1, -100, -100, -100, -100, 2, -100]),
        "pattern longer": ([8], [-100]),
        "empty": ([], []),
    }
    df = frame(spark, [ids for ids, _ in cases.values()])
    got = df.select(tokens.mask_labels(F.col("ids"), start, end).alias("labels")).collect()
    assert [r.labels for r in got] == [labels for _, labels in cases.values()]


def test_padding_and_mask(spark):
    df = frame(spark, [[5, 6], [1, 2, 3], [1, 2, 3, 4], []])
    got = df.select(
        tokens.pad_ids(tokens.truncate(F.col("ids"), 3), 3, 0).alias("right"),
        tokens.pad_ids(tokens.truncate(F.col("ids"), 3), 3, 0, left=True).alias("left"),
        tokens.attention_mask(tokens.truncate(F.col("ids"), 3), 3).alias("mask"),
        tokens.attention_mask(tokens.truncate(F.col("ids"), 3), 3, left=True).alias("left_mask"),
    ).collect()
    assert [r.right for r in got] == [[5, 6, 0], [1, 2, 3], [1, 2, 3], [0, 0, 0]]
    assert [r.left for r in got] == [[0, 5, 6], [1, 2, 3], [1, 2, 3], [0, 0, 0]]
    assert [r.mask for r in got] == [[1, 1, 0], [1, 1, 1], [1, 1, 1], [0, 0, 0]]
    assert [r.left_mask for r in got] == [[0, 1, 1], [1, 1, 1], [1, 1, 1], [0, 0, 0]]


@given(texts=st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=40))
@SLOW
def test_tokens_rebuild_the_text(spark, texts):
    texts = [*texts, "<|im_start|>user\na<b<|x|>", "<<"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", tokens.tokenize(F.col("t")).alias("cut")).collect()
    for row in rows:
        assert "".join(row.cut) == row.t
        assert row.cut == tokens.tokenize_literal(row.t)


def test_strip_prompt_and_argmax(spark):
    df = spark.createDataFrame([([1, 2, 3], [1.0, 3.0, 3.0]), ([1], [2.0])], "s array<int>, x array<double>")
    got = df.select(tokens.strip_prompt(F.col("s"), F.lit(2)), tokens.argmax(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [([3], 1), ([], 0)]


def test_plugin_tokenizer_keeps_nulls(spark):
    made = []

    def factory():
        made.append(1)
        return lambda texts: [[len(t)] for t in texts]

    df = spark.createDataFrame([("abc",), (None,), ("",)], "t string")
    got = df.select(tokens.tokenizer_udf(factory)(F.col("t")).alias("ids")).collect()
    assert [r.ids for r in got] == [[3], None, [0]]


def test_token_types_are_dropped_if_present(spark):
    assert tokens.drop_token_types(spark.range(1).withColumn("token_type_ids", F.lit(0))).columns == ["id"]
    assert tokens.drop_token_types(spark.range(1)).columns == ["id"]


def plain_labels(ids, start, end, ignore=-100):
    """Start by start, each with the first end behind it that is not taken yet."""
    starts = [i for i in range(len(ids) - len(start) + 1) if ids[i : i + len(start)] == start]
    ends = [i for i in range(len(ids) - len(end) + 1) if ids[i : i + len(end)] == end]
    labels, free = [ignore] * len(ids), 0
    for s in starts:
        while free < len(ends) and ends[free] <= s:
            free += 1
        stop = ends[free] if free < len(ends) else len(ids)
        free += free < len(ends)
        for k in range(s + len(start), stop):
            labels[k] = ids[k]
    return labels


def test_span_labels_equal_the_plain_rule():
    import random

    import numpy as np

    from sftprep.functions.tokens import span_labels

    rng = random.Random(3)
    for _ in range(3000):
        ids = [rng.randrange(3) for _ in range(rng.randrange(25))]
        start = [rng.randrange(3) for _ in range(rng.randrange(1, 3))]
        end = [rng.randrange(3) for _ in range(rng.randrange(1, 3))]
        got = span_labels(np.array(ids, dtype=int), np.array(start), np.array(end), -100)
        assert got.tolist() == plain_labels(ids, start, end)


def test_a_plugin_gets_texts_and_ids_in_steps(spark, tmp_path):
    """No call gets a whole batch, nulls and order are kept."""
    rows = [(k, None if k % 7 == 0 else chr(97 + k % 26) * 2000) for k in range(2000)]
    df = spark.createDataFrame(rows, "k int, text string").coalesce(1)

    def tokenizer():
        def encode(texts):
            assert sum(map(len, texts)) <= 1 << 20, "a step is too large"
            return [list(t.encode()) for t in texts]

        return encode

    def detokenizer():
        def decode(ids):
            assert sum(map(len, ids)) <= 1 << 20, "a step is too large"
            return ["".join(map(chr, row)) for row in ids]

        return decode

    ids = df.select("k", tokens.tokenizer_udf(tokenizer)(F.col("text")).alias("ids"))
    back = ids.select("k", "ids", tokens.detokenizer_udf(detokenizer)(F.col("ids")).alias("back"))
    found = {r.k: (r.ids, r.back) for r in back.collect()}
    assert found == {k: (None if t is None else list(t.encode()), t) for k, t in rows}


def test_labels_of_many_rows_go_in_steps(spark):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 5 > 0, F.array(F.lit(7), F.lit(1), F.col("id").cast("int"), F.lit(9))).alias("ids")
    )
    labels = tokens.mask_padded_labels(F.col("ids"), [7, 1], [9], 600, 0)
    found = {r.id: r.labels for r in df.coalesce(1).select("id", labels.alias("labels")).collect()}
    for k in range(3000):
        if k % 5 == 0:
            assert found[k] is None
        else:  # the id 9 is an end itself
            assert found[k] == [-100, -100, -100 if k == 9 else k, *[-100] * 597]
