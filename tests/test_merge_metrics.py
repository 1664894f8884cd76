import json
import math

import pytest
from pyspark.sql import functions as F

from sftprep.functions.preference import log_softmax
from sftprep.operators import merge, metrics
from sftprep.operators.conversations import assemble_conversations
from sftprep.operators.generation import GenerationOptions, generate
from sftprep.plans.report import preference_report


def base(spark, n=3):
    return spark.range(n).select(F.lit("old").alias("response"), F.col("id").alias("pos"))


def shards(spark, rows):
    return spark.createDataFrame(rows, "index bigint, response string")


def test_merge_overwrites_by_position(spark):
    merged = merge.merge_predictions(base(spark), shards(spark, [(2, "c"), (0, None), (3, "pad"), (1, "b")]), "response")
    assert sorted(tuple(r) for r in merged.select("pos", "response").collect()) == [(0, None), (1, "b"), (2, "c")]


@pytest.mark.parametrize(
    "rows, message",
    [([(0, "a"), (2, "c")], "no prediction for position 1"), ([(0, "a"), (1, "b"), (1, "b"), (2, "c")], "several predictions for position 1")],
)
def test_merge_fails_on_holes_and_repeats(spark, rows, message):
    with pytest.raises(Exception, match=message):
        merge.merge_predictions(base(spark), shards(spark, rows), "response").collect()


def test_count_guard(spark):
    with pytest.raises(ValueError, match="1 of 3 positions have no prediction, the first is 1"):
        merge.count_guard(base(spark), shards(spark, [(0, "a"), (2, "c")]))
    with pytest.raises(ValueError, match="repeat"):
        merge.count_guard(base(spark, 1), shards(spark, [(0, "a"), (0, "b")]))
    trimmed = merge.count_guard(base(spark, 1), shards(spark, [(0, "a"), (7, "b")]))
    assert [tuple(r) for r in trimmed.collect()] == [(0, "a")]


def test_one_exchange_a_side_for_pre_aggregation_and_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        merged = merge.merge_predictions(base(spark), shards(spark, [(0, "a")]), "response")
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


def test_generate_runs_in_batches(spark):
    def factory():
        def run(batch, options):
            assert len(batch) <= options.batch_size
            return [[*ids, int(sum(mask))] for ids, mask in zip(batch.input_ids, batch.attention_mask)]

        return run

    df = spark.range(10).selectExpr("id as pos", "array(1, cast(id as int)) as input_ids", "array(0, 1) as attention_mask")
    got = generate(df, factory, GenerationOptions(batch_size=3)).collect()
    assert {r.pos: r.sequences for r in got} == {i: [1, i, 1] for i in range(10)}


def test_a_generator_must_answer_every_prompt(spark):
    df = spark.range(2).selectExpr("id as pos", "array(1) as input_ids", "array(1) as attention_mask")
    with pytest.raises(Exception, match="0 sequences"):
        generate(df, lambda: lambda batch, options: [], GenerationOptions()).collect()


def softmax(x):
    top = max(x)
    total = math.log(sum(math.exp(v - top) for v in x))
    return [v - top - total for v in x]


def test_log_softmax_does_not_overflow(spark):
    rows = [[1000.0, -1000.0, 0.0], [0.5, 0.5], [3.0]]
    df = spark.createDataFrame([(r,) for r in rows], "x array<double>")
    for row in df.select("x", log_softmax(F.col("x")).alias("p")).collect():
        assert row.p == pytest.approx(softmax(row.x))


PAIRS = [
    (0, [1.0, 2.0], [2.0, 1.0], [0.0, 0.0], [0.0, 1.0]),
    (1, [900.0, 0.0, 3.0], [1.0, 1.0, 1.0], [0.0, 5.0, 1.0], [2.0, 2.0, 2.0]),
    (2, [], [], [], []),
]


def test_preference_metrics_are_means_over_elements(spark):
    schema = "pair int, " + ", ".join(f"{c} array<double>" for c in metrics.POLICY_AND_REFERENCE)
    df = spark.createDataFrame([*PAIRS, (3, None, [1.0], [1.0], [1.0])], schema)
    elements = []
    for _, c, r, rc, rr in PAIRS[:2]:
        c, r, rc, rr = map(softmax, (c, r, rc, rr))
        elements += [(a - x, b - y) for a, b, x, y in zip(c, r, rc, rr)]
    n = len(elements)
    expected = {
        "loss": sum(max(-0.5 * (c - r), 0) + math.log1p(math.exp(-abs(0.5 * (c - r)))) for c, r in elements) / n,
        "chosen_logprob": sum(c for c, _ in elements) / n,
        "rejected_logprob": sum(r for _, r in elements) / n,
        "reward_accuracy": sum(c > r for c, r in elements) / n,
        "reward_margin": sum(c - r for c, r in elements) / n,
    }
    assert metrics.preference_metrics(df, 0.5).first().asDict() == pytest.approx(expected)
    relative = metrics.relative_logprobs(df.filter("pair = 1")).first()
    assert relative.relative_chosen == pytest.approx([c for c, _ in elements[2:]])
    keyed = df.filter("pair < 2").selectExpr("*", "'r' as run", "'val' as split", "0 as epoch", "0 as step")
    report = {r.metric: r.value for r in preference_report(keyed, 0.5).collect()}
    assert report == pytest.approx(expected)


def test_arrays_of_a_row_must_agree(spark):
    schema = ", ".join(f"{c} array<double>" for c in metrics.POLICY_AND_REFERENCE)
    df = spark.createDataFrame([([1.0], [1.0, 2.0], [1.0], [1.0])], schema)
    with pytest.raises(Exception, match="differ in length"):
        metrics.preference_metrics(df, 0.1).collect()


def test_epoch_means_are_weighted(spark):
    rows = [("r", "val", 0, "loss", 1.0, 3), ("r", "val", 0, "loss", 2.0, 1), ("r", "val", 0, "loss", None, 9), ("r", "val", 1, "loss", 4.0, 0)]
    df = spark.createDataFrame(rows, "run string, split string, epoch int, metric string, value double, batch_size int")
    assert {r.epoch: r.value for r in metrics.epoch_metrics(df).collect()} == {0: 1.25, 1: None}


def test_best_trial(spark):
    rows = [(3, 1.0, 0.1), (1, 1.0, 0.2), (2, 5.0, 0.3), (4, 5.0, 0.4), (0, float("nan"), 0.5), (5, None, 0.6)]
    df = spark.createDataFrame(rows, "trial bigint, value double, lr double")
    low, high = (metrics.best_trial(df, ["lr"], d).first() for d in ("min", "max"))
    assert (low.trial, low.value, json.loads(low.params)) == (1, 1.0, {"lr": 0.2})
    assert (high.trial, json.loads(high.params)) == (2, {"lr": 0.3})
    assert metrics.best_trial(df.filter("trial = 0"), ["lr"]).collect() == []
    with pytest.raises(ValueError, match="direction"):
        metrics.best_trial(df, ["lr"], "lowest")


def test_conversations(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(1500)] + [(2, 0, "system", None)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(5)
    got = {r.conv_id: r.messages for r in assemble_conversations(df).collect()}
    assert [m.content for m in got[1]] == [f"t{t}" for t in range(1500)]
    assert [tuple(m) for m in got[2]] == [("system", None)]


def test_merge_keeps_the_place_of_the_target(spark):
    base = spark.createDataFrame([(0, "old", 1.0)], "pos long, response string, score double")
    shards = spark.createDataFrame([(0, "new")], "index long, response string")
    merged = merge.merge_predictions(base, shards, "response")
    assert merged.columns == ["pos", "response", "score"]
    assert merged.first().response == "new"
