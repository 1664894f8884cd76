from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sftprep.config import BatchSpec, Recipe, SplitSpec, TokenSpec
from sftprep.functions import chat, text, tokens
from sftprep.operators.generation import GenerationOptions
from sftprep.operators.vocabulary import VOCAB_SCHEMA, Vocabulary
from sftprep.plans import predict, prepare
from sftprep.plans.encoding import PluginEncoder, TableEncoder
from sftprep.sources.readers import messages_type

SPEC = TokenSpec(data_max_length=16, target_max_length=8)
RECIPE = Recipe(split="test", splits=SplitSpec(0.25), tokens=SPEC, batches=BatchSpec(2, 2))
WORDS = [*SPEC.reserved, "\n", " ", "hi", "yes", "_"]


@pytest.fixture(scope="module")
def encoder(spark):
    table = spark.createDataFrame([(w, i, 1) for i, w in enumerate(WORDS)], VOCAB_SCHEMA)
    return TableEncoder(Vocabulary(table, SPEC.unk_token))


@pytest.fixture(scope="module")
def records(spark):
    rows = [(i, None if i else " hi ", "hi", "yes yes" if i != 2 else None) for i in range(5)]
    return spark.createDataFrame(rows, "key bigint, instruction string, input string, response string")


def words(ids):
    return [WORDS[i] for i in ids]


def test_structural_example(encoder, records):
    prepared = prepare.prepare_sft(records, "key", encoder, RECIPE)
    row = prepared.frame.filter("pos = 0").first()
    assert prepared.rows == 5
    expected = tokens.tokenize_literal(
        "<|im_start|>system\nhi<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
        "<|im_start|>assistant\nyes yes<|im_end|>\n"
    )
    assert words(row.encoded.input_ids) == expected + ["<|pad|>"] * (24 - len(expected))
    assert row.encoded.attention_mask == [1] * len(expected) + [0] * (24 - len(expected))
    kept = [WORDS[i] for i in row.encoded.labels if i != -100]
    assert kept == ["\n", "yes", " ", "yes"]


def test_padding_with_the_end_token_and_on_the_left(encoder, records):
    spec = replace(SPEC, pad_token=None, left_padding=True)
    row = prepare.prepare_sft(records, "key", encoder, replace(RECIPE, tokens=spec)).frame.filter("pos = 0").first()
    assert words(row.encoded.input_ids)[:3] == ["<|im_end|>"] * 3
    assert [WORDS[i] for i in row.encoded.labels if i != -100] == ["\n", "yes", " ", "yes"]


def test_missing_values_become_turns(encoder, records):
    row = prepare.structural_prompts(records, "key", RECIPE).frame.filter("pos = 2").first()
    assert row.prompt.count("\n_<|im_end|>") == 2


def test_train_and_val_parts(encoder, records):
    sizes = {s: prepare.prepare_sft(records, "key", encoder, replace(RECIPE, split=s)) for s in ("train", "val")}
    assert (sizes["train"].rows, sizes["val"].rows) == (3, 2)
    assert [p.frame.count() for p in sizes.values()] == [3, 2]
    with pytest.raises(ValueError, match="invalid split"):
        replace(RECIPE, split="fit")


def test_full_labels(encoder, records):
    row = prepare.prepare_sft(records, "key", encoder, replace(RECIPE, is_sft=False)).frame.first()
    assert row.encoded.labels == row.encoded.input_ids


def test_predict_rows(encoder, records):
    prepared = predict.prepare_predict(records, "key", encoder, RECIPE)
    rows = prepared.frame.orderBy("pos").collect()
    assert prepared.rows == 5 and [r.pos for r in rows] == list(range(6))
    assert rows[5].encoded == rows[4].encoded and rows[5].device_num == 1
    assert "labels" not in rows[0].encoded.asDict()
    assert len(rows[0].encoded.input_ids) == 16
    opened = replace(RECIPE, split="predict", label_predict=True)
    assert "labels" in prepare.prepare_sft(records, "key", encoder, opened).frame.first().encoded.asDict()


def conversations(spark, rows):
    return spark.createDataFrame(rows, "key bigint, messages array<struct<role:string,content:string>>")


def test_chat_records(spark, encoder):
    turns = [("user", "hi"), ("assistant", "yes"), ("user", " hi"), ("assistant", "yes")]
    df = conversations(spark, [(1, turns), (2, [("user", "hi")])])
    rows = prepare.prepare_chat_sft(df, "key", encoder, RECIPE).frame.orderBy("pos").collect()
    assert [WORDS[i] for i in rows[0].encoded.labels if i != -100] == ["\n", "yes", "\n", "yes"]
    assert set(rows[1].encoded.labels) == {-100}
    single = replace(RECIPE, split="predict", batches=BatchSpec(1, 2))
    prompts = prepare.conversation_prompts(df, "key", single).frame.orderBy("pos").collect()
    assert prompts[1].prompt == "<|im_start|>assistant\n"
    assert prompts[0].prompt.endswith("<|im_start|>user\n hi<|im_end|>\n<|im_start|>assistant\n")


def test_null_conversations(spark, encoder):
    df = conversations(spark, [(1, None), (2, [("user", "hi")])])
    with pytest.raises(Exception, match="no conversation"):
        prepare.conversation_prompts(df, "key", RECIPE).frame.collect()
    assert prepare.conversation_prompts(df, "key", RECIPE, on_null="drop").rows == 1


def test_preference_records(spark, encoder):
    df = spark.createDataFrame(
        [(1, "i", "hi", "yes", None)], "key bigint, instruction string, input string, chosen string, rejected string"
    )
    row = prepare.prepare_preference(df, "key", encoder, RECIPE).frame.first()
    assert words(row.encoded_choice.input_ids).count("yes") == 1
    assert words(row.encoded_rejection.input_ids).count("_") == 1
    turns = df.select("key", *[F.array(F.struct(F.lit("assistant").alias("role"), F.lit(t).alias("content"))).cast(messages_type()).alias(c) for c, t in (("chosen", "yes"), ("rejected", "hi"))])
    row = prepare.prepare_preference(turns, "key", encoder, RECIPE, "conversational").frame.first()
    assert [WORDS[i] for i in row.encoded_choice.labels if i != -100] == ["\n", "yes"]
    assert [WORDS[i] for i in row.encoded_rejection.labels if i != -100] == ["\n", "hi"]


def test_plugin_encoder(spark, records):
    plugin = PluginEncoder(
        lambda: lambda batch: [[0] if t == SPEC.pad else [ord(c) for c in t] for t in batch]
    )
    row = prepare.prepare_sft(records, "key", plugin, RECIPE).frame.filter("pos = 0").first()
    assert row.encoded.input_ids == [ord(c) for c in "<|im_start|>system\nhi<|im_end|>"][:24]


def test_predict_and_merge(encoder, records, tmp_path):
    def factory():
        yes, line, end = WORDS.index("yes"), WORDS.index("\n"), WORDS.index("<|im_end|>")
        return lambda batch, options: [[*ids, yes, line, yes, end] for ids in batch.input_ids]

    merged = predict.predict_and_merge(
        records, "key", encoder, RECIPE, factory, GenerationOptions(batch_size=2), str(tmp_path / "g"), per_batch=True
    )
    rows = merged.orderBy("pos").collect()
    assert [(r.key, r.pos, r.response) for r in rows] == [(i, i, "yes yes") for i in range(5)]


def test_predict_with_a_plugin_encoder(spark, records, tmp_path):
    special = {token: i for i, token in enumerate(SPEC.special, 1)}

    def tokenizer():
        return lambda texts: [[special[t]] if t in special else [ord(c) for c in t] for t in texts]

    def decoder():
        return lambda rows: ["".join(map(chr, row)) for row in rows]

    recipe = replace(RECIPE, tokens=replace(SPEC, pad_token=None))
    merged = predict.predict_and_merge(
        records,
        "key",
        PluginEncoder(tokenizer, decoder),
        recipe,
        lambda: lambda batch, options: [[*ids, ord("o"), ord("k")] for ids in batch.input_ids],
        GenerationOptions(),
        str(tmp_path / "g"),
        submission_path=str(tmp_path / "s"),
    )
    assert [r.response for r in merged.collect()] == ["ok"] * 5
    header = spark.read.option("header", True).csv(str(tmp_path / "s")).columns
    assert header == records.columns


def test_preference_rows_continue_the_chosen_side(encoder, records, tmp_path):
    pairs = records.selectExpr("key", "instruction", "input", "response as chosen", "'hi' as rejected")
    yes = WORDS.index("yes")
    merged = predict.predict_and_merge(
        pairs,
        "key",
        encoder,
        RECIPE,
        lambda: lambda batch, options: [[*ids, yes] for ids in batch.input_ids],
        GenerationOptions(),
        str(tmp_path / "g"),
        preference=True,
    )
    assert [(r.chosen, r.rejected) for r in merged.collect()] == [("yes", "hi")] * 5


def test_row_local_functions_need_neither_shuffle_nor_python(spark):
    df = spark.createDataFrame([("a", "b", "c", [1, 2])], "i string, d string, t string, ids array<int>")
    prompt = chat.render_chat(chat.to_messages(text.strip_text(F.col("i")), F.col("d"), F.col("t")))
    out = df.select(
        prompt,
        tokens.truncate(tokens.tokenize(F.col("t")), 2),
        tokens.attention_mask(F.col("ids"), 4),
        text.clean_generation(F.col("t")),
    )
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_encoding_shuffles_the_rows_once_and_prunes_columns(spark, encoder, records, tmp_path):
    path = str(tmp_path / "r")
    many = records.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(99))))
    many.selectExpr("key * 100 + n as key", "instruction", "input", "response", "'x' as unused").write.parquet(path)
    prepared = prepare.prepare_sft(spark.read.parquet(path), "key", encoder, RECIPE)
    plan = prepared.frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SinglePartition" not in plan
    assert "unused" not in plan


def test_row_local_functions_run_on_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    conversations(spark, [(i, [("user", "hi")]) for i in range(20)]).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    prompts = stream.select("key", chat.render_chat(F.col("messages")).alias("prompt"))
    query = (
        prompts.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "log"))
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    assert spark.read.parquet(out).count() == 20
