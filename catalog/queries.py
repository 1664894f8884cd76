"""One DataFrame query for each operator and job."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import shapes
from catalog.shapes import BATCH, BETA, DEVICES, TOKENS, table
from sftprep.config import BatchSpec, Recipe, SplitSpec
from sftprep.functions import chat, preference, templates, text, tokens
from sftprep.operators import conversations as assembly
from sftprep.operators import merge, metrics, order, split, vocabulary
from sftprep.operators.generation import GenerationOptions, generate
from sftprep.plans import predict as predict_plan
from sftprep.plans import prepare, report
from sftprep.plans import vocabulary as vocabulary_plan
from sftprep.sources import readers, writers
from sftprep.storage import shared_path, stored

SPLIT = SplitSpec(ratio=0.1, seed=2025)
RECIPE = Recipe(splits=SPLIT, tokens=TOKENS, batches=BatchSpec(DEVICES, BATCH))
SHARDS = 10
#: Longer than any turn of a conversation in tokens.
LONGEST = 1024
LATIN_ACCENTS = "À-ÿ"
#: Tokens with this letter are added in groups; longer than any document in tokens.
ADDED_CLASS, ADDED_GROUP, WHOLE = "ß", 16, 1 << 30
BLANKS = "　 \t"


def joined(items: Column | str, sep: str = " ") -> Column:
    column = F.col(items) if isinstance(items, str) else items
    return F.array_join(column.cast("array<string>"), sep)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# Scans, sources, sinks


def read_parquet(spark, sf_dir):
    df = readers.load_dataset(spark, sf_dir, "documents", "parquet", "train")
    return df.select("doc_id", "text", "lang", "source", "n_chars")


def _json_arrays(records, key, path):
    """JSON files that hold one array each, of about 4,096 records."""
    files = F.lit(records.count() // 4096 + 1)
    arrays = records.groupBy(F.pmod(F.xxhash64(key), files).alias("part")).agg(
        F.to_json(F.collect_list(F.struct(*records.columns))).alias("value")
    )
    arrays.write.partitionBy("part").text(path)


def read_json(spark, sf_dir):
    path = shared_path(spark, "arrays")
    records = shapes.structural(spark, sf_dir)
    _json_arrays(records, "record_id", path)
    schema = records.schema
    return readers.read_json(spark, path, lines=False, schema=schema).select(*records.columns)


def read_jsonl(spark, sf_dir):
    path = shared_path(spark, "lines")
    conversations = shapes.conversations(spark, sf_dir)
    conversations.write.json(path)
    read = readers.read_json(spark, path, lines=True, schema=conversations.schema)
    return read.select("conv_id", chat.render_chat(F.col("messages")).alias("prompt"))


def _delimited(spark, sf_dir, sep):
    path = shared_path(spark, "cells")
    docs(spark, sf_dir).select("doc_id", "lang", "source", "text").write.option("header", True).option(
        "sep", sep
    ).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return path


def read_csv(spark, sf_dir):
    path = _delimited(spark, sf_dir, ",")
    df = readers.read_csv(spark, path, na_values=[*readers.NA_VALUES, "src3"], multi_line=True)
    return df.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def read_tsv(spark, sf_dir):
    df = readers.read_csv(spark, _delimited(spark, sf_dir, "\t"), sep="\t", multi_line=True)
    return df.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def load_dataset(spark, sf_dir):
    """The same records through every format."""
    folder = shared_path(spark, "formats")
    records = shapes.structural(spark, sf_dir)
    records.write.parquet(f"{folder}/records.parquet")
    records.write.json(f"{folder}/records.jsonl")
    _json_arrays(records, "record_id", f"{folder}/records.json")
    for fmt, sep in (("csv", ","), ("tsv", "\t")):
        (
            records.write.option("header", True)
            .option("sep", sep)
            .option("escape", '"')
            .csv(f"{folder}/records.{fmt}")
        )
    frames = [
        readers.load_dataset(
            spark,
            folder,
            "records",
            fmt,
            "train",
            records.schema if fmt in ("json", "jsonl") else None,
            multi_line=True,
        ).select(
            F.lit(fmt).alias("format"),
            F.col("record_id").cast("bigint").alias("record_id"),
            "instruction",
            "input",
            "response",
        )
        for fmt in ("parquet", "json", "jsonl", "csv", "tsv")
    ]
    return merge.union_shards(*frames)


def write_prediction_shards(spark, sf_dir):
    """Rows of each shard directory, as partition discovery finds them."""
    path = shared_path(spark, "shards")
    writers.write_prediction_shards(shapes.predictions(spark, sf_dir)[1], path)
    written = spark.read.option("header", True).option("escape", '"').csv(path)
    return written.groupBy("device_num", F.col("batch_idx").cast("int").alias("batch_idx")).agg(
        F.count("*").alias("rows"), F.sum(F.col("index").cast("bigint")).alias("index_sum")
    )


def read_prediction_shards(spark, sf_dir):
    path = shared_path(spark, "shards")
    writers.write_prediction_shards(shapes.predictions(spark, sf_dir)[1], path)
    return readers.read_prediction_shards(spark, path)


def write_submission(spark, sf_dir):
    path = shared_path(spark, "submission")
    base, shards = shapes.predictions(spark, sf_dir)
    writers.write_submission(merge.merge_predictions(base, shards, "response"), path)
    read = readers.read_csv(spark, path, sep=",", multi_line=True)
    return read.withColumn("record_id", F.col("record_id").cast("bigint"))


def sharded_export(spark, sf_dir):
    """Item and file, read back from the written shards."""
    path = shared_path(spark, "export")
    df, rows = order.index_rows(docs(spark, sf_dir), ["doc_id"])
    writers.write_sharded_export(df, path, rows, SHARDS)
    return spark.read.parquet(path).select("doc_id", "file")


def sharded_export_manifest(spark, sf_dir):
    df, rows = order.index_rows(docs(spark, sf_dir).select("doc_id"), ["doc_id"])
    return writers.export_manifest(df, "doc_id", F.lit(8), rows, SHARDS).manifest


def sharded_export_size(spark, sf_dir):
    df, rows = order.index_rows(docs(spark, sf_dir), ["doc_id"])
    return writers.export_manifest(df, "doc_id", F.octet_length("text"), rows, SHARDS).total_size


# Projections, filters, predicates


def select_fields(spark, sf_dir):
    fields = {"instruction": "lang", "input": "source", "response": "text"}
    return text.select_fields(docs(spark, sf_dir), fields, keep=["doc_id"])


def fill_missing(spark, sf_dir):
    return text.fill_missing(shapes.structural(spark, sf_dir))


def strip_text(spark, sf_dir):
    padded = F.concat(F.lit(BLANKS), F.col("text"), F.lit("\n  "))
    return docs(spark, sf_dir).select("doc_id", text.strip_text(padded).alias("text"))


def project_turns(spark, sf_dir):
    """Turns with an extra field, reduced to role and content."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.array(F.struct("role", F.col("text").alias("content"), F.length("text").alias("size"))).alias(
            "messages"
        ),
    )
    kept = turns.select("conv_id", "turn", chat.project_turns(F.col("messages")).alias("m"))
    return kept.select("conv_id", "turn", F.inline("m"))


def drop_last_turn(spark, sf_dir):
    dropped = chat.drop_last_turn(F.col("messages"))
    return shapes.conversations(spark, sf_dir).select(
        "conv_id",
        F.size(dropped).alias("turns"),
        chat.render_chat(dropped).alias("prompt"),
    )


def drop_token_types(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", "n_chars", F.lit(0).alias("token_type_ids"))
    return tokens.drop_token_types(df)


def script_filter(spark, sf_dir):
    return docs(spark, sf_dir).select(
        "doc_id",
        text.contains_script(F.col("text"), LATIN_ACCENTS).alias("accented"),
        text.contains_script(F.col("text")).alias("hangul"),
    )


def clean_generation(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.clean_generation(F.col("text")).alias("text"))


# Splits, order, batches


def split_exact(spark, sf_dir):
    return split.with_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", SPLIT)


def split_mode(spark, sf_dir):
    ids = docs(spark, sf_dir).select("doc_id")
    seen = [
        ("train", split.split_rows(ids, "train", "doc_id", SPLIT)),
        ("train_all", split.split_rows(ids, "train", "doc_id", replace(SPLIT, strict=False))),
        ("val", split.split_rows(ids, "val", "doc_id", SPLIT)),
        ("test", split.split_rows(ids, "test", "doc_id", SPLIT)),
        ("predict", split.split_rows(ids, "predict", "doc_id", SPLIT)),
    ]
    return merge.union_shards(*[df.withColumn("mode", F.lit(mode)) for mode, df in seen])


def row_index(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return order.row_index(df, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "pos")


def pad_tail(spark, sf_dir):
    df, rows = order.index_rows(docs(spark, sf_dir).select("doc_id", "source"), ["doc_id"])
    return order.pad_tail(df, rows, DEVICES)


def epoch_shuffle(spark, sf_dir):
    ids = docs(spark, sf_dir).select("doc_id")
    return merge.union_shards(
        *[
            order.epoch_order(ids, "doc_id", mode, 2025, epoch).frame.select(
                F.lit(mode).alias("mode"), F.lit(epoch).alias("epoch"), "doc_id", "visit"
            )
            for mode, epoch in (("train", 0), ("train", 1), ("val", 1))
        ]
    )


def assign_batches(spark, sf_dir):
    df = order.row_index(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    return order.assign_batches(df, DEVICES, BATCH)


# Chat construction


def to_messages(spark, sf_dir):
    rows = text.fill_missing(shapes.structural(spark, sf_dir))
    full = chat.to_messages(F.col("instruction"), F.col("input"), F.col("response"))
    return rows.select("record_id", F.posexplode(full).alias("turn", "m")).select(
        "record_id", "turn", "m.role", "m.content"
    )


def render_chat(spark, sf_dir):
    rows = shapes.conversations(spark, sf_dir)
    return rows.select(
        "conv_id",
        chat.render_chat(F.col("messages")).alias("prompt"),
        chat.render_chat(F.col("messages"), add_generation_prompt=True).alias("open_prompt"),
    )


def render_template(spark, sf_dir):
    """Conversations with a thought in each assistant turn, by two templates, thinking on and off."""
    thought = F.concat(F.lit("<think>\n"), F.length("text").cast("string"), F.lit("\n</think>\n\n"))
    said = table(spark, sf_dir, "conversations").withColumn(
        "text", F.when(F.col("role") == "assistant", F.concat(thought, "text")).otherwise(F.col("text"))
    )
    messages = F.col("messages")
    return assembly.assemble_conversations(said).select(
        "conv_id",
        templates.render_template(messages, templates.CHATML_THINKING).alias("prompt"),
        templates.render_template(
            messages, templates.CHATML_THINKING, add_generation_prompt=True
        ).alias("thinking"),
        templates.render_template(
            messages, templates.CHATML_THINKING, add_generation_prompt=True, thinking=False
        ).alias("not_thinking"),
        templates.render_template(
            messages, templates.INSTRUCTION_BLOCKS, add_generation_prompt=True
        ).alias("blocks"),
    )


def prepare_template_sft(spark, sf_dir):
    """Prompts of the structural records by a template, open for generation without a thought."""
    recipe = replace(RECIPE, split="predict", template=templates.CHATML_THINKING)
    prompts = prepare.structural_prompts(shapes.structural(spark, sf_dir), "record_id", recipe)
    return prompts.frame.select("record_id", "pos", "device_num", "batch_idx", "prompt")


def assemble_conversations(spark, sf_dir):
    return shapes.conversations(spark, sf_dir).select(
        "conv_id",
        F.size("messages").alias("turns"),
        F.array_join("messages.role", ",").alias("roles"),
        F.array_join("messages.content", "\n").alias("contents"),
    )


def remap_markers(spark, sf_dir):
    prompt = chat.render_chat(F.col("messages"))
    changes = [
        ("<|im_start|>assistant", "[A]"),
        ("<|im_end|>", "[E]"),
        ("<|im_start|>user", "[U]"),
        ("<|im_start|>system", "[S]"),
    ]
    return shapes.conversations(spark, sf_dir).select(
        "conv_id", text.remap_markers(prompt, changes).alias("prompt")
    )


def render_pair(spark, sf_dir):
    pairs = stored(shapes.preference(spark, sf_dir), "pairs")
    recipe = replace(RECIPE, split="test")
    return prepare.preference_prompts(pairs, "pair", recipe, "structural").frame


# Tokens


def tokenize(spark, sf_dir):
    cut = tokens.tokenize(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(cut).alias("size"), joined(cut, "␟").alias("tokens"))


def _turn_tokens(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("turn_key"),
        tokens.tokenize(F.col("text")).alias("tokens"),
    )


def lookup_ids(spark, sf_dir):
    """Conversation turns by the vocabulary of the documents, so some tokens are unknown."""
    table_ids = shapes.encoder(spark, sf_dir).vocabulary
    ids = table_ids.encode(_turn_tokens(spark, sf_dir), "turn_key", "tokens", "ids")
    return ids.select("turn_key", joined("ids").alias("ids"))


def lookup_ids_by_join(spark, sf_dir):
    """The same with a head of 1,024 tokens shipped and the rest joined."""
    whole = shapes.encoder(spark, sf_dir).vocabulary
    small = vocabulary.Vocabulary(whole.table, TOKENS.unk_token, max_tokens=1024)
    ids = small.encode(_turn_tokens(spark, sf_dir), "turn_key", "tokens", "ids")
    return ids.select("turn_key", joined("ids").alias("ids"))


def truncate(spark, sf_dir):
    cut = tokens.truncate(tokens.tokenize(F.col("text")), 256)
    return docs(spark, sf_dir).select("doc_id", F.size(cut).alias("size"), joined(cut, "").alias("text"))


def _word_lengths() -> Column:
    """Token lengths stand in for ids where any integers will do."""
    return F.transform(tokens.tokenize(F.col("text")), F.length)


def pad_ids(spark, sf_dir):
    ids = _word_lengths()
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        joined(tokens.pad_ids(ids, LONGEST, 0)).alias("right_padded"),
        joined(tokens.pad_ids(ids, LONGEST, 0, left=True)).alias("left_padded"),
    )


def attention_mask(spark, sf_dir):
    ids = _word_lengths()
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        joined(tokens.attention_mask(ids, LONGEST)).alias("right_padded"),
        joined(tokens.attention_mask(ids, LONGEST, left=True)).alias("left_padded"),
    )


def find_pattern(spark, sf_dir):
    return docs(spark, sf_dir).select(
        "doc_id",
        joined(tokens.find_pattern(_word_lengths(), [1, 2])).alias("pairs"),
        joined(tokens.find_pattern(_word_lengths(), [1, 3, 1])).alias("triples"),
    )


def mask_labels(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", _word_lengths().alias("ids"))
    return df.select("doc_id", joined(tokens.mask_labels(F.col("ids"), [2, 1], [9])).alias("labels"))


def mask_labels_padded(spark, sf_dir):
    """Searching only the real tokens, with the end pattern as padding."""
    turns = table(spark, sf_dir, "conversations")
    df = turns.select("conv_id", "turn", _word_lengths().alias("ids"))
    labels = tokens.mask_padded_labels(F.col("ids"), [2, 1], [9], LONGEST, 9)
    return df.select("conv_id", "turn", joined(labels).alias("labels"))


def full_labels(spark, sf_dir):
    """Without a mask every id is a label, padding included."""
    recipe = replace(RECIPE, is_sft=False, split="test")
    frame = prepare.prepare_sft(
        shapes.structural(spark, sf_dir), "record_id", shapes.encoder(spark, sf_dir), recipe
    ).frame
    return frame.select("record_id", joined("encoded.labels").alias("labels"))


def strip_prompt(spark, sf_dir):
    stripped = tokens.strip_prompt(_word_lengths(), F.lit(100))
    return docs(spark, sf_dir).select("doc_id", joined(stripped).alias("ids"))


def decode_ids(spark, sf_dir):
    """Text -> ids -> text; the spaces, as a stand-in for special tokens, left out."""
    encoder = shapes.encoder(spark, sf_dir)
    cut = docs(spark, sf_dir).select("doc_id", tokens.tokenize(F.col("text")).alias("tokens"))
    ids = encoder.vocabulary.encode(cut, "doc_id", "tokens", "ids", keep=False)
    space = encoder.literal_ids(" ")
    return encoder.vocabulary.decode(ids, "doc_id", "ids", "text", skip=space).select("doc_id", "text")


def argmax(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", tokens.argmax(F.col("embedding")).alias("pred"))


# Vocabulary


def build_vocab(spark, sf_dir):
    cut = docs(spark, sf_dir).select(tokens.tokenize(F.col("text")).alias("tokens"))
    return vocabulary.build_vocab(cut, reserved=TOKENS.reserved)


def extend_vocab(spark, sf_dir):
    documents = docs(spark, sf_dir)
    base = vocabulary_plan.corpus_vocabulary(documents.filter("lang = 'en'"))
    other = vocabulary_plan.corpus_tokens(documents.filter("lang <> 'en'"))
    return vocabulary.extend_vocab(base, other, LATIN_ACCENTS)


def append_special(spark, sf_dir):
    base = vocabulary_plan.corpus_vocabulary(docs(spark, sf_dir), reserved=TOKENS.reserved)
    return vocabulary.append_special(base, ["<think>", " ", "</think>"])


# Merging predictions


def merge_predictions(spark, sf_dir):
    base, shards = shapes.predictions(spark, sf_dir)
    return merge.merge_predictions(base, shards, "response")


def union_shards(spark, sf_dir):
    _, shards = shapes.predictions(spark, sf_dir)
    return merge.union_shards(shards.filter("device_num < 3"), shards.filter("device_num >= 3"))


def sort_by_index(spark, sf_dir):
    return merge.sort_by_index(shapes.predictions(spark, sf_dir)[1]).select("index", "response")


def count_guard(spark, sf_dir):
    """Coverage when the shards of one device are missing."""
    base, shards = shapes.predictions(spark, sf_dir)
    return merge.coverage(base, shards.filter("device_num <> 3"))


def count_guard_trim(spark, sf_dir):
    """Shards without the rows that padding added."""
    base, shards = shapes.predictions(spark, sf_dir)
    return merge.count_guard(base, shards).select("index", "response")


# Metrics


def log_softmax(spark, sf_dir):
    probs = preference.log_softmax(F.transform("embedding", lambda x: x.cast("double") * 10))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(probs).alias("element", "p")).select(
        "vec_id", "element", F.round("p", 6).alias("p")
    )


def relative_logprob(spark, sf_dir):
    both = metrics.relative_logprobs(shapes.logits(spark, sf_dir))
    pairs = F.arrays_zip("relative_chosen", "relative_rejected")
    return both.select("pair", F.posexplode(pairs).alias("element", "e")).select(
        "pair",
        "element",
        F.round("e.relative_chosen", 6).alias("chosen"),
        F.round("e.relative_rejected", 6).alias("rejected"),
    )


def _preference_metrics(spark, sf_dir, *names):
    found = metrics.preference_metrics(shapes.logits(spark, sf_dir), BETA)
    return found.select(*[F.round(name, 6).alias(name) for name in names])


def dpo_loss(spark, sf_dir):
    return _preference_metrics(spark, sf_dir, "loss")


def mean_logprobs(spark, sf_dir):
    return _preference_metrics(spark, sf_dir, "chosen_logprob", "rejected_logprob")


def reward_accuracy(spark, sf_dir):
    return _preference_metrics(spark, sf_dir, "reward_accuracy")


def reward_margin(spark, sf_dir):
    return _preference_metrics(spark, sf_dir, "reward_margin")


def epoch_metrics(spark, sf_dir):
    means = metrics.epoch_metrics(shapes.logged_metrics(spark, sf_dir))
    return means.withColumn("value", F.round("value", 6))


def best_trial(spark, sf_dir):
    trials = shapes.trials(spark, sf_dir)
    return merge.union_shards(
        *[
            metrics.best_trial(trials, ["steps", "first_step"], direction).withColumn(
                "direction", F.lit(direction)
            )
            for direction in ("min", "max")
        ]
    )


def write_best_trial(spark, sf_dir):
    """The written parameters, read back."""
    path = shared_path(spark, "best-trial")
    best = metrics.best_trial(shapes.trials(spark, sf_dir), ["steps", "first_step"])
    writers.write_best_trial(best, path)
    return spark.read.schema("steps long, first_step long").json(path)


def row_counts(spark, sf_dir):
    return metrics.row_counts(split_mode(spark, sf_dir), ["mode"])


# Plug-ins


def echo_generator():
    """Stand-in for a model: the prompt, followed by its first real tokens once more."""

    def run(batch: pd.DataFrame, options: GenerationOptions):
        return [
            [*ids, *ids[mask.astype(bool)][: options.max_new_tokens]]
            for ids, mask in zip(batch["input_ids"], batch["attention_mask"])
        ]

    return run


def byte_tokenizer():
    return lambda texts: [list(t.encode("utf-8")) for t in texts]


ECHO = GenerationOptions(max_new_tokens=64, min_new_tokens=1, batch_size=BATCH)


def generate_sequences(spark, sf_dir):
    frame = predict_plan.prepare_predict(
        shapes.structural(spark, sf_dir), "record_id", shapes.encoder(spark, sf_dir), RECIPE
    ).frame
    inputs = frame.select("pos", "encoded.input_ids", "encoded.attention_mask")
    made = generate(inputs, echo_generator, ECHO)
    new = tokens.strip_prompt(F.col("sequences"), F.lit(TOKENS.data_max_length))
    return made.select("pos", joined(new).alias("ids"))


def tokenizer_plugin(spark, sf_dir):
    ids = tokens.tokenizer_udf(byte_tokenizer)(F.col("text"))
    digits = F.transform(ids, lambda b: F.lpad(F.hex(b), 2, "0"))
    return docs(spark, sf_dir).select("doc_id", F.array_join(digits, "").alias("bytes"))


# Jobs. Derived inputs are stored first, as the key column alone is read several times.


def _flat(df: DataFrame, keys, struct: str, prefix: str = "", labels: bool = True) -> DataFrame:
    fields = ["input_ids", "attention_mask"] + (["labels"] if labels else [])
    return df.select(*keys, *[joined(f"{struct}.{f}").alias(prefix + f) for f in fields])


def prepare_sft(spark, sf_dir):
    frame = prepare.prepare_sft(
        shapes.structural(spark, sf_dir), "record_id", shapes.encoder(spark, sf_dir), RECIPE
    ).frame
    return _flat(frame, ["record_id", "pos"], "encoded")


def prepare_sft_documents(spark, sf_dir):
    frame = prepare.prepare_sft(
        shapes.document_records(spark, sf_dir), "doc_id", shapes.encoder(spark, sf_dir), RECIPE
    ).frame
    return _flat(frame, ["doc_id", "pos"], "encoded")


def prepare_chat_sft(spark, sf_dir):
    frame = prepare.prepare_chat_sft(
        stored(shapes.conversations(spark, sf_dir), "conversations"),
        "conv_id",
        shapes.encoder(spark, sf_dir),
        replace(RECIPE, split="train"),
    ).frame
    return _flat(frame, ["conv_id", "pos"], "encoded")


def prepare_preference(spark, sf_dir):
    frame = prepare.prepare_preference(
        stored(shapes.preference(spark, sf_dir), "pairs"),
        "pair",
        shapes.encoder(spark, sf_dir),
        replace(RECIPE, split="test"),
    ).frame
    fields = ["input_ids", "attention_mask", "labels"]
    return frame.select(
        "pair",
        "pos",
        *[joined(f"encoded_choice.{f}").alias(f"chosen_{f}") for f in fields],
        *[joined(f"encoded_rejection.{f}").alias(f"rejected_{f}") for f in fields],
    )


def prepare_predict(spark, sf_dir):
    frame = predict_plan.prepare_predict(
        stored(shapes.conversations(spark, sf_dir), "conversations"),
        "conv_id",
        shapes.encoder(spark, sf_dir),
        RECIPE,
        "conversational",
    ).frame
    keys = ["conv_id", "pos", "device_num", "batch_idx"]
    return _flat(frame, keys, "encoded", labels=False)


def prepare_predict_preference(spark, sf_dir):
    frame = predict_plan.prepare_predict(
        stored(shapes.preference(spark, sf_dir), "pairs"),
        "pair",
        shapes.encoder(spark, sf_dir),
        RECIPE,
        preference=True,
    ).frame
    fields = ["input_ids", "attention_mask"]
    return frame.select(
        "pair",
        "pos",
        "device_num",
        "batch_idx",
        *[joined(f"encoded_choice.{f}").alias(f"chosen_{f}") for f in fields],
        *[joined(f"encoded_rejection.{f}").alias(f"rejected_{f}") for f in fields],
    )


def predict_and_merge(spark, sf_dir):
    return predict_plan.predict_and_merge(
        shapes.structural(spark, sf_dir),
        "record_id",
        shapes.encoder(spark, sf_dir),
        RECIPE,
        echo_generator,
        ECHO,
        shared_path(spark, "shards"),
        submission_path=shared_path(spark, "submission"),
    )


def extend_vocabulary(spark, sf_dir):
    documents = docs(spark, sf_dir)
    return vocabulary_plan.extend_vocabulary(
        documents.filter("lang = 'en'"),
        documents.filter("lang <> 'en'"),
        char_class=LATIN_ACCENTS,
        reserved=TOKENS.reserved,
    )


def encode_added_tokens(spark, sf_dir):
    """Documents in thinking marks, by the English vocabulary and tokens added to it; and back."""
    documents = docs(spark, sf_dir)
    base = vocabulary_plan.corpus_vocabulary(documents.filter("lang = 'en'"), reserved=TOKENS.reserved)
    encoder = vocabulary_plan.extended_encoder(
        base, documents.filter("lang <> 'en'"), TOKENS.unk_token, char_class=ADDED_CLASS, group=ADDED_GROUP
    )
    marked = F.concat(F.lit("<think>"), "text", F.lit("</think>")).alias("marked")
    ids = encoder.encode(documents.select("doc_id", marked), "doc_id", "marked", "ids", WHOLE, keep=False)
    back = encoder.decode(ids, "doc_id", "ids", "back", [])
    return back.select("doc_id", joined("ids").alias("ids"), "back")


def prepare_chat_preference(spark, sf_dir):
    """Conversational pairs, padded on the left."""
    frame = prepare.prepare_preference(
        stored(shapes.chat_preference(spark, sf_dir), "chat-pairs"),
        "pair",
        shapes.encoder(spark, sf_dir),
        replace(RECIPE, split="test", tokens=replace(TOKENS, left_padding=True)),
        "conversational",
    ).frame
    fields = ["input_ids", "attention_mask", "labels"]
    return frame.select(
        "pair",
        "pos",
        *[joined(f"encoded_choice.{f}").alias(f"chosen_{f}") for f in fields],
        *[joined(f"encoded_rejection.{f}").alias(f"rejected_{f}") for f in fields],
    )


def preference_report(spark, sf_dir):
    found = report.preference_report(shapes.step_logits(spark, sf_dir), BETA)
    return found.withColumn("value", F.round("value", 6))


QUERIES = {
    query.__name__: query
    for query in [
        read_parquet,
        read_json,
        read_jsonl,
        read_csv,
        read_tsv,
        load_dataset,
        write_prediction_shards,
        read_prediction_shards,
        write_submission,
        sharded_export,
        sharded_export_manifest,
        sharded_export_size,
        select_fields,
        fill_missing,
        strip_text,
        project_turns,
        drop_last_turn,
        drop_token_types,
        script_filter,
        clean_generation,
        split_exact,
        split_mode,
        row_index,
        pad_tail,
        epoch_shuffle,
        assign_batches,
        to_messages,
        render_chat,
        render_template,
        prepare_template_sft,
        assemble_conversations,
        remap_markers,
        render_pair,
        tokenize,
        lookup_ids,
        lookup_ids_by_join,
        truncate,
        pad_ids,
        attention_mask,
        find_pattern,
        mask_labels,
        mask_labels_padded,
        full_labels,
        strip_prompt,
        decode_ids,
        argmax,
        build_vocab,
        extend_vocab,
        append_special,
        merge_predictions,
        union_shards,
        sort_by_index,
        count_guard,
        count_guard_trim,
        log_softmax,
        relative_logprob,
        dpo_loss,
        mean_logprobs,
        reward_accuracy,
        reward_margin,
        epoch_metrics,
        best_trial,
        write_best_trial,
        row_counts,
        generate_sequences,
        tokenizer_plugin,
        prepare_sft,
        prepare_sft_documents,
        prepare_chat_sft,
        prepare_preference,
        prepare_predict,
        prepare_predict_preference,
        predict_and_merge,
        extend_vocabulary,
        encode_added_tokens,
        prepare_chat_preference,
        preference_report,
    ]
}
