"""The record kinds of the library, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sftprep.config import TokenSpec
from sftprep.functions.text import clean_generation
from sftprep.operators.conversations import assemble_conversations
from sftprep.operators.order import assign_batches, index_rows, pad_tail
from sftprep.operators.vocabulary import Vocabulary
from sftprep.plans.encoding import TableEncoder
from sftprep.plans.vocabulary import corpus_vocabulary

TOKENS = TokenSpec()
DEVICES = 7
BATCH = 4
BETA = 0.1
#: More than the turns of any conversation.
TURNS = 1_000_000
#: Rows that the smaller class of the preference pairs may be repeated to.
ROUNDS = 4096
INSTRUCTION = "Continue the text."


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each assistant turn: the conversation's first system text, the last user
    text before the turn, and the turn. ``record_id`` spells conversation and turn."""
    before = Window.partitionBy("conv_id").orderBy("turn")

    def so_far(role: str, pick):
        return pick(F.when(F.col("role") == role, F.col("text")), True).over(before)

    return (
        table(spark, sf_dir, "conversations")
        .select(
            (F.col("conv_id") * TURNS + F.col("turn")).alias("record_id"),
            "role",
            so_far("system", F.first).alias("instruction"),
            so_far("user", F.last).alias("input"),
            F.col("text").alias("response"),
        )
        .filter("role = 'assistant'")
        .drop("role")
    )


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One structural record for each document: language, source, text."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("lang").alias("instruction"),
        F.col("source").alias("input"),
        F.col("text").alias("response"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message lists."""
    return assemble_conversations(table(spark, sf_dir, "conversations"))


def preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and bad documents, paired by rank; ranks of the smaller class start over.

    The larger class goes round the smaller one many times where that is small: a rank is
    then met in up to ``ROUNDS`` parts, and the smaller side repeated for each of them.
    """
    labelled = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"
    )
    chosen, good = index_rows(labelled.filter("quality = 1"), ["doc_id"], "rank")
    rejected, bad = index_rows(labelled.filter("quality = 0"), ["doc_id"], "rank")
    fewer = max(min(good, bad), 1)
    rounds = min(max(good, bad) // fewer + 1, max(ROUNDS // fewer, 1))

    def placed(side: DataFrame, rank: str, larger: bool) -> DataFrame:
        turn = F.floor(F.col(rank) / F.lit(fewer)) % F.lit(rounds)
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(rounds - 1).cast("bigint")))
        side = side.withColumn("place", F.pmod(F.col(rank), F.lit(fewer)))
        return side.withColumn("turn", turn if larger else every)

    left = chosen.select(
        F.col("rank").alias("good"), F.col("source").alias("input"), F.col("text").alias("chosen")
    )
    right = rejected.select(F.col("rank").alias("bad"), F.col("text").alias("rejected"))
    left, right = placed(left, "good", good >= bad), placed(right, "bad", good < bad)
    return left.join(right, ["place", "turn"]).select(
        F.greatest("good", "bad").alias("pair"),
        F.lit(INSTRUCTION).alias("instruction"),
        "input",
        "chosen",
        "rejected",
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each four vectors in turn: policy and reference logits of one pair, scaled by 10."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 4).alias("pair"),
        (F.col("vec_id") % 4).alias("role"),
        F.transform("embedding", lambda x: x.cast("double") * 10).alias("x"),
    )
    names = ("chosen", "rejected", "ref_chosen", "ref_rejected")
    return (
        vectors.groupBy("pair")
        .agg(*[F.max(F.when(F.col("role") == i, F.col("x"))).alias(n) for i, n in enumerate(names)])
        .dropna(subset=list(names))
    )


def chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of message lists: each conversation as it is, and with its assistant's vowels as digits."""
    whole = conversations(spark, sf_dir)
    changed = F.transform(
        "messages",
        lambda m: F.struct(
            m["role"].alias("role"),
            F.when(m["role"] == "assistant", F.translate(m["content"], "aeiou", "43105")).otherwise(m["content"]).alias("content"),
        ),
    )
    return whole.select(
        F.col("conv_id").alias("pair"), F.col("messages").alias("chosen"), changed.alias("rejected")
    )


def step_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.floor(F.col("pair") / 10)
    return logits(spark, sf_dir).select(
        "*",
        F.concat(F.lit("run"), (step % 2).cast("string")).alias("run"),
        F.when(step % 3 == 0, "val").otherwise("train").alias("split"),
        F.floor(step / 20).alias("epoch"),
        step.alias("step"),
    )


def logged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logged step metrics."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_type").alias("split"),
        F.dayofmonth("ts").alias("epoch"),
        F.lit("value").alias("metric"),
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("batch_size"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as one finished trial."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("trial"))
        .agg(
            F.round(F.avg("value"), 6).alias("value"),
            F.count("*").alias("steps"),
            F.min("event_id").alias("first_step"),
        )
    )


_encoders: dict[tuple[str, str], TableEncoder] = {}


def encoder(spark: SparkSession, sf_dir: str) -> TableEncoder:
    """The tokenizer of the documents: its vocabulary is stored once for each session.

    It stands for a pretrained tokenizer, which jobs load rather than build.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _encoders:
        stored = corpus_vocabulary(table(spark, sf_dir, "documents"), reserved=TOKENS.reserved)
        _encoders[key] = TableEncoder(Vocabulary(stored, TOKENS.unk_token))
    return _encoders[key]


def predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Base rows with ``pos``, and a stand-in prediction for each position and padding row."""
    base, rows = index_rows(structural(spark, sf_dir), ["record_id"])
    dealt = assign_batches(pad_tail(base, rows, DEVICES), DEVICES, BATCH)
    shards = dealt.select(
        F.col("pos").alias("index"),
        clean_generation(F.concat(F.lit("Re: "), "input")).alias("response"),
        "device_num",
        "batch_idx",
    )
    return base, shards
