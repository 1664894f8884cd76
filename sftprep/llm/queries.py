"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sftprep.llm import (
    bpe,
    hard_negatives,
    jaccard_join,
    katz,
    language_id,
    multiprobe,
    packing,
    pii,
    quality,
    secret_scan,
    token_counts,
    toxicity,
    vector_codes,
)
from sftprep.llm.common import table
from sftprep.llm.oracle import ORACLE  # noqa: F401 - registered with the queries


def outside_fold(doc_id: str, folds: int, fold: int) -> Column:
    """Whether ``crc32`` of an id as text leaves another rest than ``fold``; true for null."""
    rest = F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
    return F.coalesce(rest != fold, F.lit(True))


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scanner = secret_scan.fit(docs, F.col("text"))
    found = secret_scan.scan(docs, F.col("text"), scanner)
    return found.select(
        "doc_id",
        "n_findings",
        F.size("secrets").cast("long").alias("n_secrets"),
        secret_scan.spell(F.col("secrets")).alias("spans"),
    )


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    judged = quality.judge(docs, F.col("text"), F.col("lang"))
    return judged.drop("text", "lang")


def op3_multiprobe_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    asks = F.col("vec_id") % 100 == 0
    return multiprobe.search(rows, F.col("vec_id"), F.col("embedding"), asks, 10)


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.with_digests(docs, F.col("text"), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_katz_backoff(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return katz.score(docs, "doc_id", F.col("text"), folds=7, fold=2)


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    counted = token_counts.with_token_counts(docs, F.col("text"), model, 4096)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.find(docs, F.col("text")).drop("text")


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_join(docs, "doc_id", F.col("text"), percent=90, width=3)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    seen = table(spark, folder, "labels").filter(outside_fold("doc_id", 5, 0))
    machine = toxicity.fit(docs, seen, "doc_id", F.col("text"), "toxic")
    scored = toxicity.score(docs, F.col("text"), machine)
    return scored.select("doc_id", (~outside_fold("doc_id", 5, 0)).alias("held_out"), "score", "predicted")


def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.pack_documents(docs, "doc_id", F.col("text"), tokenizer, 4096)
    return packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    learned = docs.filter(outside_fold("doc_id", 5, 0))
    profiles = language_id.learn(learned, F.col("text"), F.col("lang"))
    named = language_id.identify(docs, F.col("text"), profiles)
    held_out = ~outside_fold("doc_id", 5, 0)
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    asks = F.col("vec_id") % 100 == 0
    return hard_negatives.mine(rows, F.col("vec_id"), F.col("embedding"), label, asks)


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    return vector_codes.encode(rows, F.col("vec_id"), F.col("embedding"), F.col("label"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_multiprobe_search": op3_multiprobe_search,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_katz_backoff": op5_katz_backoff,
    "op6_token_counts": op6_token_counts,
    "op7_pii": op7_pii,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_toxicity": op9_toxicity,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_language_id": op11_language_id,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_vector_codes": op13_vector_codes,
}
