"""The corpus pipeline: quality rules, toxicity, near duplicates, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps, with the columns of
``documents``; the last one returns the packed pieces. The harness writes every result as
Parquet and reads it again; ``run`` does the same in the shared folder.

Rows with a null text or without words go in the first stage, which rejects texts of few
words. Rows with a null id pass all stages, except that near duplicates among them stay.
An empty table gives empty results. Further columns are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sftprep.llm import jaccard_join, packing, quality, secret_scan, toxicity
from sftprep.llm.common import table
from sftprep.llm.queries import outside_fold
from sftprep.storage import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality.judge(docs, F.col("text"), F.col("lang"))
    return quality.keep(judged).select(docs.columns)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, by labels of four of the five folds of ids."""
    seen = table(spark, sf_dir, "labels").filter(outside_fold("doc_id", 5, 0))
    machine = toxicity.fit(docs, seen, "doc_id", F.col("text"), "toxic")
    scored = toxicity.score(docs, F.col("text"), machine)
    return scored.filter("predicted = 0").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents linked by similar shingles the one with the smallest id."""
    joined = jaccard_join.jaccard_join(docs, "doc_id", F.col("text"), percent=80, width=5)
    first = joined.filter("doc_id = component_id").select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy("text")
    kept = docs.join(first.hint("merge"), "doc_id").withColumn("__copy", F.row_number().over(one))
    kept = kept.filter("__copy = 1").select(docs.columns)
    return kept.unionByName(docs.filter("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, a mask in place of every secret; ``n_chars`` follows the text."""
    scanner = secret_scan.fit(docs, F.col("text"))
    redacted = secret_scan.redact(docs, "text", scanner)
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences of at most 4096 tokens."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(docs, "doc_id", F.col("text"), tokenizer, 4096)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]

#: Trained models and tokenizers decide here, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


PIPELINE = {"pipeline": run}
PIPELINE_SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
