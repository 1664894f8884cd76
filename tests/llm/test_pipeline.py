"""The stages against plain versions, on the smallest tables."""

import os
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from plain_join import component_of

FOLDER = contract.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(spark, results):
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert all(df.columns == columns for df in results[:-1])
    assert len(corpus_pipeline.STAGES) == 5


def test_quality_keeps_what_its_query_keeps(spark, results):
    judged = contract.queries()["op2_quality_rules"](spark, FOLDER)
    assert set(texts(results[0])) == {r.doc_id for r in judged.collect() if r.kept}


def test_one_document_of_each_group_stays(results):
    before, after = texts(results[1]), texts(results[2])
    component, _ = component_of(before, 80, 5)
    assert set(after) == set(component.values())
    assert all(before[k] == t for k, t in after.items())


def test_secrets_are_masked_and_the_rest_stays(results):
    strict = re.compile(r'AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}')
    before, after = texts(results[2]), texts(results[3])
    assert before.keys() == after.keys()
    assert after == {k: strict.sub("<secret>", t) for k, t in before.items()}
    assert all(r.n_chars == len(r.text) for r in results[3].collect())


def test_every_document_is_packed(results):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    given = texts(results[3])
    held = {r.doc_id: r.n for r in results[4].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert held == {k: len(encoder.encode(t, add_special_tokens=False).ids) + 1 for k, t in given.items()}
    fullest = results[4].groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert fullest <= 4096


def test_odd_rows_pass_without_harm(spark, docs, none):
    extra = docs.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for start in (extra, extra.filter("false")):
        given = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            given = spark.createDataFrame(stage(spark, given, FOLDER).collect(), given.schema)
            assert given.columns == extra.columns
        assert corpus_pipeline.packed(spark, given, FOLDER).count() >= given.count()
