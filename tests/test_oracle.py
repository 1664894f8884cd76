"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as contract

duckdb = pytest.importorskip("duckdb")
FOLDER = contract.SMOKE_DIR
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def value(x):
    return None if isinstance(x, float) and math.isnan(x) else x


def rows(names, data):
    places = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(row[i]) for i in places) for row in data), key=repr)


def test_every_query_has_its_sql():
    assert contract.QUERIES.keys() == contract.ORACLE.keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", sorted(contract.QUERIES))
def test_query(spark, database, name):
    found = contract.queries()[name](spark, FOLDER)
    expected = database.sql(contract.oracle_sql()[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found.columns, found.collect()) == rows(expected.columns, expected.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_functions_reach_workers_that_cannot_import_the_packages(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from catalog.queries import byte_tokenizer

    (tmp_path / "f").write_bytes(cloudpickle.dumps(byte_tokenizer))
    code = "import pickle; print(pickle.load(open('f', 'rb'))()(['ab']))"
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60
    )
    assert done.stdout.strip() == "[[97, 98]]", done.stderr
