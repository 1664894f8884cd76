"""Queries of the subpackage that have SQL against it, on the given tables."""

import os

import pytest

import __spark_entry__ as contract
from sftprep.llm.oracle import ORACLE

duckdb = pytest.importorskip("duckdb")
FOLDER = contract.SMOKE_DIR.replace("sf0.001", "sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = contract.queries()[name](spark, FOLDER)
    expected = connection.sql(contract.oracle_sql()[name])
    assert sorted(found.columns) == sorted(expected.columns)
    rows = found.select(*expected.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(expected.fetchall())
