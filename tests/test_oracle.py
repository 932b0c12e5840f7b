from __future__ import annotations

import pytest

from sluice import queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, queries.QUERIES[name], queries.SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry_keeps_every_document(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert set(entry.oracle_sql()) <= set(entry.queries())
