from __future__ import annotations

import pytest

from sluice.llm import queries, sql
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, queries.QUERIES[name], sql.ORACLE_SQL[name], SF) == ""


def test_a_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
