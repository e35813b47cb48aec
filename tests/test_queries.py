"""Every registered interval query against DuckDB, on the smallest tables."""

import pytest

from chronoframe import queries

from .oracle import assert_agrees

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    assert_agrees(spark, SF, queries.QUERIES[name], queries.SQL[name])


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)
