"""The registered text queries against their SQL."""

from __future__ import annotations

import pytest

from chronoframe.llm import queries
from tests.oracle import assert_agrees


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    assert_agrees(spark, "/root/testdata/sf0.01", queries.QUERIES[name], queries.SQL[name])
