"""The corpus queries that have SQL give the rows that DuckDB finds with it."""

import pytest
from oracle import SF_DIR, compare, connect

from siltstone.llm import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    with connect() as con:
        assert compare(name, registry.queries()[name](spark, SF_DIR), ORACLES[name], con)
