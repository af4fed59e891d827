"""The corpus queries that SQL expresses, against DuckDB."""

import oracle
import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert oracle.differences(QUERIES[name](spark, sf), oracle.connect(sf), ORACLE_SQL[name]) == ""
