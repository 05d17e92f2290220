"""The queries that SQL can express against their DuckDB twins."""

import pytest

from tallywright.llm import registry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_matches_twin(spark, name):
    same_columns, spark_only, twin_only, _, _ = compare(spark, connect(SF), registry.QUERIES[name], registry.ORACLE_SQL[name], SF)
    assert same_columns and not spark_only and not twin_only
