"""Every query of the catalog against its DuckDB twin on the smallest tables."""

import pytest

from tallywright.plans import catalog, oracle

from .compare import compare, connect

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(oracle.ORACLE_SQL)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_twin(spark, con, name):
    same_columns, spark_only, twin_only, kinds, twin_kinds = compare(spark, con, catalog.QUERIES[name], oracle.ORACLE_SQL[name], SF)
    assert same_columns and not spark_only and not twin_only
    assert {c: TYPES.get(k, k) for c, k in kinds.items()} == twin_kinds
