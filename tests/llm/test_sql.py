"""Queries of the llm problems that SQL can express equal their SQL; every other one runs."""

import pytest

from glossmill.llm import registry
from tests.oracle import differences, duck


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", registry.ORACLE)
def test_query_equals_its_sql(spark, folder, con, name):
    _, diff = differences(registry.QUERIES[name](spark, folder), con, registry.ORACLE[name])
    assert not diff


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE])
def test_query_runs_with_a_stable_schema(spark, folder, name):
    df = registry.QUERIES[name](spark, folder)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
