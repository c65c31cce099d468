"""Every core query runs, and equals its SQL where it has one."""

import pytest

from glossmill.plans import registry
from tests.oracle import differences, duck


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, folder, con, name):
    df = registry.QUERIES[name](spark, folder)
    if name in registry.ORACLE:
        _, diff = differences(df, con, registry.ORACLE[name])
        assert not diff
    else:
        assert df.count() >= 0


def test_entry_adds_llm_queries_only_where_they_are():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_llm():
    from pathlib import Path

    import glossmill

    root = Path(glossmill.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "glossmill.llm" not in path.read_text(), path
