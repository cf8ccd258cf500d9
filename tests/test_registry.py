"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from registry.core import ORACLE, QUERIES
from tests.compare import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, sf_dir, name):
    seen = {}
    assert compare(spark, con, sf_dir, QUERIES[name], ORACLE[name], seen) is None
    assert seen["rows"] > 0
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in seen["plan"]


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
