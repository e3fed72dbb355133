"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import oracle
from quillspark.plans import catalog


@pytest.fixture(scope="module")
def con():
    return oracle.database()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) & set(catalog.ORACLE_SQL)))
def test_query_agrees_with_sql(spark, con, name):
    assert oracle.differences(catalog.QUERIES[name](spark, oracle.SMALL), con, catalog.ORACLE_SQL[name]) == ""


def test_entry_gives_ranked_rows(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and {r["rank"] for r in rows} == set(range(1, 11))
