"""Functions over literal rows against the rows they must give."""

from __future__ import annotations

import duckdb
import literal_cases
import oracle
import pytest


@pytest.mark.parametrize("name", sorted(literal_cases.CASES))
def test_case(spark, name):
    assert oracle.differences(literal_cases.CASES[name](spark, ""), duckdb.connect(), literal_cases.ROWS[name]) == ""
