"""Every registered query of the library's own operators against its DuckDB form on the smallest tables."""

from __future__ import annotations

import pytest

from hustings.plans import load
from tests.oracle import same

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_oracle(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).columns
