"""Every query with SQL must equal it, on two sizes of the given tables."""

from __future__ import annotations

import pytest
from oracle import differences

from marginalia.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001") is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
