"""Every registered query against its SQL, or at least that it runs."""

from __future__ import annotations

import pytest

from lexispark import plans
from tests.conftest import DATA

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, same, name):
    same(QUERIES[name](spark, DATA), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
