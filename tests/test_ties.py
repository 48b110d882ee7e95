"""Queries on rows where a rounding decides, against their SQL."""

from __future__ import annotations

import datetime
import random

import duckdb
import pytest

from lexispark import plans
from tests.conftest import rounded


@pytest.fixture
def matches(spark, tmp_path):
    """Compares a query with its SQL on events of one's own."""

    def compare(name, events):
        spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").repartitionByRange(3, "event_id").sortWithinPartitions("event_id").write.parquet(f"{tmp_path}/events.parquet")
        con = duckdb.connect(config={"threads": 1})  # adds rows up in their order
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        found = con.execute(plans.oracle_sql()[name])
        names = [c[0] for c in found.description]
        rows = found.fetchall()
        df = plans.queries()[name](spark, str(tmp_path))
        assert rounded([tuple(r) for r in df.collect()], df.columns) == rounded(rows, names)
        return rows

    return compare


def test_session_gap_has_a_fraction(matches):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    events = [(1, at(0), 1, "a", 1.0), (2, at(3600.5), 1, "a", 1.0), (3, at(0), 2, "a", 1.0), (4, at(3600), 2, "a", 1.0), (5, at(7201), 2, "a", 1.0), (6, None, 2, "a", 1.0), (7, None, 3, "a", 1.0)]
    assert sorted((u, n) for u, _, _, _, n in matches("session_windows", events)) == [(1, 1), (1, 1), (2, 2), (2, 2), (3, 1)]


def test_votes_add_up_in_row_order(matches):
    """0.1 and 0.5 have no exact sum: whether two answers tie depends on the order of the rows."""
    r = random.Random(5)
    events = [(i, None, r.randrange(300), r.choice("ab"), r.choice([10.0, 10.0, 30.0, 60.0])) for i in range(9000)]
    assert len(matches("vote_winner", events)) > 200
