from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[3]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rounded(rows, names):
    """Rows as sorted strings, columns by name."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    one = lambda v: "%.9g" % v if isinstance(v, float) else str(v)
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same(duck):
    """Compares a DataFrame with what DuckDB makes of its SQL."""

    def compare(df, sql):
        found = duck.execute(sql)
        names = [c[0] for c in found.description]
        expected = rounded(found.fetchall(), names)
        assert sorted(df.columns) == sorted(names)
        assert rounded([tuple(r) for r in df.collect()], df.columns) == expected

    return compare
