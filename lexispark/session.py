"""A session with the defaults that the operators expect."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Send this package to the executors (once per application), for the functions that run in Python there. Without a session, to the active one's."""
    spark = spark or SparkSession.getActiveSession()
    context = spark.sparkContext if spark else None
    if context is None or context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="lexispark-")  # of the driver, which serves the archive
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/lexispark_code.zip", "w") as out:
        for path in sorted(Path(__file__).parent.rglob("*.py")):
            out.write(path, path.relative_to(Path(__file__).parents[1]))
    context.addPyFile(f"{folder}/lexispark_code.zip")
    _shipped.add(context.applicationId)


def get_session(app: str = "lexispark", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, UTC, Arrow on; `conf` keys use __ for dots. Cluster settings are left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
