"""Written tables that operators cut lineage with."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local tests (where it is unset) a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="lexispark-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return _own["dir"]


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written once to a folder of its own and read back."""
    path = f"{folder(df.sparkSession)}/lexispark/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
