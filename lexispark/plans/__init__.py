"""Registered queries: each applies operators to the standard tables and has, where SQL can say it, an equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexispark.plans import files, partitions, relational, sequences, speakers, stats, texts

MODULES = (stats, relational, sequences, partitions, texts, speakers, files)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
