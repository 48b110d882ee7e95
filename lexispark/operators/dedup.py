"""Unions, differences and duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.operators.join import keep_one


def union(*tables: DataFrame) -> DataFrame:
    """All rows by column name; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def merge_manifests(tables: dict[str, DataFrame]) -> DataFrame:
    """The union with each row's manifest, and the split and language that its name's parts tell."""
    known = {"train": "train", "dev": "validation", "valid": "validation", "validation": "validation", "test": "test"}

    def tagged(name: str, df: DataFrame) -> DataFrame:
        parts = name.lower().replace("-", "_").split("_")
        split = next((known[p] for p in parts if p in known), None)
        lang = next((p for p in parts if p in ("fr", "en", "ar", "ru", "de", "es")), None)
        return df.withColumns({"manifest": F.lit(name), "split": F.lit(split).cast("string"), "language": F.lit(lang).cast("string")})

    return union(*[tagged(n, t) for n, t in tables.items()])


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return keep_one(df, keys, order)


def distinct_lines(text: Column) -> Column:
    """A text without its repeated and empty lines, in order."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.array_distinct(lines), "\n")


def conflicting(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one value."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1")


def in_all(key: str, *tables: DataFrame) -> DataFrame:
    """The keys that all tables have."""
    return reduce(lambda a, b: a.intersect(b), [t.select(key) for t in tables])


def sorted_unique(df: DataFrame, key: str, order: str) -> DataFrame:
    return keep_one(df, [key], order).orderBy(key)
