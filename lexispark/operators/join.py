"""Keyed merges, lookups, pairings and interval joins.

Rows have no order in a DataFrame; where "last" or "first" counts, an order column says what that means.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """One whole row per key: the first (or last) by `order`. One aggregate with partial results, so a hot key is no hot task."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    row = pick(F.struct(*rest), F.col(order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def keyed_merge(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Inner join of the last row per key of either side; on a clash of columns the new side wins."""
    a, b = keep_one(old, keys, order, True).drop(order), keep_one(new, keys, order, True).drop(order)
    clash = [c for c in a.columns if c in b.columns and c not in keys]
    return a.drop(*clash).join(b, keys)


def unmatched(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that only one side has, with its name."""
    only = lambda x, y, side: x.select(*keys).distinct().join(y.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit(side))
    return only(old, new, "old").unionByName(only(new, old, "new"))


def lookup_merge(rows: DataFrame, table: DataFrame, keys: list[str], order: str, table_wins: bool = True) -> DataFrame:
    """Each row with its key's last table row (inner); adaptive execution broadcasts the table if its size allows."""
    side = keep_one(table, keys, order, True).drop(order)
    clash = [c for c in rows.columns if c in side.columns and c not in keys]
    return rows.drop(*clash).join(side, keys) if table_wins else rows.join(side.drop(*clash), keys)


def zip_merge(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Rows side by side by their number; the right side's columns win where it has a row, and the left side is kept whole."""
    clash = [c for c in left.columns if c in right.columns and c != order]
    renamed = right.select(order, *[F.col(c).alias(f"__r_{c}") if c in clash else F.col(c) for c in right.columns if c != order]).withColumn("__hit", F.lit(True))
    joined = left.join(renamed, order, "left")
    out = [F.when(F.col("__hit"), F.col(f"__r_{c}")).otherwise(F.col(c)).alias(c) if c in clash else F.col(c) for c in left.columns]
    return joined.select(*out, *[c for c in right.columns if c not in left.columns])


def semi(df: DataFrame, ids: DataFrame, keys: list[str], exclude: bool = False) -> DataFrame:
    return df.join(ids, keys, "left_anti" if exclude else "left_semi")


def repair_folder(segments: DataFrame, text: DataFrame, utt2spk: DataFrame, wav: DataFrame) -> dict[str, DataFrame]:
    """The relations cut to what they agree on: recordings with segments, utterances in all three relations, speakers with utterances."""
    utts = semi(semi(semi(segments, wav, ["rec"]), text, ["utt"]), utt2spk, ["utt"])
    keep = utts.select("utt")
    spk = semi(utt2spk, keep, ["utt"])
    return {"segments": utts, "text": semi(text, keep, ["utt"]), "utt2spk": spk, "wav": semi(wav, utts.select("rec").distinct(), ["rec"])}


def best_overlap(items: DataFrame, spans: DataFrame, keys: list[str], item: list[str], width: float = 60.0) -> DataFrame:
    """For each item (start, end) the span (start, end, idx) of the same keys with the longest overlap, the first if tied; without overlap none.

    Both sides are cut into time bins of `width`, so that the range condition becomes an equi-join on keys and bin.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    left = items.withColumn("__bin", bins("start", "end"))
    right = spans.select(*keys, F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("idx").alias("span_idx")).withColumn("__bin", bins("__s", "__e"))
    joined = left.join(right, [*keys, "__bin"]).withColumn("overlap", F.least("end", "__e") - F.greatest("start", "__s")).filter("overlap > 0")
    best = F.max(F.struct(F.col("overlap"), (-F.col("span_idx")).alias("i"))).alias("best")
    return joined.groupBy(*keys, *item).agg(best).select(*keys, *item, (-F.col("best")["i"]).alias("span_idx"), F.col("best")["overlap"].alias("overlap"))


def compare_many(tables: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """A row per key with each table's value: a full outer comparison in one aggregate."""
    rows = reduce(DataFrame.unionByName, [t.select(key, F.col(value).alias("v"), F.lit(n).alias("t")) for n, t in tables.items()])
    return rows.groupBy(key).agg(*[F.min(F.when(F.col("t") == n, F.col("v"))).alias(n) for n in tables], F.count_distinct("t").alias("n_tables"))


def prefix_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, n: int) -> DataFrame:
    """Each left row with the first right row (by id) that shares the first n characters of its id."""
    side = right.groupBy(F.substring(right_id, 1, n).alias("__p")).agg(F.min(right_id).alias(right_id))
    return left.withColumn("__p", F.substring(left_id, 1, n)).join(side, "__p").drop("__p")


def next_start(df: DataFrame, keys: list[str], start: str, order: list[str], short: Column, end: str) -> DataFrame:
    """Rows for which `short` holds are extended to the next start of the same keys."""
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(end, F.when(short & following.isNotNull(), following).otherwise(F.col(end)))
