"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import materialize


def _least(edges: DataFrame, name: str) -> DataFrame:
    """For each a the smallest b, written: the join that follows has an exchange on both sides and can split a hot node."""
    return materialize(edges.groupBy(F.col("a").alias("__a")).agg(F.min("b").alias("m")), name)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both, "large").withColumn("m", F.least("__a", "m"))
    out = both.filter("b > a").join(least, F.col("a") == F.col("__a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return materialize(out.filter("a <> b").distinct(), "largestar")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down, "small")
    out = down.join(least, F.col("a") == F.col("__a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("__a").alias("a"), F.col("m").alias("b"))
    return materialize(out.unionByName(own).filter("a <> b").distinct(), "smallstar")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (node, root): every node that has an edge, but the roots, with the smallest node of its component."""

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("b", "a"))).collect()[0])

    edges = materialize(edges.filter("a <> b").distinct(), "edges")
    now = mark(edges)
    while now[0]:
        edges = _small_star(_large_star(edges))
        before, now = now, mark(edges)
        if now == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
