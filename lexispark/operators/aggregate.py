"""Statistics over utterances and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Percentiles of a distribution summary.
PERCENTILES = (1, 5, 25, 50, 75, 90, 95, 99)


def summary(value: Column | str) -> list[Column]:
    """Aggregates: count, min, max, mean, population deviation, sum and linearly interpolated percentiles."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    return [
        F.count(x).alias("count"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.sum(x).alias("sum"),
        *[F.percentile(x, p / 100).alias(f"p{p}") for p in PERCENTILES],
    ]


def with_total(df: DataFrame, key: str, aggregates: list[Column], label: str = "TOTAL") -> DataFrame:
    """The aggregates for each key and, by the same pass, for all rows; the rows of a null key are those of key null."""
    g = F.grouping(key).alias("__total")
    rolled = df.rollup(key).agg(g, *aggregates)
    names = [c for c in rolled.columns if c not in (key, "__total")]
    return rolled.select(F.when(F.col("__total") == 1, F.lit(label)).otherwise(F.col(key)).alias(key), *names)


def recording_stats(df: DataFrame, recording: str, duration: str, keys: list[str] | None = None) -> DataFrame:
    """n_recordings, n_segments, total, shortest, longest; the shortest ignores durations that are not positive, the others don't."""
    d = F.col(duration)
    aggregates = [
        F.count_distinct(recording).alias("n_recordings"),
        F.count(F.lit(1)).alias("n_segments"),
        F.sum(d).alias("total"),
        F.min(F.when(d > 0, d)).alias("shortest"),
        F.greatest(F.max(d), F.lit(0.0)).alias("longest"),
    ]
    return df.groupBy(*(keys or [])).agg(*aggregates)


def roll_up(stats: DataFrame, key: str, label: str = "TOTAL") -> DataFrame:
    """Rows of `recording_stats` and one of their sums, least shortest and greatest longest."""
    total = stats.agg(
        F.lit(label).alias(key),
        F.sum("n_recordings").alias("n_recordings"),
        F.sum("n_segments").alias("n_segments"),
        F.sum("total").alias("total"),
        F.min("shortest").alias("shortest"),
        F.max("longest").alias("longest"),
    )
    return stats.withColumn(key, F.col(key).cast("string")).unionByName(total)


def histogram(df: DataFrame, value: str, bins: int = 60, low: float | None = None, high: float | None = None) -> DataFrame:
    """bin (from 0), low, high and n of equal-width bins over [low, high], by default the least and greatest value; the last bin holds its upper edge."""
    x = F.col(value).cast("double")
    rows = df.select(x.alias("x")).filter(x.isNotNull() & ~F.isnan(x))
    if low is None or high is None:
        edges = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        edges = edges.select(F.lit(low).cast("double").alias("lo") if low is not None else "lo", F.lit(high).cast("double").alias("hi") if high is not None else "hi")
        rows = rows.join(F.broadcast(edges))  # one row
    else:
        rows = rows.withColumns({"lo": F.lit(float(low)), "hi": F.lit(float(high))})
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    rows = rows.filter(F.col("x").between(F.col("lo"), F.col("hi"))).withColumn("bin", at.cast("int"))
    return rows.groupBy("bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def dataset_duration(df: DataFrame, duration: str, mode: str = "sum", recording: str | None = None) -> DataFrame:
    """Sum, least or greatest duration, over segments or (with `recording`) over distinct recordings."""
    if mode not in ("sum", "min", "max"):
        raise ValueError(f"mode must be sum, min or max, not {mode}")
    rows = df if recording is None else df.groupBy(recording).agg(F.min(duration).alias(duration))
    return rows.agg(getattr(F, mode)(duration).alias("duration"))


def grouped_list(df: DataFrame, key: str, item: str, order: str) -> DataFrame:
    """key and its items in input order, space-joined (one group's items are one row: the format's own unit)."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).cast("string").alias("v"))))
    return df.groupBy(key).agg(F.array_join(F.transform(pairs, lambda p: p["v"]), " ").alias("items"), F.count(F.lit(1)).alias("n"))


def weighted_vote(df: DataFrame, keys: list[str], answer: str, weight: Column, order: str, floor: float = 1.0) -> DataFrame:
    """Per key the answer of the greatest summed weight, if no other has as much and it is over `floor`; with its score and first row.

    Weights are added in the order of the rows: sums of doubles that depend on the partitioning would make and break ties at random.
    """
    from pyspark.sql import Window

    rows = Window.partitionBy(*keys, answer).orderBy(order, "__weight").rowsBetween(Window.unboundedPreceding, 0)
    sums = df.withColumn("__weight", weight).withColumn("__score", F.sum("__weight").over(rows)).withColumn("__row", F.row_number().over(rows))
    scores = sums.groupBy(*keys, answer).agg(F.max_by("__score", "__row").alias("score"), F.min(order).alias("first_row"))
    top = Window.partitionBy(*keys).orderBy(F.desc("score"))
    ranked = scores.withColumn("rank", F.rank().over(top))
    best = ranked.filter("rank = 1").withColumn("ties", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return best.filter((F.col("ties") == 1) & (F.col("score") > floor)).drop("rank", "ties")


def majority_class(df: DataFrame, key: str, label: str, first: str, second: str, count: Column | None = None, default: str | None = None) -> DataFrame:
    """Per key the label with the larger count; a tie goes to `second`, a key with neither to `default`."""
    n = F.lit(1) if count is None else count
    sums = df.groupBy(key).agg(
        F.coalesce(F.sum(F.when(F.col(label) == first, n)), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(F.col(label) == second, n)), F.lit(0)).alias("b")
    )
    chosen = F.when((F.col("a") == 0) & (F.col("b") == 0), F.lit(default)).when(F.col("a") > F.col("b"), F.lit(first)).otherwise(F.lit(second))
    return sums.select(key, chosen.alias("label"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall and f1 with 0 where they are not defined."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def wer_ratio(sub: Column, dele: Column, ins: Column, hits: Column) -> dict[str, Column]:
    """count, wer and the share of each error; with no reference words, 1 if anything was inserted and 0 otherwise."""
    count = hits + dele + sub
    share = lambda x: F.when(count > 0, x / count).when(x > 0, 1.0).otherwise(0.0)
    return {"count": count, "wer": share(dele + ins + sub), "del": share(dele), "ins": share(ins), "sub": share(sub)}


def characters(df: DataFrame, text: str) -> DataFrame:
    """The distinct characters of a column, with their counts; counted per row first, so little is shuffled."""
    chars = F.explode(F.split(F.col(text), ""))
    return df.select(chars.alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


def issue_counts(df: DataFrame, keys: list[str], status: str, critical: list[str], conditional: list[str], ratio: float = 0.1) -> DataFrame:
    """Per key: rows, problems, critical problems; statuses of `conditional` are critical if over `ratio` of the rows have one. Status null or "ok" is none."""
    s = F.coalesce(F.col(status), F.lit("ok"))
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(s != "ok").alias("problems"),
        F.count_if(s.isin(*critical)).alias("hard"),
        F.count_if(s.isin(*conditional)).alias("soft"),
    )
    severity = F.col("hard") + F.when(F.col("soft") / F.col("n") > ratio, F.col("soft")).otherwise(0)
    return out.select(*keys, "n", "problems", severity.alias("critical"))


def metadata_samples(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    """For each key of a map column, its smallest `most` distinct values."""
    from pyspark.sql import Window

    pairs = df.select(F.explode(column).alias("key", "value")).distinct()
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("value"))).filter(F.col("r") <= most)
    return ranked.groupBy("key").agg(F.sort_array(F.collect_list("value")).alias("examples"))


def common_prefix(df: DataFrame, path: str) -> DataFrame:
    """The longest common prefix of all paths, cut back to its last slash: that of the least and the greatest one."""
    ends = df.agg(F.min(path).alias("a"), F.max(path).alias("b"))
    n = F.least(F.length("a"), F.length("b"))
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, i: F.struct(
            F.when(acc["on"] & (F.substr("a", i, F.lit(1)) == F.substr("b", i, F.lit(1))), i).otherwise(acc["n"]).alias("n"),
            (acc["on"] & (F.substr("a", i, F.lit(1)) == F.substr("b", i, F.lit(1)))).alias("on"),
        ),
        lambda acc: acc["n"],
    )
    prefix = F.substr("a", F.lit(1), same)
    return ends.select(F.regexp_extract(prefix, "^(.*/)", 1).alias("prefix"))
