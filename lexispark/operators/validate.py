"""Validation rules over manifests: a rule is a name and a condition for rows that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def errors(rules: dict[str, Column]) -> Column:
    """The sorted names of the rules a row breaks; an unknown condition breaks none."""
    return F.array_sort(F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and the others with `_errors`."""
    marked = df.withColumn("_errors", errors(rules))
    return marked.filter(F.size("_errors") == 0).drop("_errors"), marked.filter(F.size("_errors") > 0)


def turn_rules(longest_text: int = 5000) -> dict[str, Column]:
    """Rules for rows with `turns` (see nested) whose numbers are given as strings in `duration` and `offset`."""
    number = lambda c: F.col(c).try_cast("double")
    return {
        "invalid_duration": F.col("duration").isNull() | number("duration").isNull(),
        "invalid_offset": F.col("offset").isNotNull() & number("offset").isNull(),
        "wrong_last_turn": ~F.lower(F.try_element_at("turns", F.lit(-1))["from"]).eqNullSafe("assistant"),
        "long_text": F.exists("turns", lambda t: F.length(t["value"]) > longest_text),
    }


def file_rules(tolerance: float = 0.5, channels: int = 1, rate: int = 16000) -> dict[str, Column]:
    """Rules for rows joined with what a probe says of their file: file_duration, channels, rate."""
    end = F.coalesce(F.col("offset"), F.lit(0.0)) + F.col("duration")
    return {
        "missing_file": F.col("file_duration").isNull(),
        "segment_out_of_bounds": (F.coalesce(F.col("offset"), F.lit(0.0)) > 0) & (end > F.col("file_duration") + tolerance),
        "duration_mismatch": (F.coalesce(F.col("offset"), F.lit(0.0)) == 0) & (F.col("duration") > F.col("file_duration") + tolerance),
        "wrong_channels": F.col("channels") != channels,
        "wrong_rate": F.col("rate") != rate,
    }


def until_bad_line(df: DataFrame, manifest: str, line: str, bad: Column) -> DataFrame:
    """Rows before the first bad line of their manifest."""
    first = F.min(F.when(bad, F.col(line))).over(Window.partitionBy(manifest))
    return df.withColumn("__f", first).filter(F.col("__f").isNull() | (F.col(line) < F.col("__f"))).drop("__f")


def until_errors(df: DataFrame, manifest: str, line: str, error: Column, most: int) -> DataFrame:
    """Rows until their manifest has `most` errors (the last of these included)."""
    w = Window.partitionBy(manifest).orderBy(line).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__e", F.coalesce(F.sum(error.cast("int")).over(w), F.lit(0))).filter(F.col("__e") < most).drop("__e")


def folder_invariants(text: DataFrame, segments: DataFrame, utt2spk: DataFrame, wav: DataFrame) -> DataFrame:
    """rule, n: how many ids break each rule of an utterance folder; the relations hold utt, utt and rec, utt and spk, rec."""
    count = lambda df, rule: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
    twice = lambda df, key: df.groupBy(key).count().filter("count > 1")
    checks = [
        count(twice(text, "utt"), "text_not_unique"),
        count(twice(segments, "utt"), "segments_not_unique"),
        count(segments.select("utt").join(text, "utt", "left_anti"), "segment_without_text"),
        count(text.select("utt").join(segments, "utt", "left_anti"), "text_without_segment"),
        count(text.select("utt").join(utt2spk, "utt", "left_anti"), "text_without_speaker"),
        count(segments.select("rec").distinct().join(wav, "rec", "left_anti"), "recording_without_audio"),
        count(text.filter(F.col("utt").cast("string").rlike(r"\s")), "illegal_id"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
