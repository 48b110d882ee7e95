"""Speakers and channels: who said a word, overlapping turns, and channels merged into one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.operators.join import best_overlap
from lexispark.operators.ordered import _sorted_rows, overlap_flags
from lexispark.session import ship


def word_speakers(words: DataFrame, turns: DataFrame, keys: list[str], word_id: str, word: str) -> DataFrame:
    """speaker of each word (start, end): of the turn (start, end, idx, speaker) that overlaps it most; punctuation and words
    outside all turns take that of the word before, or else after, in the recording."""
    best = best_overlap(words.select(*keys, word_id, "start", "end"), turns, keys, [word_id])
    named = best.join(turns.select(*keys, F.col("idx").alias("span_idx"), "speaker"), [*keys, "span_idx"]).select(*keys, word_id, "speaker")
    rows = words.join(named, [*keys, word_id], "left")
    sure = F.when(~F.col(word).rlike(r"^[\p{P}\p{S}]+$"), F.col("speaker"))
    w = Window.partitionBy(*keys).orderBy("start", "end", word_id)
    before = F.last(sure, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(sure, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("speaker", F.coalesce(before, after))


def glue_overlapping(df: DataFrame, file: str, speaker: str, order: list[str], start: str, end: str, text: str, silence: float = 0.5, longest: float = 15.0, mode: str = "all") -> DataFrame:
    """Each speaker's segments glued across pauses of at most `silence`, up to `longest`; in mode "overlap" only where one of the two overlaps another speaker's."""
    if mode not in ("all", "overlap"):
        raise ValueError(f"mode must be all or overlap, not {mode}")
    rows = overlap_flags(df, [file], order, speaker, start, end)
    rows = _sorted_rows(rows, [file, speaker], order, [start, end, text, "overlap"])
    kind = "struct<start:double,end:double,text:string,overlap:boolean,n:int>"

    def one(r: Column) -> Column:
        return F.struct(r[start].cast("double").alias("start"), r[end].cast("double").alias("end"), r[text].alias("text"), r["overlap"].alias("overlap"), F.lit(1).alias("n"))

    def step(acc: Column, r: Column) -> Column:
        last = acc["last"]
        fits = last.isNotNull() & (r[start] - last["end"] <= silence) & (F.greatest(r[end], last["end"]) - last["start"] <= longest)
        if mode == "overlap":
            fits = fits & (r["overlap"] | last["overlap"])
        merged = F.struct(
            last["start"].alias("start"), F.greatest(r[end], last["end"]).cast("double").alias("end"), F.concat_ws(" ", last["text"], r[text]).alias("text"),
            (last["overlap"] | r["overlap"]).alias("overlap"), (last["n"] + 1).alias("n"),
        )
        closed = F.when(fits | last.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(last)))
        return F.struct(closed.alias("done"), F.when(fits, merged).otherwise(one(r)).alias("last"))

    zero = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("last"))
    glued = F.aggregate("rows", zero, step, lambda a: F.when(a["last"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["last"]))))
    return rows.select(file, speaker, F.explode(glued).alias("s")).select(file, speaker, "s.start", "s.end", "s.text", "s.n")


def cut_overlaps(segments: list[tuple[float, float, str]]) -> list[tuple[float, float, str]]:
    """Segments in order without overlap: a later one cuts the one before short, whose rest comes back after it."""
    out: list[tuple[float, float, str]] = []
    for a, b, who in sorted(segments):
        rest = None
        while out and out[-1][1] > a:
            p, q, other = out.pop()
            if p < a:
                out.append((p, a, other))
            if q > b:
                rest = (b, q, other)
            if p < a:
                break
        out.append((a, b, who))
        if rest:
            out.append(rest)
    return out


def remove_overlaps(df: DataFrame, rec: str, start: str, end: str, speaker: str) -> DataFrame:
    """rec, start, end, speaker without overlaps; a recording is folded at a time."""
    ship(df.sparkSession)
    kind = dict(df.dtypes)[rec]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        done = cut_overlaps(list(zip(pdf[start], pdf[end], pdf[speaker], strict=True)))
        return pd.DataFrame([(pdf[rec].iloc[0], *s) for s in done], columns=[rec, start, end, speaker])

    return df.select(rec, F.col(start).cast("double").alias(start), F.col(end).cast("double").alias(end), speaker).groupBy(rec).applyInPandas(
        run, f"`{rec}` {kind}, `{start}` double, `{end}` double, `{speaker}` string"
    )


def merge_channels(words: DataFrame, rec: str, channel: str, start: str, end: str, shortest: float, order: list[str]) -> DataFrame:
    """Words of all channels by their start, each cut where the next begins; a word shorter than `shortest` between two of one other channel goes."""
    w = Window.partitionBy(rec).orderBy(start, channel, *order)
    before, after = F.lag(channel).over(w), F.lead(channel).over(w)
    marked = words.withColumn("__drop", (before == after) & (before != F.col(channel)) & (F.col(end) - F.col(start) < shortest))
    kept = marked.filter(~F.coalesce("__drop", F.lit(False))).drop("__drop")
    return kept.withColumn(end, F.least(F.col(end), F.coalesce(F.lead(start).over(w), F.col(end))))
