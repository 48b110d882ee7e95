"""Operators over rows in order: islands, overlaps, gluing, cutting and greedy windows.

Plain windows where a rule looks at neighbours or running extremes; a fold over one recording's sorted array where the state is
greedy. A recording (or conversation) is the unit of work of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUNCTUATION = ".,:;?!"


def _by(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows, from 0; a row for which `breaks` holds begins a new run. `breaks` may look back with a window over the same order."""
    marked = df.withColumn("__break", F.coalesce(breaks, F.lit(False)).cast("int"))
    return marked.withColumn(name, F.sum("__break").over(_by(keys, order).rowsBetween(Window.unboundedPreceding, 0))).drop("__break")


def fuse_turns(df: DataFrame, keys: list[str], order: list[str], speaker: str, start: str, end: str, text: str) -> DataFrame:
    """Runs of one speaker as one row: first start, last end, summed duration, texts joined."""
    w = _by(keys, order)
    runs = islands(df, keys, order, ~F.col(speaker).eqNullSafe(F.lag(speaker).over(w)) & F.lag(F.lit(1)).over(w).isNotNull())
    item = F.struct(*order, F.col(end).alias("__end"), F.col(text).alias("__text"))
    sorted_ = F.sort_array(F.collect_list(item))
    out = runs.groupBy(*keys, "island", speaker).agg(F.min(start).alias("start"), F.sum(F.col(end) - F.col(start)).alias("duration"), F.count(F.lit(1)).alias("n"), sorted_.alias("__items"))
    return out.select(*keys, "island", speaker, "start", F.element_at("__items", -1)["__end"].alias("end"), "duration", "n", F.array_join(F.transform("__items", lambda i: i["__text"]), " ").alias("text"))


def merge_gap(df: DataFrame, keys: list[str], order: list[str], speaker: str, start: str, end: str, gap: float) -> DataFrame:
    """Neighbours of one speaker at most `gap` apart as one row, whose end is the greatest of them."""
    w = _by(keys, order)
    runs = islands(df, keys, order, ~F.col(speaker).eqNullSafe(F.lag(speaker).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), "__run")
    so_far = Window.partitionBy(*keys, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = islands(runs.withColumn("__before", F.max(end).over(so_far)), [*keys, "__run"], order, F.col(start) - F.col("__before") > gap, "__part")
    return parts.groupBy(*keys, "__run", "__part", speaker).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n")).drop("__run", "__part")


def overlap_flags(df: DataFrame, keys: list[str], order: list[str], speaker: str, start: str, end: str) -> DataFrame:
    """overlap: the row before ends later than this one starts, or the next one, of another speaker, starts before this one ends."""
    w = _by(keys, order)
    before = F.lag(end).over(w) > F.col(start)
    after = (F.lead(start).over(w) < F.col(end)) & ~F.lead(speaker).over(w).eqNullSafe(F.col(speaker))
    return df.withColumn("overlap", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))


def silence_cut(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, text: str, silence: float) -> DataFrame:
    """segment: a new one after more than `silence` seconds, or after a text that ends a sentence."""
    w = _by(keys, order)
    return islands(df, keys, order, (F.col(start) - F.lag(end).over(w) > silence) | F.lag(text).over(w).rlike(r"[.?!]$"), "segment")


def drop_included(df: DataFrame, keys: list[str], order: list[str], end: str) -> DataFrame:
    """Rows that end later than the row before."""
    before = F.lag(end).over(_by(keys, order))
    return df.withColumn("__b", before).filter(F.col("__b").isNull() | (F.col(end) > F.col("__b"))).drop("__b")


def midpoints(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, last_end: Column | None = None) -> DataFrame:
    """Neighbours meet halfway between one's end and the next one's start; the first starts at 0, the last ends at `last_end` (its own end)."""
    w = _by(keys, order)
    new_start = F.coalesce((F.lag(end).over(w) + F.col(start)) / 2, F.lit(0.0))
    new_end = F.coalesce((F.col(end) + F.lead(start).over(w)) / 2, F.col(end) if last_end is None else last_end)
    return df.select("*", new_start.alias("mid_start"), new_end.alias("mid_end"))


def dilate_merge(df: DataFrame, keys: list[str], start: str, end: str, by: float) -> DataFrame:
    """Spans widened by `by` (not below 0), those that touch or overlap as one."""
    wide = df.select(*keys, F.greatest(F.col(start) - by, F.lit(0.0)).alias("start"), (F.col(end) + by).alias("end"))
    so_far = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    parts = islands(wide.withColumn("__b", F.max("end").over(so_far)), keys, ["start", "end"], F.col("start") > F.col("__b"))
    return parts.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def reproject(times: DataFrame, spans: DataFrame, keys: list[str], time: str, width: float = 60.0) -> DataFrame:
    """original: times of the concatenated spans (start, end), mapped back; a time beyond all spans is null. Joined by key and time bin."""
    w = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    placed = spans.withColumn("__from", F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0.0)))
    placed = placed.withColumn("__to", F.col("__from") + F.col("end") - F.col("start")).filter("__to > __from")
    placed = placed.select(*keys, F.col("start").alias("__start"), "__from", "__to", F.explode(F.sequence(F.floor(F.col("__from") / width), F.floor(F.col("__to") / width))).alias("__bin"))
    rows = times.withColumn("__bin", F.floor(F.col(time) / width))
    renamed = placed.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bin").alias("__b"), "__start", "__from", "__to")
    on = (F.col("__bin") == F.col("__b")) & (F.col(time) >= F.col("__from")) & (F.col(time) < F.col("__to"))
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"__k{i}"))
    joined = rows.join(renamed, on, "left")
    return joined.select(*times.columns, (F.col("__start") + F.col(time) - F.col("__from")).alias("original"))


def donate_punctuation(df: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """A punctuation mark that begins a text (and isn't doubled) moves to the end of the text before."""
    w = _by(keys, order)
    mark = lambda c: F.regexp_extract(c, r"^([.,:;?!])(?!\1)", 1)
    first = F.lag(F.lit(1)).over(w).isNull()
    body = F.when(first | (mark(F.col(text)) == ""), F.col(text)).otherwise(F.ltrim(F.substr(text, F.lit(2))))
    return df.withColumn("__n", F.coalesce(mark(F.lead(text).over(w)), F.lit(""))).withColumn(text, F.concat(body, "__n")).drop("__n")


def edge_flags(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = _by(keys, order)
    return df.withColumns({"is_first": F.lag(F.lit(1)).over(w).isNull(), "is_last": F.lead(F.lit(1)).over(w).isNull()})


def unique_ids(df: DataFrame, key: str, order: list[str], name: str = "uid") -> DataFrame:
    """Repeated ids get _2, _3, ... in order."""
    n = F.row_number().over(_by([key], order))
    return df.withColumn(name, F.when(n == 1, F.col(key).cast("string")).otherwise(F.concat_ws("_", F.col(key).cast("string"), n.cast("string"))))


def _sorted_rows(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*dict.fromkeys([*order, *columns])))).alias("rows"))


def glue_segments(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, text: str, gap: float = 1.0, longest: float = 30.0, pause: float = 0.2) -> DataFrame:
    """Greedily merges a row into the one before if at most `gap` apart and the result at most `longest`.

    Texts are joined by a space; after a pause of more than `pause` by ". " before an upper-case letter and by ", " otherwise, unless punctuation is there already.
    """
    rows = _sorted_rows(df, keys, order, [start, end, text])
    kind = "array<struct<start:double,end:double,text:string,n:int>>"

    def one(r: Column) -> Column:
        return F.struct(r[start].cast("double").alias("start"), r[end].cast("double").alias("end"), r[text].alias("text"), F.lit(1).alias("n"))

    def step(acc: Column, r: Column) -> Column:
        last = acc["last"]
        silent = r[start] - last["end"]
        fits = last.isNotNull() & (silent <= gap) & (F.greatest(r[end], last["end"]) - last["start"] <= longest)
        glue = F.when((silent <= pause) | last["text"].rlike(r"[!-/:-@\[-`{-~]$"), " ").when(r[text].rlike(r"^\p{Lu}"), ". ").otherwise(", ")
        merged = F.struct(
            last["start"].alias("start"), F.greatest(r[end], last["end"]).cast("double").alias("end"), F.concat(last["text"], glue, r[text]).alias("text"), (last["n"] + 1).alias("n")
        )
        closed = F.when(fits | last.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(last)))
        return F.struct(closed.alias("done"), F.when(fits, merged).otherwise(one(r)).alias("last"))

    zero = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("struct<start:double,end:double,text:string,n:int>").alias("last"))
    glued = F.aggregate("rows", zero, step, lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))))
    return rows.select(*keys, F.posexplode(glued).alias("segment", "s")).select(*keys, "segment", "s.start", "s.end", "s.text", "s.n")


def greedy_windows(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, columns: list[str], longest: float, most: int) -> DataFrame:
    """window: a new one when the row would end more than `longest` after the window's start, or the window has `most` rows."""
    rows = _sorted_rows(df, keys, order, [start, end, *columns])

    def step(acc: Column, r: Column) -> Column:
        new = acc["from"].isNull() | (r[end] - acc["from"] > longest) | (acc["n"] >= most)
        return F.struct(
            F.when(new, r[start]).otherwise(acc["from"]).cast("double").alias("from"),
            F.when(new, 1).otherwise(acc["n"] + 1).alias("n"),
            F.when(new, acc["w"] + 1).otherwise(acc["w"]).alias("w"),
            F.concat(acc["out"], F.array(F.when(new, acc["w"] + 1).otherwise(acc["w"]))).alias("out"),
        )

    zero = F.struct(F.lit(None).cast("double").alias("from"), F.lit(0).alias("n"), F.lit(-1).alias("w"), F.array().cast("array<int>").alias("out"))
    numbered = rows.withColumn("windows", F.aggregate("rows", zero, step, lambda acc: acc["out"]))
    out = numbered.select(*keys, F.explode(F.arrays_zip("rows", "windows")).alias("z"))
    return out.select(*keys, F.col("z.windows").alias("window"), *[F.col("z.rows")[c].alias(c) for c in dict.fromkeys([*order, start, end, *columns])])


def local_speakers(df: DataFrame, window_keys: list[str], order: list[str], speaker: str) -> DataFrame:
    """local_speaker: speakers of a window numbered from 1 by first appearance."""
    spk = Window.partitionBy(*window_keys, speaker)
    df = df.withColumn("__first", F.min(F.struct(*order)).over(spk))
    return df.withColumn("local_speaker", F.dense_rank().over(Window.partitionBy(*window_keys).orderBy("__first"))).drop("__first")


def relative_times(df: DataFrame, window_keys: list[str], start: str, end: str) -> DataFrame:
    base = F.min(start).over(Window.partitionBy(*window_keys))
    return df.withColumns({"rel_start": F.round(F.col(start) - base, 2), "rel_end": F.round(F.col(end) - base, 2)})


def cut_words(df: DataFrame, key: str, words: str, longest: float) -> DataFrame:
    """Rows of an array `words` of struct(word, start, end) cut greedily: id `<key>_cutNN`, start, end and text of pieces of at most `longest`."""
    kind = "array<struct<start:double,end:double,text:string>>"

    def step(acc: Column, w: Column) -> Column:
        last = acc["last"]
        new = last.isNull() | (w["end"] - last["start"] > longest)
        begun = F.struct(w["start"].cast("double").alias("start"), w["end"].cast("double").alias("end"), w["word"].alias("text"))
        longer = F.struct(last["start"].alias("start"), w["end"].cast("double").alias("end"), F.concat_ws(" ", last["text"], w["word"]).alias("text"))
        return F.struct(
            F.when(new & last.isNotNull(), F.concat(acc["done"], F.array(last))).otherwise(acc["done"]).alias("done"), F.when(new, begun).otherwise(longer).alias("last")
        )

    zero = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("struct<start:double,end:double,text:string>").alias("last"))
    pieces = F.aggregate(words, zero, step, lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))))
    out = df.select(key, F.posexplode(pieces).alias("i", "p"))
    return out.select(key, F.format_string("%s_cut%02d", F.col(key).cast("string"), F.col("i") + 1).alias("cut_id"), "p.start", "p.end", "p.text")


def even_words(df: DataFrame, keys: list[str], text: str, start: str, end: str) -> DataFrame:
    """A row per word; the words share their segment evenly."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    rows = df.select(*keys, F.col(start).alias("s"), ((F.col(end) - F.col(start)) / F.nullif(F.size(words), F.lit(0))).alias("d"), F.posexplode(words).alias("i", "word"))
    return rows.select(*keys, "i", "word", (F.col("s") + F.col("i") * F.col("d")).alias("start"), (F.col("s") + (F.col("i") + 1) * F.col("d")).alias("end"))


def stride_pieces(df: DataFrame, keys: list[str], start: str, end: str, text: str, stride: float) -> DataFrame:
    """Rows without word times cut at a fixed stride, the text on the first piece."""
    n = F.greatest(F.ceil((F.col(end) - F.col(start)) / stride), F.lit(1))
    rows = df.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return rows.select(
        *keys, "piece", (F.col(start) + F.col("piece") * stride).alias("start"), F.least(F.col(end), F.col(start) + (F.col("piece") + 1) * stride).alias("end"),
        F.when(F.col("piece") == 0, F.col(text)).otherwise("").alias("text"),
    )
