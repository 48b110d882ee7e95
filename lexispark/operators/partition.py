"""Splits, shards, buckets, ordering and sampling.

Random choices are hashes of the row's id and a seed: the same rows are chosen on every run and with any partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.operators.scratch import written
from lexispark.session import ship


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns and the seed (60 bits of an MD5)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def numbered(df: DataFrame, order: list[str], name: str = "row_idx", key: list[str] | None = None) -> DataFrame:
    """Rows numbered from 0 by `order`, per key or over all.

    Over all, rows are range-partitioned and numbered within their range, and ranges are offset by the counts before them: no task sees all rows.
    The ranged rows are written once, since another run of the plan would draw other borders and the counts would not belong to its rows.
    """
    if key:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long") - 1)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ranged = written(ranged, "ranged").withColumn("__part", F.shiftright("__id", 33))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    counts = counts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    joined = ranged.join(F.broadcast(counts), F.col("__part") == F.col("__p"))
    return joined.withColumn(name, F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id", "__part", "__p", "__before")


def how_many(df: DataFrame, amount: float) -> int:
    """An amount of rows; below 1 a proportion, one row at least. Counts the rows in that case."""
    return max(1, int(df.count() * amount)) if 0 < amount < 1 else int(amount)


def head(df: DataFrame, order: list[str], amount: float) -> DataFrame:
    return df.orderBy(*order).limit(how_many(df, amount))


def tail(df: DataFrame, order: list[str], amount: float) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(how_many(df, amount))


def random_rows(df: DataFrame, keys: list[str], amount: float, seed: int = 0) -> DataFrame:
    return df.orderBy(uniform(*keys, seed=seed), *keys).limit(how_many(df, amount))


def longest(df: DataFrame, duration: str, text: str, keys: list[str], k: int) -> DataFrame:
    return df.orderBy(F.desc(duration), F.desc(F.length(text)), *keys).limit(k)


def first_per_key(df: DataFrame, key: list[str], order: list[str], k: int) -> DataFrame:
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.filter(F.col("__r") <= k).drop("__r")


def shards_of_size(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """shard: `size` consecutive rows each, the last one fewer."""
    return numbered(df, order, "__i").withColumn("shard", F.expr(f"__i div {size}")).drop("__i")


def even_shards(df: DataFrame, order: list[str], n: int, rows: int, drop_remainder: bool = True) -> DataFrame:
    """shard: n runs of rows // n rows; the remainder goes, or joins the last shard."""
    size = rows // n
    out = numbered(df, order, "__i").withColumn("shard", F.expr(f"__i div {max(size, 1)}"))
    out = out.filter(F.col("__i") < size * n) if drop_remainder else out.withColumn("shard", F.least("shard", F.lit(n - 1)))
    return out.drop("__i")


def linear_bucket(value: Column, low: float, high: float, n: int) -> Column:
    """[low, high) in n equal buckets from 0; the last holds high; null outside."""
    at = F.least(F.floor((value - low) / ((high - low) / n)), F.lit(n - 1))
    return F.when(value.between(low, high), at.cast("int"))


def log_bucket(value: Column, low: float, high: float, n: int) -> Column:
    at = F.least(F.floor((F.log(value) - math.log(low)) / ((math.log(high) - math.log(low)) / n)), F.lit(n - 1))
    return F.when(value.between(low, high), at.cast("int"))


def hybrid_bucket(value: Column, low: float, threshold: float, high: float, n_linear: int, n_log: int) -> Column:
    return F.when(value < threshold, linear_bucket(value, low, threshold, n_linear)).otherwise(n_linear + log_bucket(value, threshold, high, n_log))


def equal_total_buckets(df: DataFrame, value: str, n: int, digits: int = 1) -> DataFrame:
    """bucket: rows by rising value, cut so that the buckets' sums of it are near equal.

    Rows of values alike to `digits` stay together: the running sum is over distinct rounded values, not over rows.
    """
    level = F.round(value, digits)
    sums = df.groupBy(level.alias("__v")).agg(F.sum(value).alias("__s"))
    upto = Window.orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce(F.sum("__s").over(upto), F.lit(0.0)) / F.sum("__s").over(Window.partitionBy())
    edges = sums.select("__v", F.least(F.floor(share * n), F.lit(n - 1)).cast("int").alias("bucket"))
    return df.withColumn("__k", level).join(edges, F.col("__k") == F.col("__v")).drop("__k", "__v")


def md5_thousandth(id_: Column) -> Column:
    """The id's MD5 as a number, modulo 1000, from its four 32-bit words."""
    digest = F.md5(id_.cast("string"))
    total = F.lit(0).cast("long")
    for i in range(4):
        total = (total * 296 + F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")) % 1000
    return total


def hash_split(id_: Column, test: float, validation: float) -> Column:
    share = md5_thousandth(id_) / 1000
    return F.when(share < test, "test").when(share < test + validation, "validation").otherwise("train")


def listed_split(id_: Column, lists: dict[str, list[str]], patterns: dict[str, str] | None = None, default: str = "train") -> Column:
    out = F.lit(default)
    for split, regex in (patterns or {}).items():
        out = F.when(id_.rlike(regex), split).otherwise(out)
    for split, ids in lists.items():
        out = F.when(id_.isin(*ids), split).otherwise(out)
    return out


def speaker_split(speaker: Column, row: Column, ratios: dict[str, float], seed: int = 0) -> Column:
    """A split for each speaker, by a hash; rows without a speaker are split one by one."""
    u = F.when(speaker.isNotNull(), uniform(speaker, seed=seed)).otherwise(uniform(row, seed=seed))
    out, upper = F.lit(list(ratios)[-1]), 1.0
    for name, share in reversed(list(ratios.items())):
        out = F.when(u < upper, name).otherwise(out)
        upper -= share
    return out


def dev_speakers(df: DataFrame, speaker: str, share: float, seed: int = 0) -> DataFrame:
    """max(1, round(n * share)) speakers by hash, as split dev; the others are train."""
    speakers = df.select(speaker).distinct()
    k = max(1, round(speakers.count() * share))
    dev = speakers.orderBy(uniform(speaker, seed=seed), speaker).limit(k).withColumn("split", F.lit("dev"))
    return speakers.join(dev, speaker, "left").select(speaker, F.coalesce("split", F.lit("train")).alias("split"))


def oversample(df: DataFrame, key: str, weight: Column, seed: int = 45) -> DataFrame:
    """int(weight) copies of each row and another for the fraction, by hash; ids of copies beyond the first get _i."""
    whole = F.floor(weight).cast("long")
    copies = whole + (uniform(key, seed=seed) < weight - whole).cast("long")
    rows = df.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array().cast("array<bigint>"))))
    return rows.withColumn(key, F.when(F.col("copy") == 0, F.col(key).cast("string")).otherwise(F.concat_ws("_", F.col(key).cast("string"), F.col("copy").cast("string"))))


def weighted_choice(keys: list[str], options: dict[str, float], seed: int = 0) -> Column:
    """One of the options by weight."""
    u = uniform(*keys, seed=seed) * sum(options.values())
    out, upper = F.lit(list(options)[-1]), sum(options.values())
    for text, weight in reversed(list(options.items())):
        out = F.when(u < upper, text).otherwise(out)
        upper -= weight
    return out


def duration_fill(df: DataFrame, recording: str, duration: str, longest: float, range_rows: int = 100_000) -> DataFrame:
    """split number of each recording: in order, a new split when the running sum would pass `longest`.

    Recordings are dealt into ranges of about `range_rows`, written once, as another sample would draw other borders. One range after the other is
    folded, each from the sum and split at which the one before ended: no task sees more than a range.
    """
    ship(df.sparkSession)
    per = written(df.groupBy(recording).agg(F.sum(duration).cast("double").alias("duration")), "recordings")
    parts = math.ceil(per.count() / range_rows) or 1
    rows = written(per.repartitionByRange(parts, recording).withColumn("__range", F.spark_partition_id()), "ranges")
    kind = dict(per.dtypes)[recording]

    def fold(total: float, split: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s, k = total, split
            for b in batches:
                sums, splits = [], []
                for d in b["duration"].fillna(0.0).tolist():
                    if s > 0 and s + d > longest:
                        s, k = d, k + 1
                    else:
                        s += d
                    sums.append(s)
                    splits.append(k)
                yield b.assign(split=splits, __sum=sums)

        return run

    out, total, split = None, 0.0, 0
    schema = f"`{recording}` {kind}, duration double, split int, __sum double"
    for r in range(parts):
        part = rows.filter(F.col("__range") == r).drop("__range").coalesce(1).sortWithinPartitions(recording)
        part = written(part.mapInPandas(fold(total, split), schema), f"range{r}")
        out = part if out is None else out.unionByName(part)
        last = part.agg(F.max(F.struct(F.col(recording).isNotNull(), recording, "__sum")), F.max("split")).first()
        total, split = (last[0]["__sum"], last[1]) if last[0] is not None else (total, split)
    return out.select(recording, "duration", "split")


def disjoint_split(df: DataFrame, speaker: str, audio: str, test: DataFrame) -> DataFrame:
    """speaker, split: test holds the speakers of `test` and all that share audio with it, directly or not.

    Breadth-first from the test side until a round reaches nobody new; only speakers new in a round look further. Each round is a written table, and
    rounds are put together now and then, so that plans stay short. Stops with an error if no train speaker is left.
    """
    pairs = written(df.select(speaker, audio).distinct(), "pairs")
    reached = frontier = written(test.select(speaker).distinct(), "test")
    rounds = 0
    while True:
        touched = pairs.join(frontier, speaker, "left_semi").select(audio).distinct()
        new = written(pairs.join(touched, audio, "left_semi").select(speaker).distinct().join(reached, speaker, "left_anti"), "reached")
        if not new.take(1):
            break
        reached, frontier, rounds = reached.unionByName(new), new, rounds + 1
        if rounds % 10 == 0:
            reached = written(reached.repartition(speaker), "reached")
    out = df.select(speaker).distinct().join(reached.withColumn("split", F.lit("test")), speaker, "left")
    out = out.select(speaker, F.coalesce("split", F.lit("train")).alias("split"))
    if not out.filter("split = 'train'").take(1):
        raise ValueError("every speaker shares audio with the test side")
    return out


def _next_other(df: DataFrame, part: str, group: str, utt: str) -> DataFrame:
    """__p: the next `utt` of another `group` in the part's hashed order, null where none follows; __first: the part's first row, with its own __p."""
    back = Window.partitionBy(part).orderBy(F.desc("__h"), F.desc(utt))
    change = F.lag(utt).over(back).isNotNull() & ~F.lag(group).over(back).eqNullSafe(F.col(group))
    marked = df.withColumn("__p", F.when(change, F.lag(utt).over(back)))
    marked = marked.withColumn("__p", F.last("__p", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.min(F.struct("__h", F.col(utt).alias("u"), F.col(group).alias("g"), F.col("__p").alias("p"))).over(Window.partitionBy(part))
    return marked.withColumn("__first", first)


def balanced_pairs(df: DataFrame, speaker: str, session: str, utt: str, seed: int = 0) -> DataFrame:
    """a, b, same: for each utterance one partner of the same speaker, of another session if there is one, and one of another speaker.

    Partners are the next fitting rows in hashed orders, which begin again at their end, so no pairs are listed that aren't used. Utterances without a
    speaker have no partner.
    """
    u = df.filter(F.col(speaker).isNotNull()).withColumn("__h", uniform(utt, seed=seed))
    own = Window.partitionBy(speaker).orderBy("__h", utt)
    pos = _next_other(u, speaker, session, utt).withColumn("__n", F.coalesce(F.lead(utt).over(own), F.col("__first")["u"]))
    around = F.when(~F.col("__first")["g"].eqNullSafe(F.col(session)), F.col("__first")["u"]).otherwise(F.col("__first")["p"])
    positives = pos.select(F.col(utt).alias("a"), F.coalesce("__p", around, "__n").alias("b"), F.lit(1).alias("same")).filter("a <> b")
    # a hashed cell holds utterances of several speakers; where no other one follows in it, the next cells' first rows do
    cells = _next_other(u.withColumn("__c", F.pmod(F.xxhash64(utt, F.lit(seed)), F.lit(64))), "__c", speaker, utt)
    heads = cells.groupBy("__c").agg(F.first("__first").alias("f")).agg(F.sort_array(F.collect_list(F.struct(F.col("__c").alias("c"), F.col("f")))).alias("__heads"))  # 64 at most
    rows = cells.crossJoin(F.broadcast(heads))
    after = F.concat(F.filter("__heads", lambda x: x["c"] > F.col("__c")), F.filter("__heads", lambda x: x["c"] <= F.col("__c")))
    next_head = F.get(F.filter(F.transform(after, lambda x: F.when(x["f"]["g"] != F.col(speaker), x["f"]["u"]).otherwise(x["f"]["p"])), lambda x: x.isNotNull()), F.lit(0))
    negatives = rows.select(F.col(utt).alias("a"), F.coalesce("__p", next_head).alias("b"), F.lit(0).alias("same")).filter("b is not null")
    both = positives.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "same").distinct()
    return both.unionByName(negatives.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "same").distinct())


def speaker_chunks(df: DataFrame, speaker: str, n: int) -> DataFrame:
    """speaker, chunk: speakers in order, cut into n runs of near equal numbers of rows. One row per speaker is ordered, not the rows."""
    per = df.groupBy(speaker).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.orderBy(speaker).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__n").over(upto), F.lit(0)).cast("long")
    return per.withColumns({"__b": before, "__t": F.sum("__n").over(Window.partitionBy())}).select(speaker, F.expr(f"cast(__b * {n} div __t as int)").alias("chunk"))


def split_by_lists(df: DataFrame, path: str, lists: dict[str, list[str]]) -> DataFrame:
    """split: of the list one of whose ids ends the path (but for its ending); null for none, an error for more than one."""
    stem = F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")
    hits = F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(i) for i in ids]), lambda i: F.endswith(stem, i)), F.lit(name)) for name, ids in lists.items()]))
    one = F.when(F.size(hits) > 1, F.raise_error(F.concat(F.lit("in several lists: "), F.col(path)))).otherwise(F.get(hits, F.lit(0)))
    return df.withColumn("split", one)


def versions(df: DataFrame, key: list[str], ratio: float, seed: int = 0) -> DataFrame:
    """version 0 of each row, and version 1 of a share of them, by hash."""
    more = F.when(uniform(*key, seed=seed) < ratio, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("version", F.explode(more))


def dataset_mode(name: Column) -> Column:
    """train, dev or test, as a dataset's name says; train if it says nothing."""
    part = lambda words: name.rlike(rf"(?:^|[^a-z])(?:{words})(?:$|[^a-z])")
    return F.when(part("test|eval"), "test").when(part("dev|valid|validation"), "dev").otherwise("train")


def translation_contexts(names: DataFrame, templates: DataFrame) -> DataFrame:
    """Prompts of all pairs of languages: names (prompt_lang, code, name), templates (prompt_lang, template with {source} and {target}).

    weight: .94 if the prompt's language is one of the two, .04 for another one of English and French, .02 otherwise. French articles are contracted.
    """
    s = names.select("prompt_lang", F.col("code").alias("source"), F.col("name").alias("source_name"))
    t = names.select("prompt_lang", F.col("code").alias("target"), F.col("name").alias("target_name"))
    rows = templates.join(s, "prompt_lang").join(t, "prompt_lang").filter("source <> target")
    text = F.replace(F.replace("template", F.lit("{source}"), F.col("source_name")), F.lit("{target}"), F.col("target_name"))
    elided = F.regexp_replace(F.regexp_replace(text, r"\bdu (?=[aeiouhéà])", "de l'"), r"\ble (?=[aeiouhéà])", "l'")
    own = (F.col("prompt_lang") == F.col("source")) | (F.col("prompt_lang") == F.col("target"))
    weight = F.when(own, 0.94).when(F.col("prompt_lang").isin("en", "fr"), 0.04).otherwise(0.02)
    return rows.select("source", "target", "prompt_lang", F.when(F.col("prompt_lang") == "fr", elided).otherwise(text).alias("context"), weight.alias("weight"))
