"""Transcript evaluation: edit counts, error rates, word lists, intervals and alignments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark import jvm
from lexispark.operators.aggregate import f1, wer_ratio
from lexispark.operators.edits import distances
from lexispark.session import ship

COUNTS = "struct<hits:int,sub:int,del:int,ins:int>"


def edit_counts(ref: list[str], hyp: list[str]) -> tuple[int, int, int, int]:
    """hits, substitutions, deletions, insertions of a cheapest alignment; of equals the one with fewest deletions and insertions.

    Row by row over the reference, each row at once in NumPy; counts travel with the costs, so no table is kept.
    """
    ids = {w: i for i, w in enumerate(dict.fromkeys([*ref, *hyp]))}
    r, h = np.array([ids[w] for w in ref], int), np.array([ids[w] for w in hyp], int)
    n = len(h)
    # a cell is cost * big + gaps: one number to minimise, from which the counts follow
    big = len(ref) + n + 1
    steps = np.arange(n + 1)
    row = steps * (big + 1)
    for word in r:
        diagonal = row[:-1] + np.where(h == word, 0, big)
        best = np.minimum(np.concatenate([[row[0] + big + 1], diagonal]), row + big + 1)
        # insertions run along the row: a prefix minimum once their cost is taken out
        row = np.minimum.accumulate(best - steps * (big + 1)) + steps * (big + 1)
    cost, gaps = divmod(int(row[-1]), big)
    # gaps = del + ins, cost = sub + del + ins, del - ins = len(ref) - len(hyp)
    dele = (gaps + len(ref) - n) // 2
    ins, sub = gaps - dele, cost - gaps
    return len(ref) - sub - dele, sub, dele, ins


def edit_count_column(ref: Column, hyp: Column, unit: str = "word") -> Column:
    """The counts of two texts by words, or by characters with spaces collapsed. An empty reference makes all of the hypothesis insertions."""
    if unit == "char":
        # java/EditCounts.java: the same counts as `edit_counts`, without filling all of the table
        return jvm.call("EditCounts", COUNTS, ref, hyp)
    cut = lambda t: (t or "").split()

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            yield pd.DataFrame([edit_counts(cut(x), cut(y)) for x, y in zip(a, b, strict=True)], columns=["hits", "sub", "del", "ins"])

    ship()
    return F.pandas_udf(run, COUNTS)(ref, hyp)


def char_distance_column(ref: Column, hyp: Column, most: float | None = None) -> Column:
    """Edit distance by characters, as `levenshtein`; with `most`, whether it is over that share of the longer text (null if both are empty)."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            out = pd.Series([None] * len(a), dtype="object")
            at = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None and (most is None or x or y)]
            pairs = [(a[i], b[i]) for i in at]
            # 1e-9: a share that is met exactly is not over it
            found = distances(pairs, None if most is None else [int(max(len(x), len(y)) * most + 1e-9) for x, y in pairs])
            out[at] = found if most is None else found < 0
            yield out

    ship()
    return F.pandas_udf(run, "int" if most is None else "boolean")(ref, hyp)


def pair(refs: DataFrame, hyps: DataFrame, key: str, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """References and hypotheses of the same id."""
    return refs.select(key, F.col(ref).alias("ref")).join(hyps.select(key, F.col(hyp).alias("hyp")), key)


def spread(pairs: DataFrame, key: str, tasks: int = 4) -> DataFrame:
    """Pairs dealt over four tasks to a shuffle partition: comparing texts costs the square of their length, so a split's bytes don't bound its work."""
    return pairs.repartition(tasks * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def error_rates(pairs: DataFrame, keys: list[str] | None = None, unit: str = "word") -> DataFrame:
    """Corpus counts and rates of pairs (ref, hyp), over all or per key."""
    counted = pairs.withColumn("e", edit_count_column(F.col("ref"), F.col("hyp"), unit))
    sums = counted.groupBy(*(keys or [])).agg(*[F.sum(F.col("e")[c]).alias(f"n_{c}") for c in ("hits", "sub", "del", "ins")], F.count(F.lit(1)).alias("n_pairs"))
    rates = wer_ratio(F.col("n_sub"), F.col("n_del"), F.col("n_ins"), F.col("n_hits"))
    return sums.select("*", *[v.alias(k) for k, v in rates.items()])


def word_counts(pairs: DataFrame, words: list[str]) -> DataFrame:
    """Per word of a list: tp, fp, fn over all pairs, with precision, recall and f1."""
    # each side is cut into words once, and only listed ones are kept
    listed = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_']+", " ")), " "), lambda x: x.isin(*words)).alias(c)
    rows = pairs.select(listed("ref"), listed("hyp")).withColumn("word", F.explode(F.array_union(F.array_distinct("ref"), F.array_distinct("hyp"))))
    n = lambda c: F.size(F.filter(c, lambda x: x == F.col("word")))
    rows = rows.select("word", n("ref").alias("r"), n("hyp").alias("h"))
    none = pairs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w) for w in words])).alias("word"), F.lit(0).alias("r"), F.lit(0).alias("h"))
    out = rows.unionByName(none).groupBy("word").agg(
        F.sum(F.least("r", "h")).alias("tp"), F.sum(F.greatest(F.col("h") - F.col("r"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("r") - F.col("h"), F.lit(0))).alias("fn")
    )
    return out.select("*", *[v.alias(k) for k, v in f1(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def bootstrap(counted: DataFrame, errors: str, total: str, key: str, resamples: int = 1000, seed: int = 51) -> DataFrame:
    """Intervals of sum(errors) / sum(total) by the Poisson bootstrap: low (5 %), high (95 %), mean, median, deviation.

    Each row's weight in each resample is a hash of its key, so the resamples are sums: rows never meet in one place.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((resamples, 2))
        for b in batches:
            for h, e, t in zip(b["h"], b["e"], b["t"], strict=True):
                weight = np.random.default_rng([int(h) & 0xFFFFFFFF, seed]).poisson(1.0, resamples)
                sums[:, 0] += weight * e
                sums[:, 1] += weight * t
        yield pd.DataFrame({"r": np.arange(resamples), "e": sums[:, 0], "t": sums[:, 1]})

    ship(counted.sparkSession)
    rows = counted.select(F.xxhash64(key).alias("h"), F.col(errors).cast("double").alias("e"), F.col(total).cast("double").alias("t"))
    per = rows.mapInPandas(run, "r long, e double, t double").groupBy("r").agg((F.sum("e") / F.nullif(F.sum("t"), F.lit(0.0))).alias("x"))
    return per.agg(F.percentile("x", 0.05).alias("low"), F.percentile("x", 0.95).alias("high"), F.avg("x").alias("mean"), F.percentile("x", 0.5).alias("median"), F.stddev_pop("x").alias("stdev"))


def system_difference(pairs: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Words of the reference that only system a or only system b misses, and words that only one of them adds, over the reference's words."""
    words = lambda c: F.filter(F.split(F.col(c), r"\s+"), lambda w: w != "")
    miss = lambda c: F.array_except(words("ref"), words(c))
    more = lambda c: F.array_except(words(c), words("ref"))
    rows = pairs.select(
        *(keys or []),
        F.size(F.array_except(miss(a), miss(b))).alias("m_a"), F.size(F.array_except(miss(b), miss(a))).alias("m_b"),
        F.size(F.array_except(more(a), more(b))).alias("x_a"), F.size(F.array_except(more(b), more(a))).alias("x_b"), F.size(words("ref")).alias("n"),
    )
    ratio = lambda c: (F.sum(c) / F.nullif(F.sum("n"), F.lit(0)))
    return rows.groupBy(*(keys or [])).agg(ratio("m_b").alias("misses_removed"), ratio("m_a").alias("misses_kept"), ratio("x_b").alias("added"), ratio("x_a").alias("added_removed"))


def dtw(cost: np.ndarray) -> list[tuple[int, int]]:
    """A cheapest monotone path through a cost matrix, from corner to corner, diagonal steps first among equals."""
    n, m = cost.shape
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            total[i, j] = cost[i - 1, j - 1] + min(total[i - 1, j - 1], total[i - 1, j], total[i, j - 1])
    i, j, path = n, m, []
    while i > 0 and j > 0:
        path.append((i - 1, j - 1))
        _, i, j = min((total[i - 1, j - 1], i - 1, j - 1), (total[i - 1, j], i - 1, j), (total[i, j - 1], i, j - 1), key=lambda x: x[0])
    return path[::-1]


def word_distance(a: str, b: str) -> int:
    hits, sub, dele, ins = edit_counts(list(a), list(b))
    return sub + dele + ins


def word_distances(word: str, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Edit distances of a word to others, given as columns of code points padded below (letters x words) with their sizes."""
    steps = np.arange(len(others) + 1)[:, None]
    row = np.repeat(steps, len(sizes), axis=1)
    for c in word:
        best = np.concatenate([row[:1] + 1, np.minimum(row[:-1] + (others != ord(c)), row[1:] + 1)])
        row = np.minimum.accumulate(best - steps, axis=0) + steps
    return row[sizes, np.arange(len(sizes))]


def word_path(ref: list[str], hyp: list[str]) -> list[tuple[int, int]]:
    """`dtw` of two texts' words by their edit distances, for long texts: a row at once, with two bits kept for each cell."""
    if not ref or not hyp:
        return []
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(hyp))}
    sizes = np.array([len(w) for w in vocabulary])
    others = np.zeros((max(sizes), len(sizes)), np.int32)
    for i, w in enumerate(vocabulary):
        others[: len(w), i] = [ord(c) for c in w]
    at = np.array([vocabulary[w] for w in hyp])
    known: dict[str, np.ndarray] = {}
    far = 1 << 40
    row = np.concatenate([[0], np.full(len(hyp), far)])
    diagonal, up = [], []
    for w in ref:
        if w not in known:
            known[w] = word_distances(w, others, sizes)
        cost = known[w][at]
        sums = np.cumsum(cost)
        # steps along the row: a prefix minimum once their costs are taken out
        new = np.concatenate([[far], np.minimum.accumulate(np.minimum(row[:-1], row[1:]) - sums + cost) + sums])
        diagonal.append(np.packbits((row[:-1] <= row[1:]) & (row[:-1] <= new[:-1])))
        up.append(np.packbits(row[1:] <= new[:-1]))
        row = new
    bit = lambda rows, i, j: rows[i][j >> 3] >> (7 - (j & 7)) & 1
    i, j, path = len(ref) - 1, len(hyp) - 1, []
    while i >= 0 and j >= 0:
        path.append((i, j))
        if bit(diagonal, i, j):
            i, j = i - 1, j - 1
        elif bit(up, i, j):
            i -= 1
        else:
            j -= 1
    return path[::-1]


def align_words(ref: Column, hyp: Column) -> Column:
    """Index pairs of reference and hypothesis words along the cheapest path of their edit distances."""

    # java/WordPath.java: the same paths as `word_path`, without filling all of the table
    return jvm.call("WordPath", "array<struct<ref:int,hyp:int>>", ref, hyp)


def ctc_align(emission: np.ndarray, tokens: list[int], blank: int = 0) -> list[tuple[int, int, int, float]]:
    """(token index, first frame, last frame + 1, mean probability) of tokens along the best path through log probabilities (frames x labels).

    The path ends at the frame where the last token is likeliest; a frame that stays on a token counts with the likelier of token and blank.
    """
    frames, n = emission.shape[0], len(tokens)
    if not n or frames < n:
        return []
    stay = emission[:, blank]
    trellis = np.full((frames + 1, n + 1), -np.inf)
    trellis[:, 0] = np.concatenate([[0], np.cumsum(stay)])
    came = np.zeros((frames + 1, n + 1), bool)
    for t in range(frames):
        move = trellis[t, :-1] + emission[t, tokens]
        keep = trellis[t, 1:] + np.maximum(stay[t], emission[t, tokens])
        came[t + 1, 1:] = move >= keep
        trellis[t + 1, 1:] = np.maximum(move, keep)
    t, j, found = int(np.argmax(trellis[:, n])), n, [[] for _ in tokens]
    while j > 0 and t > 0:
        own = emission[t - 1, tokens[j - 1]]
        found[j - 1].append((t - 1, np.exp(own if came[t, j] else max(own, stay[t - 1]))))
        j, t = (j - 1, t - 1) if came[t, j] else (j, t - 1)
    return [(i, f[-1][0], f[0][0] + 1, float(np.mean([p for _, p in f]))) for i, f in enumerate(found) if f]


def positions(df: DataFrame, key: str, emission: str, tokens: str, seconds_per_frame: float) -> DataFrame:
    """key, i, start, end, conf of the tokens (array<int>) aligned to emissions (array<array<float>> of log probabilities)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (k, i, s * seconds_per_frame, e * seconds_per_frame, c)
                for k, em, tok in zip(b["k"], b["e"], b["t"], strict=True)
                for i, s, e, c in ctc_align(np.array([list(x) for x in em]), [int(x) for x in tok])
            ]
            yield pd.DataFrame(rows, columns=[key, "i", "start", "end", "conf"])

    ship(df.sparkSession)
    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(emission).alias("e"), F.col(tokens).alias("t")).mapInPandas(run, f"`{key}` {kind}, i long, start double, end double, conf double")


def mismatch(ref: Column, hyp: Column, most: float = 0.6) -> Column:
    """Whether the character distance without spaces is over `most` of the longer text (null if both are empty). Only a band of that width is searched."""
    return char_distance_column(F.replace(ref, F.lit(" "), F.lit("")), F.replace(hyp, F.lit(" "), F.lit("")), most)
