"""Mixing sources to target weights by hash-threshold histograms.

A document's place is a hash of 32 bits of its id, its text and its number among rows that are equal in id, text and source. For each
source the words are summed by the hash's first two bytes; the histogram says in which bucket the source's budget ends; only that bucket is
summed again by the other two. What lies below the threshold found is taken, by a filter: documents are never sorted and no list of them is
gathered.

Budgets are nested: the words that the first threshold leaves open (less than the document on which it
fell) are a second budget for the documents above it that are small enough, and so for `rounds` rounds.

Equal rows are numbered within their part of a written table, and parts are offset by the counts before them, so that a row repeated
without bound is nobody's sole task, and of its copies as many are taken as the budget holds.

Defined results: a null text has size 0 and counts as empty; a null source is a source of its own and the last; null and repeated ids are told
apart by their texts and by number; which of wholly equal rows are taken makes no difference; an empty table gives an empty table; further
columns of the input are not looked at. Reruns agree: nothing depends on order. No document is taken more than `most` times, rounded up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import count_matches, materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
BITS, LEVELS = 16, 2


def hash32(doc_id: Column, text_hash: Column, number: Column) -> Column:
    """32 bits of the MD5 of an id, a text's MD5 and a number among equal rows."""
    named = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), text_hash, number.cast("string"))
    return F.conv(F.substring(F.md5(named), 1, BITS * LEVELS // 4), 16, 10).cast("long")


#: What rows must share to be equal: the id, the text's hash and the source, under these names.
EQUAL = ["__lx_id", "__lx_th", "__lx_src"]


def _keyed(docs: DataFrame, text_col: str, id_col: str, source_col: str) -> dict[str, Column]:
    return {"__lx_id": docs[id_col], "__lx_th": F.md5(F.coalesce(docs[text_col], F.lit(""))), "__lx_src": docs[source_col].cast("string")}


def _equal(a: str = "", b: str = "__r") -> Column:
    """Whether rows are equal, the second side's names with a suffix."""
    same = [F.col(c + a).eqNullSafe(F.col(c + b)) for c in EQUAL]
    return same[0] & same[1] & same[2]


def numbered_copies(rows: DataFrame) -> DataFrame:
    """Written rows (with the columns EQUAL and a unique `__lx_row`) with `__lx_copy`, their number from 0 among equal rows.

    Only rows that are repeated are numbered: within parts (of 65536 numbers of a written partition), and parts by the counts before.
    """
    repeated = materialize(rows.groupBy(*EQUAL).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated")
    theirs = repeated.select(*[F.col(c).alias(c + "__r") for c in EQUAL])
    part = F.shiftright("__lx_row", 16).alias("__lx_part")
    copies = materialize(rows.join(theirs, _equal()).select(*EQUAL, "__lx_row", part), "copies")
    counts = copies.groupBy(*EQUAL, "__lx_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*EQUAL).orderBy("__lx_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    counts = counts.select(*[F.col(c).alias(c + "__r") for c in EQUAL], F.col("__lx_part").alias("__p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*EQUAL, "__lx_part").orderBy("__lx_row")
    places = copies.withColumn("__i", F.row_number().over(within) - 1).join(counts, _equal() & (F.col("__lx_part") == F.col("__p")))
    places = materialize(places.select(F.col("__lx_row").alias("__r"), (F.col("__before") + F.col("__i")).alias("__lx_copy")), "places")
    return rows.join(places, F.col("__lx_row") == F.col("__r"), "left").drop("__r").withColumn("__lx_copy", F.coalesce("__lx_copy", F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row per source: source, weight, source_size, target.

    The targets add up to `share` of all words, in proportion to the weights, which repeat over the
    sources in code point order; no target is over `most` times its source, and what it gives up goes to
    the others by weight. With the sources by the ratio of cap to weight, those capped are a prefix.
    """
    n = F.lit(len(weights))
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # windows over one row per source
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    ranked = by_source.withColumn("weight", pick).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    )
    leveled = ranked.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    # the level of the first source that is not capped holds for all after it
    water = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"]
    target = F.least(F.col("cap"), F.coalesce(water * F.col("weight"), F.col("cap")))
    return leveled.select("source", "weight", "source_size", target.alias("target"))


def _threshold(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """budgets (source, budget) to (source, budget, below, spent): documents with hash < below, `spent` words, fit the budget.

    `rows` has source, size and h. The documents left to sum are a 65536th of those before, level by level.
    """
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("spent"), F.lit(True).alias("open"))
    for level in range(LEVELS):
        rest = BITS * (LEVELS - level)
        joined = rows.join(state.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
        inside = F.col("open") & (F.shiftright("h", rest) == F.col("prefix"))
        hist = joined.filter(inside).groupBy("source", F.shiftright("h", rest - BITS).alias("bucket")).agg(F.sum("size").alias("words"))
        up_to = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        hist = hist.withColumn("before", up_to - F.col("words")).withColumn("up_to", up_to)
        hist = hist.join(state.select(F.col("source").alias("__s"), "budget", "spent"), F.col("source").eqNullSafe(F.col("__s")))
        over = F.col("spent") + F.col("up_to") > F.col("budget")
        # the first bucket beyond the budget, and all words if there is none
        found = hist.groupBy("source").agg(
            F.min(F.when(over, F.struct(F.col("bucket"), F.col("before")))).alias("edge"), F.sum("words").alias("all_words")
        )
        found = found.withColumnRenamed("source", "__s")
        state = state.join(found, F.col("source").eqNullSafe(F.col("__s")), "left")
        edge = F.col("edge")
        state = state.select(
            "source",
            "budget",
            F.when(~F.col("open"), F.col("prefix") * (1 << BITS))
            .when(edge.isNull(), (F.col("prefix") + 1) * (1 << BITS))
            .otherwise(edge["bucket"])
            .alias("prefix"),
            (F.col("spent") + F.when(~F.col("open"), 0).when(edge.isNull(), F.coalesce("all_words", F.lit(0))).otherwise(edge["before"])).cast("long").alias("spent"),
            (F.col("open") & edge.isNotNull()).alias("open"),
        )
        state = materialize(state, f"threshold{level}")
    return state.select("source", "budget", F.col("prefix").alias("below"), "spent")


def plan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
         share: float = 1.5, most: float = 2.0, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """The narrow rows (doc_id, source, size, h and what tells them apart), written, and a row per source: source, source_size, target, whole, and
    the threshold and open budget of each round (below0, gap0, ...)."""
    rows = docs.select(
        docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), count_matches(docs[text_col], WORD).alias("size"),
        *[v.alias(k) for k, v in _keyed(docs, text_col, id_col, source_col).items()], F.monotonically_increasing_id().alias("__lx_row"),
    )
    rows = numbered_copies(materialize(rows, "rows"))
    rows = materialize(rows.withColumn("h", hash32(F.col("doc_id"), F.col("__lx_th"), F.col("__lx_copy"))), "sizes")
    sources = materialize(targets(rows, weights, share, most), "targets")
    # every document as often as the target holds the source wholly; the rest of the target is the budget
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("gap", F.col("target") - F.col("whole") * F.col("source_size"))
    for i in range(rounds):
        left = rows if not i else _with(rows, sources).filter(_left_open(i)).select("source", "size", "h")
        found = _threshold(left, sources.select("source", F.col("gap" if not i else f"gap{i - 1}").alias("budget")))
        found = found.select(F.col("source").alias("__s"), F.col("below").alias(f"below{i}"), (F.col("budget") - F.col("spent")).alias(f"gap{i}"))
        sources = materialize(sources.join(found, F.col("source").eqNullSafe(F.col("__s"))).drop("__s", "gap"), f"plan{i}")
    return rows, sources


def _with(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(sources.withColumnRenamed("source", "__lx_source"), F.col("source").eqNullSafe(F.col("__lx_source")))


def _left_open(i: int) -> Column:
    """Whether round i considers a row: no round before has taken it, and it fits into what they left open."""
    return ~_chosen(i) & (F.col("size") <= F.col(f"gap{i - 1}"))


def _chosen(rounds: int) -> Column:
    """Whether one of the first `rounds` rounds takes a row (size, h) joined with its source's plan."""
    taken = F.col("h") < F.col("below0")
    for i in range(1, rounds):
        taken = taken | ((F.col("size") <= F.col(f"gap{i - 1}")) & (F.col("h") < F.col(f"below{i}")))
    return taken


def _copies(rounds: int, most: float) -> Column:
    """How often the mix takes a row joined with its source's plan."""
    return F.least(F.col("whole") + F.when(_chosen(rounds), 1).otherwise(0), F.lit(math.ceil(most))).cast("long")


def mix(docs: DataFrame, rounds: int = 2, most: float = 2.0, **params) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the mix takes the document) and taken."""
    rows, sources = plan(docs, rounds=rounds, most=most, **params)
    rows = _with(rows, sources).withColumn("copies", _copies(rounds, most))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def take(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", rounds: int = 2, most: float = 2.0, **params) -> DataFrame:
    """`docs` as the mix takes them: each document as many times as it has copies, none if 0. Columns stay the same.

    Texts aren't shuffled, but those of rows that are equal in id, text and source: they are written, and numbered as in the plan.
    """
    narrow, sources = plan(docs, text_col, id_col, source_col, rounds=rounds, most=most, **params)
    repeated = materialize(narrow.groupBy(*EQUAL).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated")
    repeated = repeated.select(*[F.col(c).alias(c + "__r") for c in EQUAL])
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    key = _keyed(docs, text_col, id_col, source_col)
    rows = docs.select(row, count_matches(docs[text_col], WORD).alias("size"), *[v.alias(k) for k, v in key.items()])
    if repeated.take(1):
        several = numbered_copies(materialize(rows.join(repeated, _equal(), "left_semi").withColumn("__lx_row", F.monotonically_increasing_id()), "several"))
        rows = rows.join(repeated, _equal(), "left_anti").withColumn("__lx_copy", F.lit(0).cast("long")).unionByName(several.drop("__lx_row"))
    else:
        rows = rows.withColumn("__lx_copy", F.lit(0).cast("long"))
    rows = rows.select("row", F.col("__lx_src").alias("source"), "size", hash32(F.col("__lx_id"), F.col("__lx_th"), F.col("__lx_copy")).alias("h"))
    copies = _copies(rounds, most).cast("int")
    return _with(rows, sources).select("row", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")


SQL = r"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, coalesce(text, ''), source) - 1 AS copy FROM documents),
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')), copy)), 1, 8))::BIGINT AS h FROM n),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap) * weight, cap)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
c AS (SELECT d.doc_id, d.source, size, h, source_size, target, whole, target - whole * source_size AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
g AS (SELECT *, budget - coalesce(max(cum) FILTER (cum <= budget) OVER (PARTITION BY source), 0) AS gap FROM c),
r AS (SELECT *, cum > budget AND size <= gap AS again FROM g),
r2 AS (SELECT *, sum(CASE WHEN again THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum2 FROM r)
SELECT doc_id, size, source_size, target, (size * least(whole + CASE WHEN cum <= budget OR (again AND cum2 <= gap) THEN 1 ELSE 0 END, 2))::BIGINT AS taken FROM r2
"""
