"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a few bits each; the Hilbert index of the cell orders the
rows, so that a run of the order is a compact box of the dimensions and a file cut from it has narrow
minima and maxima in all of them. The order is cut into runs of equal row counts or equal bytes.

The order is total over distinct rows (curve index, CRC of the text, id), so rows of one cell, however many, and equal
texts are spread over tasks like any others. Ranks come from a range-partitioned, sorted and written copy: counts per
range, summed over the ranges, plus the place within the range. The rows are shuffled once and no window spans them.

Defined results: a null name has a cell of its own; a null text has size 1 and CRC 0, as an empty one; repeated rows are placed
one by one; an empty table gives an empty table; further columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import materialize

BITS = 5  # to a dimension


def _rotate(value: int, by: int, n: int) -> int:
    by %= n
    return ((value << by) | (value >> (n - by))) & ((1 << n) - 1)


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """For each state and cell of an n-dimensional Hilbert curve's step: position along the curve, and next state.

    A state is n * entry + direction, after Hamilton's "Compact Hilbert Indices" (2006).
    """
    gray = lambda i: i ^ (i >> 1)
    inverse = {gray(i): i for i in range(1 << n)}
    entry = lambda w: 0 if w == 0 else gray(2 * ((w - 1) // 2))
    trailing = lambda i: (~i & (i + 1)).bit_length() - 1
    turn = lambda w: 0 if w == 0 else trailing(w - 1) % n if w % 2 == 0 else trailing(w) % n
    position, following = [], []
    for state in range(n << n):
        e, d = divmod(state, n)
        for cell in range(1 << n):
            w = inverse[_rotate(cell ^ e, n - (d + 1), n)]
            position.append(w)
            following.append((e ^ _rotate(entry(w), d + 1, n)) * n + (d + turn(w) + 1) % n)
    return position, following


def hilbert(dimensions: list[Column], bits: int = BITS) -> Column:
    """The index along the curve of a cell whose coordinates are integers of `bits` bits."""
    n = len(dimensions)
    position, following = curve_tables(n)
    table = lambda values: F.array(*[F.lit(v) for v in values])
    cell = lambda b: sum((F.shiftright(d, b).bitwiseAND(F.lit(1)) * (1 << i) for i, d in enumerate(dimensions)), F.lit(0)).cast("int")
    zero = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))

    def step(acc: Column, at: Column) -> Column:
        key = acc["state"] * (1 << n) + at + 1
        return F.struct(
            (acc["index"] * (1 << n) + F.element_at(table(position), key)).alias("index"), F.element_at(table(following), key).alias("state")
        )

    return F.aggregate(F.array(*[cell(b) for b in reversed(range(bits))]), zero, step, lambda acc: acc["index"])


def categorical(column: Column, bits: int = BITS) -> Column:
    """A name's cell: a hash, so that equal names share one; cell 0 is that of null alone."""
    return F.coalesce(F.crc32(column.cast("string")) % ((1 << bits) - 1) + 1, F.lit(0)).cast("int")


def magnitude(column: Column, bits: int = BITS) -> Column:
    """A size's cell: its binary logarithm, which keeps the order."""
    return F.least(F.floor(F.log2(F.greatest(column, F.lit(1)).cast("double"))).cast("int"), F.lit((1 << bits) - 1))


#: Columns that `place` adds; those of these names in its input are replaced.
ADDED = ("size", "text_crc32", "curve", "shard", "slot")


def place(docs: DataFrame, shards: int = 16, law: str = "rows", text_col: str = "text", id_col: str = "doc_id", names: tuple[str, ...] = ("source", "lang"),
          keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all, if None; the id at least) with size, text_crc32, curve, shard and slot.

    Law "rows": shard sizes differ by one row at most. Law "bytes": cut where the sum of sizes passes each multiple of its mean.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"law must be rows or bytes, not {law}")
    text = F.col(text_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    own = [c for c in keep or docs.columns if c not in ADDED]
    rows = docs.select(
        *[docs[c] for c in own],
        size.alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        hilbert([*[categorical(F.col(c)) for c in names], magnitude(size)]).alias("curve"),
    )
    order = ["curve", "text_crc32", id_col]
    # the range partitioner's number of tasks follows the session; within a sorted task, the running id counts the rows
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__lx_id", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranged")
    ranged = ranged.withColumn("__lx_range", F.shiftright("__lx_id", 33)).withColumn("__lx_i", F.col("__lx_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sums = ranged.groupBy("__lx_range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"))
    # one row per range
    so_far = Window.orderBy("__lx_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    sums = sums.select(
        F.col("__lx_range").alias("__lx_r"),
        F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("__lx_n0"),
        F.coalesce(F.sum("w").over(so_far), F.lit(0)).alias("__lx_w0"),
        F.sum("n").over(everything).alias("__lx_n"),
        F.sum("w").over(everything).alias("__lx_w"),
    )
    # as many rows as the session has shuffle partitions
    ranked = ranged.join(F.broadcast(sums), F.col("__lx_range") == F.col("__lx_r")).withColumn("__lx_rank", F.col("__lx_n0") + F.col("__lx_i"))
    if law == "rows":
        out = ranked.withColumn("shard", F.expr(f"cast(__lx_rank * {shards} div __lx_n as int)"))
        # the first rank whose shard is s is s * n / shards, rounded up
        out = out.withColumn("slot", F.col("__lx_rank") - F.expr(f"(cast(shard as bigint) * __lx_n + {shards - 1}) div {shards}"))
    else:
        within = Window.partitionBy("__lx_range").orderBy("__lx_id").rowsBetween(Window.unboundedPreceding, -1)
        cut = ranked.select("__lx_id", "__lx_rank", "__lx_w0", "__lx_w", F.coalesce(F.sum("size").over(within), F.lit(0)).alias("c"))
        cut = materialize(cut.select("__lx_id", "__lx_rank", F.expr(f"cast((__lx_w0 + c) * {shards} div __lx_w as int)").alias("shard")), "cut")
        first = cut.groupBy(F.col("shard").alias("__lx_s")).agg(F.min("__lx_rank").alias("__lx_first"))
        # one row per shard
        cut = cut.join(F.broadcast(first), F.col("shard") == F.col("__lx_s")).select("__lx_id", "shard", (F.col("__lx_rank") - F.col("__lx_first")).alias("slot"))
        out = ranged.join(cut, "__lx_id")
    return out.select(*own, "size", "text_crc32", "curve", "shard", F.col("slot").cast("long").alias("slot"))


def digest(docs: DataFrame) -> DataFrame:
    df = place(docs, keep=["doc_id"])
    return df.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, law: str = "rows") -> None:
    """`docs` as one folder per shard, its rows in curve order."""
    place(docs, shards, law).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
