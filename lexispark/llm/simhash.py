"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within 4 bits have a word within 2 bits of both. So every distinct fingerprint emits all words
within 2 bits of it (1 + 64 + 2016 variants); fingerprints that share a variant are within 4 bits by the triangle
inequality, and all pairs within 4 bits share one. Variants travel as packed arrays: a variant times an odd constant (a
bijection that spreads clusters) gives a prefix, by which the arrays are grouped, and a rest that fits in one long
with the number of the flipped mask, from which the group recovers the fingerprint. The variants go through in `passes`
rounds over disjoint prefix ranges, so that the disk holds a part of them at a time.

Within a group, each run of fingerprints of one variant is a star, not all its pairs; a group hands on a spanning forest of
its stars, and connected components follow by alternating large and small stars over tables in the shared folder.
A fingerprint of a cluster shows its links in as many groups as hold its shared variants, so groups are sized by volume: as
many neighbouring prefixes as make GROUP variants, whatever the table's size. Equal fingerprints are one node, so copies cost one row each.

Defined results: a null or empty text, or one without words, has fingerprint zero, linked like any other; rows that repeat an id are rows
of their own; a null id is reported, but never the smallest one of a group with others; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import materialize, ship
from lexispark.llm.components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
_ODD = 0x9E3779B97F4A7C15
_MASK_BITS = 12
#: Variants (of 8 bytes) that a group, and that an emitting task and pass, has about.
GROUP = 1_000_000


def masks() -> np.ndarray:
    """The 2081 words of at most two set bits."""
    one = [1 << i for i in range(64)]
    return np.array([0, *one, *(a | b for i, a in enumerate(one) for b in one[i + 1 :])], np.uint64)


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    # of bytes, `lower` folds A-Z alone and `split` cuts at space and \x09-\x0D alone
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        starts = [0, *(ends[: len(words) - SHINGLE] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.nonzero(2 * votes > len(hashes))[0].tolist()))


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", text_hash: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; on request th (a hash of the text)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.xxhash64(text_col).alias("th")] if text_hash else []))
    more = ["th"] if text_hash else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *more])

    return rows.mapInArrow(run, "doc_id long, fp long" + (", th long" if text_hash else ""))


def _prefix_bits(nodes: int) -> int:
    """So many that a prefix has about two million variants at most; the record needs 12 at least."""
    return max(_MASK_BITS, int(np.ceil(np.log2(max(nodes, 1) * 2081 / 2e6))))


def _group_bits(nodes: int, prefix_bits: int) -> int:
    """The low bits of a prefix that a group spans."""
    a_prefix = max(nodes, 1) * 2081 / 2**prefix_bits
    return min(prefix_bits, max(0, int(np.log2(max(GROUP / a_prefix, 1.0)))))


def _emit(prefix_bits: int, first: int, last: int, chunk: int = 1024):
    shift = np.uint64(64 - prefix_bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flips = masks()
        index = np.arange(len(flips), dtype=np.uint64)
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for at in range(0, len(fps), chunk):
                mixed = (fps[at : at + chunk, None] ^ flips[None, :]) * np.uint64(_ODD)
                prefix = mixed >> shift
                row, col = np.nonzero((prefix >= first) & (prefix < last))
                mixed, prefix = mixed[row, col], prefix[row, col]
                records = (mixed << np.uint64(prefix_bits)) | index[col]
                order = np.argsort((prefix - np.uint64(first)).astype(np.uint16 if last - first <= 1 << 16 else np.uint64), kind="stable")
                prefix, records = prefix[order], records[order]
                keys, starts = np.unique(prefix, return_index=True)
                cuts = [*starts.tolist(), len(records)]
                yield pd.DataFrame({"prefix": keys.astype(np.int64), "records": [records[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]})

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the smallest of its component, with that smallest one."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _collide(prefix_bits: int):
    inverse, bits = np.uint64(pow(_ODD, -1, 1 << 64)), np.uint64(prefix_bits)

    def stars(prefix: int, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        records = np.sort(records)
        rest = records >> bits
        same = np.concatenate([[False], rest[1:] == rest[:-1], [False]])
        shared = same[:-1] | same[1:]
        records, rest, first = records[shared], rest[shared], ~same[:-1][shared]
        if not len(records):
            return np.array([], np.int64), np.array([], np.int64)
        variants = ((np.uint64(prefix) << (np.uint64(64) - bits)) | rest) * inverse
        fps = (variants ^ masks()[(records & np.uint64((1 << _MASK_BITS) - 1)).astype(np.int64)]).view(np.int64)
        heads = fps[np.nonzero(first)[0]][np.cumsum(first) - 1]
        # the triangle inequality makes this true; it verifies the packing
        apart = np.bitwise_count((fps ^ heads).view(np.uint64))
        assert apart.max() <= RADIUS
        return heads[~first], fps[~first]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        parts = [stars(prefix, np.concatenate([np.frombuffer(x, np.uint64) for x in rows])) for prefix, rows in group.groupby("prefix")["records"]]
        a, b = _forest(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return pd.DataFrame({"a": a, "b": b})

    return run


def links(nodes: DataFrame, passes: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of the links of at most 4 bits."""
    spark = nodes.sparkSession
    ship(spark)
    n = nodes.count()
    bits = _prefix_bits(n)
    span = _group_bits(n, bits)
    # written tables have few files: the variants decide how many tasks emit them
    nodes = nodes.select("fp").repartition(max(1, int(np.ceil(n * 2081 / passes / GROUP))), "fp")
    found = None
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    # each pass ends with a written table: its shuffle files can go at once
    spark.conf.set(cleanup, "true")
    try:
        for i in range(passes):
            first, last = (i << bits) // passes, ((i + 1) << bits) // passes
            variants = nodes.mapInPandas(_emit(bits, first, last), "prefix long, records binary")
            # links that several prefixes of a group show are handed on once; twice as many partitions as groups, so that few share one
            variants = variants.withColumn("group", F.shiftright(F.col("prefix") - first, span))
            variants = variants.repartition(2 * ((last - first - 1 >> span) + 1), "group")
            edges = variants.groupBy("group").applyInPandas(_collide(bits), "a long, b long")
            edges = materialize(edges.distinct(), f"links{i}")
            found = edges if found is None else found.unionByName(edges)
    finally:
        if before is None:
            spark.conf.unset(cleanup)
        else:
            spark.conf.set(cleanup, before)
    return found.distinct()


def _named(prints: DataFrame, passes: int) -> DataFrame:
    """__fp, component_id and root of every fingerprint of `prints` (doc_id, fp)."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, passes)).withColumnRenamed("node", "__n")
    placed = nodes.join(roots, F.col("fp") == F.col("__n"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed, "placed")
    least = placed.groupBy(F.col("root").alias("__r")).agg(F.min("least").alias("component_id"))
    return materialize(placed.join(least, F.col("root") == F.col("__r")).select(F.col("fp").alias("__fp"), "component_id", "root"), "named")


def groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", passes: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the smallest id that links reach) of every row."""
    prints = materialize(fingerprints(docs, text_col, id_col), "fingerprints")
    return prints.join(_named(prints, passes), F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", passes: int = 4) -> DataFrame:
    """One document of each group: of its smallest id, or where that is repeated or null, one row of it by hashes. Columns stay the same.

    Rows are told apart by id and a hash of the text, so a repeated id does not take rows of other groups with it.
    """
    prints = materialize(fingerprints(docs, text_col, id_col, True), "fingerprints")
    rows = prints.join(_named(prints, passes), F.col("fp") == F.col("__fp")).groupBy("root", "doc_id", "th").agg(F.count(F.lit(1)).alias("copies"))
    rows = materialize(rows, "rows")
    best = rows.groupBy(F.col("root").alias("__r")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("best"))
    first = (F.col("doc_id").eqNullSafe(F.col("best.doc_id"))) & (F.col("th") == F.col("best.th"))
    ranked = rows.join(best, F.col("root") == F.col("__r")).select(F.col("doc_id").alias("__lx_id"), F.col("th").alias("__lx_th"), "copies", first.alias("first"))
    ranked = materialize(ranked, "ranked")
    same = docs[id_col].cast("long").eqNullSafe(F.col("__lx_id")) & (F.xxhash64(docs[text_col]) == F.col("__lx_th"))
    kept = docs.join(ranked.filter("not first"), same, "left_anti")
    several = ranked.filter("first and copies > 1")
    if not several.take(1):
        return kept
    order = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
    one = docs.join(several, same, "left_semi").groupBy(F.col(id_col).alias("__lx_id"), F.xxhash64(text_col).alias("__lx_th")).agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    return kept.join(several, same, "left_anti").unionByName(one.select("row.*"))
