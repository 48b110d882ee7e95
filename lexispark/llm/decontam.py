"""Benchmark decontamination by broadcast n-gram windows.

The benchmark's windows of ten consecutive normalised words (a shorter item is one window) are hashed. A task turns a
document's words into numbers, hashes all its windows at once, looks the hashes up in the broadcast set, and verifies each
hit word by word. Words inside verified windows are hit; their spans, or the whole documents, can be removed.

The set is broadcast only if the benchmark's text is at most `broadcast_bytes`. A larger one is joined: document windows are
shuffled on their words against the benchmark's.

Defined results: a null or empty text has no words and no hits; an item without words has no windows; a null item_id is reported as "null";
repeated items count once; repeated documents are rows of their own; an empty benchmark hits nothing. Columns of a document, whatever
their names, pass `clean` as they are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import lower_ascii, materialize, ship

WINDOW = 10
BROADCAST_BYTES = 64 << 20
#: Of UTF-8 bytes after lower-casing A-Z: the same words as of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What a scan adds; inside, under names that no table's own columns have.
ADDED = {"n_words": "long", "n_hit": "long", "items": "array<string>", "hit_spans": "array<struct<start:int,end:int>>"}
_INNER = {c: f"__lx_{c}" for c in ADDED}
FOUND = ", ".join(f"{_INNER[c]} {kind}" for c, kind in ADDED.items())


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class WindowSet:
    """Benchmark windows, by length and hash."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        #: length -> hash -> windows of that hash -> items
        self.by_length: dict[int, dict[int, dict[tuple[bytes, ...], set[str]]]] = defaultdict(dict)
        for item, text in items:
            words = words_of(text)
            for w in words:
                self.ids.setdefault(w, len(self.ids) + 1)
            n = min(window, len(words))
            if n:
                numbers = np.array([self.ids[w] for w in words], np.uint64)
                for at, h in enumerate(self.hashes(numbers, n).tolist()):
                    self.by_length[n].setdefault(h, {}).setdefault(tuple(words[at : at + n]), set()).add(item)
        self.sorted = {n: np.array(sorted(found), np.uint64) for n, found in self.by_length.items()}

    @staticmethod
    def hashes(numbers: np.ndarray, n: int) -> np.ndarray:
        count = len(numbers) - n + 1
        total = np.zeros(max(count, 0), np.uint64)
        for j in range(n):
            total = total * np.uint64(0x9E3779B97F4A7C15) + numbers[j : j + count]
            total ^= total >> np.uint64(29)
        return total

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items that occur."""
        hit, items = np.zeros(len(words), bool), set()
        get = self.ids.get
        numbers = np.array([get(w, 0) for w in words], np.uint64)
        known = np.concatenate([[0], np.cumsum(numbers > 0)])
        for n, table in self.sorted.items():
            if len(words) < n:
                continue
            # only windows all of whose words the benchmark has
            at = np.nonzero(known[n:] - known[:-n] == n)[0]
            if not len(at):
                continue
            h = self.hashes(numbers, n)[at]
            place = np.minimum(np.searchsorted(table, h), len(table) - 1)
            for i in at[table[place] == h].tolist():
                found = self.by_length[n].get(int(self.hashes(numbers[i : i + n], n)[0]), {}).get(tuple(words[i : i + n]))
                if found:
                    hit[i : i + n] = True
                    items |= found
        return hit, items


def spans_of(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code point spans of the runs of hit words."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    spans: list[list[int]] = []
    last = -2
    for i, m in enumerate(_WORD.finditer(raw)):
        if i < len(hit) and hit[i]:
            if last == i - 1:
                spans[-1][1] = m.end()
            else:
                spans.append([m.start(), m.end()])
            last = i
    points = lambda at: len(raw[:at].decode("utf-8", "surrogatepass"))
    return [(points(a), points(b)) for a, b in spans]


def _scan(shared, columns: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            n_words, n_hits, all_items, all_spans = [], [], [], []
            for text in batch.column(batch.schema.get_field_index(text_col)):
                text = text.as_py() or ""
                words = words_of(text)
                hit, items = windows.hits(words)
                n_words.append(len(words))
                n_hits.append(int(hit.sum()))
                all_items.append(sorted(items))
                all_spans.append([{"start": a, "end": b} for a, b in spans_of(text, hit)] if items else [])
            # the other columns go through as they are
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            found = [pa.array(n_words, pa.int64()), pa.array(n_hits, pa.int64()), pa.array(all_items, pa.list_(pa.string())), pa.array(all_spans, span)]
            yield pa.RecordBatch.from_arrays([*kept, *found], [*columns, *_INNER.values()])

    return run


def _windows(items: DataFrame, window: int, lengths: list[int] | None) -> DataFrame:
    """id, text_hash, at, n, gram of a table's windows: its own (lengths None), or those of the given lengths."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    rows = items.select("id", F.xxhash64("text").alias("th"), words.alias("w")).filter(F.size("w") > 0)
    sizes = F.array(F.least(F.size("w"), F.lit(window))) if lengths is None else F.array(*[F.lit(n) for n in lengths])
    rows = rows.withColumn("n", F.explode(sizes)).filter(F.size("w") >= F.col("n"))
    return rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n")))).select(
        "id", "th", "at", "n", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("gram")
    )


def _spans(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """`spans_of` texts and the positions of their hit words (null for none)."""
    for texts, positions in batches:
        out = []
        for text, at in zip(texts, positions, strict=True):
            if at is None:
                out.append([])
                continue
            hit = np.zeros(max(at) + 1, bool)
            hit[at] = True
            out.append([{"start": a, "end": b} for a, b in spans_of(text, hit)])
        yield pd.Series(out)


def _joined(docs: DataFrame, benchmark: DataFrame, text_col: str, columns: list[str], window: int) -> DataFrame:
    """What `_scan` finds, by a shuffle on the windows' words. Windows are of a text, whatever rows have it, and so are their hits."""
    ship(docs.sparkSession)
    own = materialize(_windows(benchmark, window, None).select(F.col("gram").alias("__g"), F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("item")).distinct(), "windows")
    lengths = sorted(r[0] for r in own.select(F.size(F.split("__g", " "))).distinct().collect())
    text = F.col("__lx_text")
    rows = docs.select(*[docs[c] for c in columns], docs[text_col].alias("__lx_text"), F.unhex(F.md5(F.coalesce(docs[text_col], F.lit("")))).alias("__lx_key"))
    texts = rows.select(F.col("__lx_key").alias("id"), text.alias("text")).groupBy("id").agg(F.first("text").alias("text"))
    hits = materialize(_windows(texts, window, lengths or [window]).join(own, F.col("gram") == F.col("__g")).select("id", "at", "n", "gram", "item"), "window_hits")
    # an item once, and a position once, however many windows and items meet there
    items = hits.select("id", "item").distinct().groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("__items"))
    places = hits.select("id", "at", "n").distinct().select("id", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("pos")).distinct()
    places = places.groupBy("id").agg(F.array_sort(F.collect_list("pos")).alias("__pos"))
    hits = materialize(items.join(places, "id").withColumnRenamed("id", "__i"), "hits")
    joined = rows.join(hits, F.col("__lx_key") == F.col("__i"), "left")
    n = F.size(F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))).cast("long")
    spans = F.pandas_udf(_spans, "array<struct<start:int,end:int>>")(text, F.col("__pos"))
    n_hit = F.when(F.col("__pos").isNull(), 0).otherwise(F.size("__pos")).cast("long")
    found = {"n_words": n, "n_hit": n_hit, "items": F.coalesce("__items", F.array().cast("array<string>")), "hit_spans": spans}
    return joined.select(*columns, *[c.alias(_INNER[name]) for name, c in found.items()])


def _scanned(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", columns: tuple[str, ...] = ("doc_id",), window: int = WINDOW,
         broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The given columns of `docs` with those of ADDED, under their inner names."""
    bench = benchmark.select(F.col("item_id").alias("id"), "text")
    size = bench.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    wanted = docs.select(*dict.fromkeys([*columns, text_col]))
    if size > broadcast_bytes:
        return _joined(wanted, bench, text_col, list(columns), window)
    ship(docs.sparkSession)
    items = [("null" if r["id"] is None else str(r["id"]), r["text"]) for r in bench.collect()]
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet(items, window))
    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return wanted.mapInArrow(_scan(shared, list(columns), text_col), f"{schema}, {FOUND}")


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", columns: tuple[str, ...] = ("doc_id",), **params) -> DataFrame:
    """The given columns of `docs` with n_words, n_hit, items (sorted ids as strings) and hit_spans; of the given ones those of these names are replaced."""
    kept = tuple(c for c in columns if c not in ADDED)
    return _scanned(docs, benchmark, text_col, kept, **params).select(*kept, *[F.col(inner).alias(c) for c, inner in _INNER.items()])


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    df = scan(docs, benchmark)
    return df.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, mode: str = "document", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`docs` without contaminated documents (mode "document"), or with the hit spans cut out of their texts ("span").

    Columns stay the same.
    """
    names = docs.columns
    found = _scanned(docs, benchmark, text_col, tuple(names), broadcast_bytes=broadcast_bytes)
    if mode == "document":
        return found.filter(F.col(_INNER["n_hit"]) == 0).select(*names)
    text, spans = F.col(text_col), F.col(_INNER["hit_spans"])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"])).alias("out"))
    cut = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.col(_INNER["n_hit"]) > 0, cut).otherwise(text)).select(*names)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (
  SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.gram = bw.gram),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, 'null') AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
