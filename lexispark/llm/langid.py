"""Language identification by Bayesian evidence fusion.

Four pieces of evidence on a text's language are added as log probabilities:
- the text: naive Bayes over hashed UTF-8 byte trigrams, fitted on a bounded sample of labelled rows. Trigrams of running text are far from
  independent, so the sum is tempered: it counts as `effective` independent trigrams at most. Beside the fitted languages there is "other", under
  which each trigram has one probability: `margin` nats less than the mean trigram of the least typical text held out of the fit;
- the language its markup declares, and the suffix of its address, each right with a fixed probability;
- the prior of its host, smoothed hierarchically: host towards domain, domain towards the corpus. The counts behind it are sums, by
  grouped aggregation over all rows, of the posteriors that the other evidence gives; a row's own one is taken out of the prior that it gets.

Text scores are computed once, by Arrow batches in NumPy over whole texts, and written; only their few numbers are shuffled. Host and domain
priors are joined with an exchange on both sides, so that a host with a third of all rows is split.

Defined results: a text without letters gives no text evidence, and the rest decides; no evidence at all gives "und" (probability 0); a null
label or an unknown language declares nothing; repeated rows are rows of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import let, materialize, ship

LANGUAGES = ("de", "en", "es", "fr")
CLASSES = (*LANGUAGES, "other")
SAMPLE = 400  # labelled texts of each language at most
BUCKETS = 1 << 16
_LETTERS = re.compile(r"[^\W\d_]+")
#: Country suffixes that speak for a language.
SUFFIXES = {"de": "de", "at": "de", "uk": "en", "us": "en", "ie": "en", "au": "en", "es": "es", "mx": "es", "ar": "es", "fr": "fr"}


def trigram_buckets(text: str | None) -> np.ndarray:
    """Buckets of the byte trigrams of a text's words, each between spaces."""
    line = " " + " ".join(_LETTERS.findall((text or "").lower())) + " "
    raw = np.frombuffer(line.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(raw) < 4:
        return np.array([], np.uint32)
    return (raw[:-2] * np.uint32(0x9E3B) + raw[1:-1] * np.uint32(0x85EB) * np.uint32(31) + raw[2:] * np.uint32(0xC2B3)) % np.uint32(65521)


@dataclass
class Model:
    """Log probabilities of the buckets (BUCKETS x languages), that of any trigram in another language, and the last hash of each language's sample."""

    table: np.ndarray
    floor: float
    edges: dict[str, int]

    def any(self) -> bool:
        return bool(self.edges)

    def scores(self, buckets: np.ndarray) -> np.ndarray:
        """Log likelihoods in the order of CLASSES."""
        total = np.zeros(len(LANGUAGES))
        for at in range(0, len(buckets), 1 << 18):
            total += self.table[buckets[at : at + (1 << 18)]].sum(0, dtype=np.float64)
        return np.append(total, self.floor * len(buckets))


def _sampled(id_col: str, text_col: str, lang_col: str, edges: dict[str, int]) -> Column:
    """Whether a row is in the sample that a model was fitted on."""
    keep = F.lit(False)
    for lang, most in edges.items():
        keep = keep | ((F.col(lang_col) == lang) & (F.xxhash64(id_col, text_col) <= most))
    return F.coalesce(keep, F.lit(False))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, margin: float = 3.0) -> Model:
    """A model of `sample` rows a language at most, those of the smallest hashes of id and text (of equal rows one): four of five are counted, the
    others are held out and say how improbable a text of a known language can be."""
    ship(labelled.sparkSession)
    rows = labelled.filter(F.col(lang_col).isin(*LANGUAGES) & F.col(text_col).isNotNull())
    # hashes first: a top-k for each language, of narrow rows
    keyed = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h"))
    found = {lang: [r[0] for r in keyed.filter(F.col("lang") == lang).select("h").orderBy("h").limit(sample).collect()] for lang in LANGUAGES}
    edges = {lang: h[-1] for lang, h in found.items() if h}
    if not edges:
        return Model(np.zeros((BUCKETS, len(LANGUAGES)), np.float32), 0.0, {})
    chosen = rows.filter(_sampled(id_col, text_col, lang_col, edges)).groupBy(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h"))
    chosen = materialize(chosen.agg(F.first(text_col).alias("text")).withColumn("held", F.pmod("h", F.lit(5)) == 0), "sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(LANGUAGES), BUCKETS), np.int64)
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                sums[LANGUAGES.index(lang)] += np.bincount(trigram_buckets(text), minlength=BUCKETS)
        which, bucket = np.nonzero(sums)
        yield pd.DataFrame({"lang": which, "bucket": bucket, "n": sums[which, bucket]})

    counts = np.zeros((BUCKETS, len(LANGUAGES)))
    for r in chosen.filter("not held").mapInPandas(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"], r["lang"]] = r["n"]
    model = Model(np.log((counts + 0.5) / (counts + 0.5).sum(0, keepdims=True)).astype(np.float32), 0.0, edges)
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def typical(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams = [g for g in map(trigram_buckets, batch["text"]) if len(g) >= 30]
            yield pd.DataFrame({"mean": [float(shared.value.scores(g)[:-1].max() / len(g)) for g in grams]})

    least = chosen.filter("held").mapInPandas(typical, "mean double").agg(F.min("mean")).first()[0]
    # without any text held out, as improbable as in an even spread over the buckets
    model.floor = (least if least is not None else -float(np.log(BUCKETS)) + margin) - margin
    return model


def _scored(shared, columns: list[str], effective: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, scores = [], []
            for text in batch.column(batch.schema.get_field_index("__lx_text")):
                buckets = trigram_buckets(text.as_py())
                n.append(len(buckets))
                scores.append((shared.value.scores(buckets) * min(1.0, effective / max(len(buckets), 1))).tolist())
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            found = [pa.array(n, pa.int64()), pa.array(scores, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*kept, *found], [*columns, "n_grams", "text_ll"])

    return run


def _declared(code: Column, right: float) -> Column:
    """Log likelihoods of a declared language; a text in another one declares each of the known ones wrongly."""
    rest = (1 - right) / (len(LANGUAGES) - 1)
    known = F.coalesce(code.isin(*LANGUAGES), F.lit(False))
    return F.array(*[F.when(known, F.when(code == lang, float(np.log(right))).otherwise(float(np.log(rest)))).otherwise(0.0) for lang in CLASSES])


def _add(*parts: Column) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = F.zip_with(total, p, lambda a, b: a + b)
    return total


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _softmax(ll: Column) -> Column:
    """Each value is bound once: a lambda would work out what it names again for each element."""
    shared = lambda w: let(_total(w), lambda t: F.transform(w, lambda x: x / t))
    return let(ll, lambda v: let(F.array_max(v), lambda top: let(F.transform(v, lambda x: F.exp(x - top)), shared)))


def _smoothed(counts: Column, weight: float, above: Column) -> Column:
    """Shares of counts, with `weight` rows more that are as the level above says."""
    return let(counts, lambda c: let(_total(c) + weight, lambda n: F.zip_with(c, above, lambda x, q: (x + weight * q) / n)))


def identify(rows: DataFrame, model: Model, effective: int = 60, markup_right: float = 0.9, suffix_right: float = 0.8, strength: float = 20.0) -> DataFrame:
    """`rows` must have key columns and: __lx_text, markup, suffix, host, domain (strings, null for none). Returns its columns, without the
    text, with n_grams, text_lang, language, probability and posterior (array in the order of CLASSES).

    `strength` is how many rows a host (or domain) must have to outweigh the level above it.
    """
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    columns = [c for c in rows.columns if c != "__lx_text"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    scored = rows.mapInArrow(_scored(shared, columns, effective), f"{schema}, n_grams long, text_ll array<double>")
    own = _add(F.col("text_ll"), _declared(F.col("markup"), markup_right), _declared(F.col("suffix"), suffix_right))
    # the row's own part of the counts that host priors are made of
    p = F.when(F.col("n_grams") > 0, _softmax(F.col("__lx_own"))).otherwise(F.array(*[F.lit(0.0)] * len(CLASSES)))
    scored = materialize(scored.withColumn("__lx_own", own).withColumn("__lx_p", p), "scored")

    k = len(CLASSES)
    summed = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(k)])
    by_host = scored.groupBy("domain", "host").agg(summed("__lx_p").alias("__lx_s"))
    by_host = materialize(by_host, "hosts")
    by_domain = by_host.groupBy(F.col("domain").alias("__d")).agg(summed("__lx_s").alias("__lx_d"))
    by_domain = materialize(by_domain, "domains")
    corpus = F.array(*[F.lit(float(x or 0.0)) for x in by_domain.agg(*[F.sum(F.col("__lx_d")[i]) for i in range(k)]).collect()[0]])
    hosts = by_host.withColumnsRenamed({"domain": "__hd", "host": "__h"}).join(by_domain, F.col("__hd").eqNullSafe(F.col("__d"))).drop("__d")
    joined = scored.join(materialize(hosts, "priors"), F.col("host").eqNullSafe(F.col("__h")) & F.col("domain").eqNullSafe(F.col("__hd")), "left")
    less = lambda c: F.zip_with(c, F.col("__lx_p"), lambda a, own: F.greatest(a - own, F.lit(0.0)))
    # the corpus by adding one to each class
    whole = _smoothed(less(corpus), float(k), F.array(*[F.lit(1.0 / k)] * k))
    prior = let(whole, lambda c: let(_smoothed(less(F.col("__lx_d")), strength, c), lambda d: _smoothed(less(F.col("__lx_s")), strength, d)))
    joined = joined.withColumn("posterior", _softmax(_add(F.col("__lx_own"), F.transform(prior, lambda x: F.log(x)))))
    names = F.array(*[F.lit(x) for x in CLASSES])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    # a host's prior alone is no evidence on a row that shows nothing itself
    none = (F.col("n_grams") == 0) & ~F.coalesce(F.col("markup").isin(*LANGUAGES) | F.col("suffix").isin(*LANGUAGES), F.lit(False))
    return joined.select(
        *columns,
        "n_grams",
        F.when(F.col("n_grams") > 0, best(F.col("text_ll"))).alias("text_lang"),
        F.when(none, "und").otherwise(best(F.col("posterior"))).alias("language"),
        F.when(none, 0.0).otherwise(F.array_max("posterior")).alias("probability"),
        "posterior",
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, markup, suffix, host and domain of raw pages."""
    html, url = F.col("html"), F.col("url")
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*+>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"<[^>]*+>", " "), r"&[A-Za-z0-9#]{1,10}+;", " ")
    code = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2})", 1)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    labels = F.split(host, r"\.")
    suffix = F.element_at(F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair]), F.element_at(labels, -1))
    folder = F.regexp_extract(url, r"^[^/]*//[^/]*/([a-z]{2})(?:/|$)", 1)
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    known = lambda c: F.when(c.isin(*LANGUAGES), c)
    return pages.select(
        "page_id", text.alias("__lx_text"), known(F.lower(code)).alias("markup"), F.coalesce(known(folder), suffix).alias("suffix"), host.alias("host"), domain.alias("domain")
    )


def digest(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    df = identify(page_evidence(pages), fit(labelled))
    return df.select("page_id", "host", "markup", "suffix", "n_grams", "text_lang", "language", F.round("probability", 6).alias("probability"))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents in one of LANGUAGES with probability `least`, with `lang` set to it; the others (no letters at all, another language, or
    torn between languages) go. The document's `lang` counts as its declared language, but not of the rows that the model was fitted on; its `source`
    counts as its host. Without labelled rows there is no model: then all documents with letters stay as they are.
    """
    model = fit(docs)
    if not model.any():
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    h = F.xxhash64("text")
    rows = docs.select(
        F.col("doc_id"), h.alias("__lx_th"), F.col("text").alias("__lx_text"), F.when(F.col("lang").isin(*LANGUAGES) & ~_sampled("doc_id", "text", "lang", model.edges), F.col("lang")).alias("markup"),
        F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host"), F.lit("").alias("domain"),
    )
    found = identify(rows, model)
    # letters are needed: a declared language says nothing about a text without any
    ok = found.filter((F.col("n_grams") > 0) & F.col("language").isin(*LANGUAGES) & (F.col("probability") >= least))
    ok = ok.groupBy(F.col("doc_id").alias("__lx_id"), F.col("__lx_th").alias("__lx_h")).agg(F.min("language").alias("__lx_lang"))
    ok = materialize(ok, "identified")
    joined = docs.join(ok, docs["doc_id"].eqNullSafe(F.col("__lx_id")) & (h == F.col("__lx_h")))
    return joined.select(*[F.col("__lx_lang").alias("lang") if c == "lang" else docs[c] for c in docs.columns])
