"""Queries of text functions, renderings and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import numbers, render
from lexispark.functions import normalise as Z
from lexispark.functions import text as T
from lexispark.operators import evaluate as E
from lexispark.plans.common import table


def clean_basic(spark, d):
    """A document, decorated, through the basic functions."""
    t = F.concat(F.lit('  "A" (noise) '), F.col("text"), F.lit(" [x]  <b>  l' eau 5 €"))
    return table(spark, d, "documents").select(
        "doc_id", T.collapse_whitespace(t).alias("collapsed"), T.remove_parenthesis(t).alias("no_parens"), T.clean_brackets(t).alias("no_brackets"), T.remove_punctuation(t, True).alias("no_marks"),
        T.remove_tags(t).alias("no_tags"), T.detokenise(t).alias("detokenised"), T.remove_quotes(t).alias("no_quotes"),
    )


def word_functions(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(T.split_words(t)).alias("n_words"), F.size(T.split_sentences(t)).alias("n_sentences"), F.md5(T.replace_word(t, "the", "THE")).alias("replaced"),
                                               F.md5(T.wer_normalise(t, "++")).alias("plus"), F.md5(T.shorten(t, 10)).alias("short"))


def strip_fillers(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.strip_fillers(F.col("text"), ["the", "of", "is"]).alias("text"))


def acronym_inventory(spark, d):
    df = table(spark, d, "documents").select(F.explode(T.acronyms(F.col("text"))).alias("acronym"))
    return df.groupBy("acronym").agg(F.count(F.lit(1)).alias("n_docs"))


def arabic_letters(spark, d):
    df = table(spark, d, "documents").select("doc_id", T.from_buckwalter(F.regexp_replace("text", "[^A-Za-z ]", "")).alias("ar"))
    return df.select("doc_id", "ar", T.buckwalter(F.col("ar")).alias("back"))


def clocks(spark, d):
    li = table(spark, d, "lineitem")
    s = F.col("l_quantity") * 100 + F.col("l_linenumber")
    clock = T.seconds_clock(s)
    return li.select("l_orderkey", "l_linenumber", clock.alias("clock"), T.clock_seconds(clock).alias("back"), T.spoken_duration(F.concat(F.col("l_linenumber").cast("string"), F.lit("h"), F.col("l_quantity").cast("int").cast("string"), F.lit("m5s"))).alias("spoken"))


def id_functions(spark, d):
    p = table(spark, d, "part")
    path = F.concat(F.lit("/data/Corpus"), F.col("p_size").cast("string"), F.lit("/train_nocased_max30/"))
    return p.select("p_partkey", T.pad_numbers(F.concat(F.lit("utt"), F.col("p_partkey").cast("string"), F.lit("_s"), F.col("p_size").cast("string"))).alias("padded"), T.dataset_name(path).alias("dataset"),
                    T.split_position(F.col("p_type"), " ", -1).alias("last"), T.split_position(F.col("p_type"), " ", 0, 2).alias("two"), T.speaker_name(F.concat(F.col("p_type"), F.lit(" (x)"))).alias("speaker"))


_ROMAN = ["I", "IV", "IX", "XIV", "XIX", "XL", "XC", "CD", "MCMXCIV", "MMXXV"]


def roman_numbers(spark, d):
    roman = F.element_at(F.array(*[F.lit(r) for r in _ROMAN]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return table(spark, d, "orders").groupBy(roman.alias("roman"), T.roman_value(roman).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def number_words(spark, d):
    """Rows only: texts with numbers in words in four languages."""
    t = F.concat(F.lit("n "), F.col("o_orderkey").cast("string"), F.lit(" = "), F.col("o_totalprice").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", *[numbers.to_words(t, lang).alias(lang) for lang in numbers.CARDINALS])


def normalised_documents(spark, d):
    """Rows only: documents through the normaliser of their language, those of others with plain spaces and no punctuation; the tests have fixed results."""
    docs, known = table(spark, d, "documents"), ("fr", "en", "de", "es")
    other = docs.filter(~F.coalesce(F.col("lang").isin(*known), F.lit(False))).select("doc_id", T.remove_punctuation(F.col("text")).alias("text"))
    for lang in known:
        other = other.unionByName(docs.filter(F.col("lang") == lang).select("doc_id", Z.format_text(F.col("text"), lang).alias("text")))
    return other


def diarization_styles(spark, d):
    turn = F.struct("turn", F.struct((F.col("turn") % 2 + 1).cast("int").alias("speaker"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 0.5).cast("double").alias("end"), F.col("text").alias("text")).alias("t"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(turn)), lambda x: x["t"]).alias("turns"))
    return rows.select("conv_id", *[render.render(F.col("turns"), s).alias(s) for s in ("letter", "bracket", "timed", "rttm", "seconds")])


def _pairs(spark, d):
    """Documents against a perturbed copy: every seventh word doubled or dropped, by id."""
    words = F.filter(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z ]", " ")), " "), lambda w: w != "")
    df = table(spark, d, "documents").select("doc_id", "lang", words.alias("w"))
    bad = F.flatten(F.transform("w", lambda w, i: F.when((i + F.col("doc_id")) % 7 == 0, F.array(w, w)).when((i + F.col("doc_id")) % 11 == 0, F.array().cast("array<string>")).when((i + F.col("doc_id")) % 13 == 0, F.array(F.concat(w, F.lit("x")))).otherwise(F.array(w))))
    return df.select("doc_id", "lang", F.array_join("w", " ").alias("ref"), F.array_join(bad, " ").alias("hyp"))


def wer_wordlist(spark, d):
    return E.word_counts(_pairs(spark, d), ["the", "and", "of", "de", "la", "und"])


def corpus_wer(spark, d):
    """Rows only: word error rates per language; edit counts have no SQL form."""
    return E.error_rates(E.spread(_pairs(spark, d), "doc_id"), ["lang"])


def corpus_cer(spark, d):
    return E.error_rates(E.spread(_pairs(spark, d), "doc_id"), ["lang"], "char")


def char_distance(spark, d):
    # a task compares its texts together, so it gets as many as a shuffle partition has
    return E.spread(_pairs(spark, d), "doc_id", 1).select("doc_id", E.char_distance_column(F.col("ref"), F.col("hyp")).alias("distance"), E.mismatch(F.col("ref"), F.col("hyp"), 0.1).alias("mismatch"))


def wer_bootstrap(spark, d):
    """Rows only: intervals by hashed resampling, 10,000 times (AGG18)."""
    p = E.spread(_pairs(spark, d), "doc_id").withColumn("e", E.edit_count_column(F.col("ref"), F.col("hyp")))
    c = p.select("doc_id", (F.col("e.sub") + F.col("e.del") + F.col("e.ins")).alias("err"), (F.col("e.hits") + F.col("e.sub") + F.col("e.del")).alias("n"))
    return E.bootstrap(c, "err", "n", "doc_id", 10_000)


def system_difference(spark, d):
    p = _pairs(spark, d).withColumn("other", F.regexp_replace("ref", " (the|de|und) ", " zzz "))
    return E.system_difference(p, "hyp", "other", ["lang"])


def word_alignment(spark, d):
    """Rows only: word pairs of cheapest paths."""
    p = E.spread(_pairs(spark, d), "doc_id").select("doc_id", E.align_words(F.col("ref"), F.col("hyp")).alias("path"))
    # explode() alone would have a filter on the path put before the exchange, which works each path out twice
    return p.select("doc_id", F.explode_outer("path").alias("p")).filter(F.col("p").isNotNull()).select("doc_id", "p.ref", "p.hyp")


def ctc_positions(spark, d):
    """Rows only: four tokens aligned to embeddings cut into frames of eight labels."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8)).alias("em"), F.array(*[F.lit(x) for x in (1, 3, 2, 5)]).alias("tok"))
    return E.positions(e, "vec_id", "em", "tok", 0.02)


QUERIES = {f.__name__: f for f in (
    clean_basic, word_functions, strip_fillers, acronym_inventory, arabic_letters, clocks, id_functions, roman_numbers, number_words, normalised_documents, diarization_styles,
    wer_wordlist, corpus_wer, corpus_cer, char_distance, wer_bootstrap, system_difference, word_alignment, ctc_positions,
)}

_SP = r"[\s\p{Z}]+"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SP}', ' ', 'g'), ' ')"


_PAIRS = r"""w AS (SELECT doc_id, lang, [x FOR x IN string_split(lower(regexp_replace(text, '[^A-Za-z ]', ' ', 'g')), ' ') IF x <> ''] AS w FROM documents),
p AS (SELECT doc_id, lang, w, flatten([CASE WHEN (i - 1 + doc_id) % 7 = 0 THEN [x, x] WHEN (i - 1 + doc_id) % 11 = 0 THEN [] WHEN (i - 1 + doc_id) % 13 = 0 THEN [x || 'x'] ELSE [x] END FOR x, i IN w]) AS h FROM w)"""
_LISTED = ["the", "and", "of", "de", "la", "und"]
_D = r"""t AS (SELECT conv_id, turn, turn % 2 + 1 AS k, turn::DOUBLE AS s, turn + 0.5::DOUBLE AS e, text FROM conversations)"""


def _clock(x: str) -> str:
    ms = f"round({x} * 1000)::BIGINT"
    return f"printf('%02d:%02d:%02d.%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"


ORACLES = {
    "clean_basic": rf"""WITH t AS (SELECT doc_id, '  "A" (noise) ' || text || ' [x]  <b>  l'' eau 5 €' AS t FROM documents)
SELECT doc_id, {_collapse("t")} AS collapsed, regexp_replace(t, '\([^)]*\)', '', 'g') AS no_parens, {_collapse(r"regexp_replace(regexp_replace(t, '\([^)]*\)', ' ', 'g'), '\[[^\]]*\]', ' ', 'g')")} AS no_brackets,
{_collapse(r"regexp_replace(t, '[!-/:-@\[-`{-~«»“”„’‘…–—¿¡]', ' ', 'g')")} AS no_marks, {_collapse(r"regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '''\s+', '''', 'g')")} AS no_tags,
{_collapse(r"regexp_replace(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '\s+([.,;:!?)\]])', '\1', 'g'), '([(\[])\s+', '\1', 'g')")} AS detokenised,
regexp_replace(regexp_replace(regexp_replace(t, '"', '', 'g'), '''''+', '', 'g'), '(^| )''([^'']*)''( |$)', '\1\2\3', 'g') AS no_quotes FROM t""",
    "strip_fillers": r"""SELECT conv_id, turn, array_to_string([x FOR x IN string_split(text, ' ') IF x <> '' AND regexp_replace(lower(x), '[^\p{L}\p{N}'']', '', 'g') NOT IN ('the', 'of', 'is')], ' ') AS text FROM conversations""",
    "arabic_letters": f"""WITH t AS (SELECT doc_id, translate(regexp_replace(text, '[^A-Za-z ]', '', 'g'), '{T.BUCKWALTER.replace(chr(39), chr(39) * 2)}', '{T.ARABIC}') AS ar FROM documents)
SELECT doc_id, ar, translate(ar, '{T.ARABIC}', '{T.BUCKWALTER.replace(chr(39), chr(39) * 2)}') AS back FROM t""",
    "clocks": f"""SELECT l_orderkey, l_linenumber, {_clock("(l_quantity * 100 + l_linenumber)")} AS clock, l_quantity * 100 + l_linenumber AS back, l_linenumber * 3600 + floor(l_quantity) * 60 + 5 AS spoken FROM lineitem""",
    "id_functions": """SELECT p_partkey, 'utt' || lpad(p_partkey::VARCHAR, 7, '0') || '_s' || lpad(p_size::VARCHAR, 7, '0') AS padded, 'corpus' || p_size AS dataset, string_split(p_type, ' ')[-1] AS "last",
array_to_string(string_split(p_type, ' ')[1:2], ' ') AS two, lower(replace(p_type, ' ', '_')) AS speaker FROM part""",
    "roman_numbers": f"""SELECT r AS roman, v AS value, count(*) AS n FROM (SELECT {_ROMAN}[(o_orderkey % 10 + 1)::INT] AS r, [1, 4, 9, 14, 19, 40, 90, 400, 1994, 2025][(o_orderkey % 10 + 1)::INT] AS v FROM orders) GROUP BY 1, 2""",
    "diarization_styles": f"""WITH {_D} SELECT conv_id, string_agg(chr((64 + k)::INT) || ': ' || text, chr(10) ORDER BY turn) AS letter, string_agg('[S' || k || '] ' || text, chr(10) ORDER BY turn) AS bracket,
string_agg('[' || {_clock("s")} || ' - ' || {_clock("e")} || '] ' || chr((64 + k)::INT) || ': ' || text, chr(10) ORDER BY turn) AS timed, string_agg(printf('SPEAKER rec 1 %.3f %.3f <NA> <NA> S%d <NA> <NA>', s, e - s, k), chr(10) ORDER BY turn) AS rttm,
string_agg(printf('%.2f-%.2f S%d: %s', s, e, k, text), chr(10) ORDER BY turn) AS seconds FROM t GROUP BY 1""",
    "wer_wordlist": f"""WITH {_PAIRS}, l AS (SELECT unnest({_LISTED}) AS word), c AS (SELECT word, len([x FOR x IN w IF x = word]) AS r, len([x FOR x IN h IF x = word]) AS h FROM p, l),
s AS (SELECT word, sum(least(r, h))::BIGINT AS tp, sum(greatest(h - r, 0))::BIGINT AS fp, sum(greatest(r - h, 0))::BIGINT AS fn FROM c GROUP BY 1)
SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM s""",
    "char_distance": f"""WITH {_PAIRS}, t AS (SELECT doc_id, array_to_string(w, ' ') AS r, array_to_string(h, ' ') AS h FROM p)
SELECT doc_id, levenshtein(r, h)::INT AS distance, levenshtein(replace(r, ' ', ''), replace(h, ' ', '')) / nullif(greatest(length(replace(r, ' ', '')), length(replace(h, ' ', ''))), 0)::DOUBLE > 0.1 AS mismatch FROM t""",
    "system_difference": f"""WITH {_PAIRS}, t AS (SELECT doc_id, lang, w AS r, h AS a, string_split(regexp_replace(array_to_string(w, ' '), ' (the|de|und) ', ' zzz ', 'g'), ' ') AS b FROM p),
x AS (SELECT lang, list_distinct([k FOR k IN r IF NOT list_contains(a, k)]) AS ma, list_distinct([k FOR k IN r IF NOT list_contains(b, k)]) AS mb, list_distinct([k FOR k IN a IF NOT list_contains(r, k)]) AS xa, list_distinct([k FOR k IN b IF NOT list_contains(r, k)]) AS xb, len(r) AS n FROM t)
SELECT lang, sum(len([k FOR k IN mb IF NOT list_contains(ma, k)])) / sum(n) AS misses_removed, sum(len([k FOR k IN ma IF NOT list_contains(mb, k)])) / sum(n) AS misses_kept,
sum(len([k FOR k IN xb IF NOT list_contains(xa, k)])) / sum(n) AS added, sum(len([k FOR k IN xa IF NOT list_contains(xb, k)])) / sum(n) AS added_removed FROM x GROUP BY 1""",
}
