"""Secret scans over a trigram inverted index.

Each rule is a regex. Its Boolean trigram query says which trigrams a text must hold for the rule to match
(`lexispark.llm.trigrams`), as a union of intersections. The index is over the distinct texts: they are numbered, the trigrams
of each that some query names are found, and each trigram's posting is a bitmap over a block of 32768 numbers. Per block the
bitmaps are intersected and united as each rule asks, and the bits that are left name the rule's candidates. Only they are
searched by the rule's regex, which verifies them. Rules without mandatory trigrams scan every text.

What is shuffled is narrow: a text's hash and the trigrams found in it, and four kilobytes for a block and trigram. Candidates
(hash and rules) meet the documents by a broadcast as long as they are few enough to be proven small, else by a merge join, which
shuffles the texts.

Defined results: a null or empty text has no spans; repeated rows, and rows of equal texts, each get the same result, from one entry of
the index; texts are searched whole; an empty table gives an empty table; other columns of the input are not looked at.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import find_spans, materialize, span_string
from lexispark.llm.trigrams import conjunctions, query, slim, vocabulary


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: Least length of a match, or of its group `group` if that is not 0.
    least: int = 0
    group: int = 0


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in words)


#: Possessive repeats and look-behinds keep the search linear and change no match.
BASE_RULES = (
    Rule(
        "assign",
        rf"({either_case('password')}|{either_case('passwd')}|{either_case('secret')}|{either_case('token')}|{either_case('api')}_?{either_case('key')})"
        r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        6,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]++", 20),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", 24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}+"),
    Rule("stripe", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("url_login", r"://[A-Za-z0-9._-]{1,64}+:[A-Za-z0-9._%+!-]{4,64}+@[A-Za-z0-9.-]++"),
    Rule("hex_upper", r"(?<![0-9A-F])[0-9A-F]{32,}+", 32),
)
RULES = BASE_RULES + MORE_RULES
BASE_KINDS = tuple(r.kind for r in BASE_RULES)


#: Candidates are broadcast up to this many bytes, at CANDIDATE_BYTES each in an executor's hash table.
BROADCAST_BYTES = 64 << 20
CANDIDATE_BYTES = 96


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def unions(rules: tuple[Rule, ...]) -> list[list[frozenset[str]] | None]:
    """The trigram query of each rule, as a union of intersections; None for a rule that scans every text."""
    return [slim(conjunctions(query(r.regex))) for r in rules]


def index(docs: DataFrame, text_col: str, grams: list[str]) -> tuple[DataFrame, DataFrame]:
    """entries (key, row) of the distinct texts with a trigram of the vocabulary, and the postings (block, gram, bitmap) over them."""
    # a column of its own, or each trigram would lower the text again; a search for each trigram is far quicker than a regex of them all
    rows = docs.select(_key(F.col(text_col)).alias("key"), F.lower(text_col).alias("low"))
    words = [grams[at : at + 62] for at in range(0, len(grams), 62)]
    held = lambda word: functools.reduce(
        lambda a, b: a.bitwiseOR(b), [F.when(F.contains("low", F.lit(g)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, g in enumerate(word)]
    )
    rows = rows.select("key", *[held(word).alias(f"word{i}") for i, word in enumerate(words)])
    # the filter comes after the grouping: before it, it would make the searches run twice
    rows = rows.groupBy("key").agg(*[F.first(f"word{i}").alias(f"word{i}") for i in range(len(words))])
    rows = rows.filter(functools.reduce(lambda a, b: a | b, [F.col(f"word{i}") != 0 for i in range(len(words))]))
    entries = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "entries")
    found = [F.when(F.col(f"word{j}").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(g)) for j, word in enumerate(words) for i, g in enumerate(word)]
    bits = entries.select(F.bitmap_bucket_number("row").alias("block"), F.bitmap_bit_position("row").alias("bit"), F.explode(F.array_compact(F.array(*found))).alias("gram"))
    return entries.select("key", "row"), bits.groupBy("block", "gram").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def candidates(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key (the text's MD5) and rules (a bit for each rule that the index can't rule out), written; texts with none are left out."""
    wanted = unions(rules)
    entries, postings = index(docs, text_col, vocabulary(*wanted))
    # gram -> (rule, intersection, how many postings it has)
    uses: dict[str, list[Column]] = {}
    for i, union in enumerate(wanted):
        for j, c in enumerate(union or ()):
            for g in sorted(c):
                uses.setdefault(g, []).append(F.struct(F.lit(i).alias("rule"), F.lit(j).alias("part"), F.lit(len(c)).alias("n")))
    table = F.create_map(*[x for g in sorted(uses) for x in (F.lit(g), F.array(*uses[g]))])
    parts = postings.select("block", "bitmap", F.explode(F.element_at(table, F.col("gram"))).alias("u")).select("block", "bitmap", "u.*")
    # an intersection lacks a posting that has no bit in the block
    both = parts.groupBy("block", "rule", "part", "n").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("found")).filter("found = n")
    either = both.groupBy("block", "rule").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    blocks = either.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("rule", "bitmap"))).alias("bitmaps"))  # a bitmap per rule
    hits = entries.withColumn("__b", F.bitmap_bucket_number("row")).withColumn("__i", F.bitmap_bit_position("row"))
    hits = hits.join(blocks, F.col("__b") == F.col("block"))
    byte = lambda i: F.substring(F.element_at("bitmaps", F.lit(i)), F.expr("cast(__i div 8 + 1 as int)"), F.lit(1))
    bit = lambda i: F.conv(F.hex(byte(i)), 16, 10).cast("long").bitwiseAND(F.expr("shiftleft(1L, cast(__i % 8 as int))")) != 0
    named = [F.when(bit(i), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, union in enumerate(wanted) if union]
    hits = hits.select("key", functools.reduce(lambda a, b: a.bitwiseOR(b), named).alias("rules"))
    return materialize(hits.filter("rules <> 0"), "candidates")


def _verified(rule: Rule, text: Column, gate: Column) -> Column:
    spans = find_spans(text, rule.regex, gate)
    value = lambda s: F.regexp_extract(s["value"], f"^(?:{rule.regex})$", rule.group) if rule.group else s["value"]
    return F.filter(spans, lambda s: F.length(value(s)) >= rule.least) if rule.least else spans


def scan(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`docs` with `secrets`: array of struct(start, order, end, kind, value), by start, then by the rules' order.

    A column of that name in `docs` is replaced.
    """
    wanted = unions(rules)
    names = [c for c in docs.columns if c != "secrets"]
    rows = docs.select(*[docs[c] for c in names])
    if any(wanted):
        found = candidates(docs, text_col, rules).withColumnsRenamed({"key": "__lx_key", "rules": "__lx_rules"})
        few = found.count() * CANDIDATE_BYTES <= broadcast_bytes
        rows = rows.join(F.broadcast(found) if few else found.hint("merge"), _key(rows[text_col]) == F.col("__lx_key"), "left")
    else:
        rows = rows.withColumn("__lx_rules", F.lit(0).cast("long"))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def named(i: int, rule: Rule) -> Column:
        chosen = F.coalesce(F.col("__lx_rules").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(False))
        # a rule that scans every text decides by its regex alone which ones are cut up
        spans = _verified(rule, text, chosen if wanted[i] else text.rlike(rule.regex))
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(i).alias("order"), s["end"].alias("end"), F.lit(rule.kind).alias("kind"), s["value"].alias("value")
            ),
        )

    spans = F.array_sort(F.concat(*[named(i, rule) for i, rule in enumerate(rules)]))
    return rows.select(*names, spans.alias("secrets"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base kinds' spans, and all spans."""
    df = scan(docs.select("doc_id", "text"))
    n = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return df.select("doc_id", *[n(k) for k in BASE_KINDS], F.sha2(span_string(base), 256).alias("base_sha256"), span_string(F.col("secrets")).alias("spans"))


def _sql_spans(kind: str, order: int, pattern: str, keep: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, {order} AS ord, '{kind}' AS kind, start AS s, start + length(hit) AS e FROM (
  SELECT doc_id, hit, (list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN hits[1:i-1]]), 0))::BIGINT AS start
  FROM (SELECT doc_id, hits, gaps, unnest(hits) AS hit, generate_subscripts(hits, 1) AS i
        FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}') AS hits, string_split_regex(t, '{quoted}') AS gaps FROM docs))) WHERE {keep}"""


#: The exact rules as DuckDB's regex engine takes them (no look-around, no possessive repeats), with what a match must hold.
_ASSIGN = BASE_RULES[0].regex
_SQL_RULES = (
    ("assign", _ASSIGN, f"length(regexp_extract(hit, '{_ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(hit) >= 20"),
    ("hex", "[0-9a-f]+", "length(hit) >= 24"),
    ("private_key", "-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", "true"),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", "true"),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
    ("google", "AIza[0-9A-Za-z_-]{35,}", "true"),
    ("stripe", "[rs]k_(?:live|test)_[0-9A-Za-z]{16,}", "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    ("url_login", "://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._%+!-]{4,64}@[A-Za-z0-9.-]+", "true"),
    ("hex_upper", "[0-9A-F]+", "length(hit) >= 32"),
)
SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_sql_spans(k, i, p, w) for i, (k, p, w) in enumerate(_SQL_RULES))}),
byrow AS (SELECT doc_id,
  count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 3), '') AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord, e) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN byrow USING (doc_id)
"""
