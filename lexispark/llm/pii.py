"""Personal data by candidate gradient boosting.

Four exact rules (email, ip, card, phone) give the base spans. Beside them, loose generators propose
overlapping candidate spans; boosted trees, fitted on generated labelled examples, score each candidate
from its format and its context, and a threshold per kind, calibrated on held-out examples, decides
which of them join the base spans. Everything on the path of a document is a DataFrame expression:
the trees become CASE expressions, and a row never leaves its partition (no shuffle).

Defined results: a null or empty text has no spans; repeated rows each get the same result; other columns of
the input, whatever their names, are not looked at. No match is longer than its text and no text is cut.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import boosting
from lexispark.llm.common import digits_of, find_spans, let, luhn_ok, running, span_string
from lexispark.llm.pii_examples import examples

KINDS = ("email", "ip", "card", "phone")

#: The exact rules. Possessive repeats and the look-behinds change no match: they keep the search linear
#: on long runs, since a match can start only where a run of its first class starts or another match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: The loose rules; what they find overlaps with one another and with the base spans.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++"
    r"(?: ?(?:@|[\(\[\{] ?at ?[\)\]\}]) ?[A-Za-z0-9-]++(?: ?(?:\.|[\(\[\{] ?dot ?[\)\]\}]| dot ) ?[A-Za-z0-9-]++){1,6}+"
    r"| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++){1,6}+)",
    "ip": r"(?<![0-9.])[0-9]{1,4}(?: ?(?:\.|\[\.\]|\(\.\)|,) ?[0-9]{1,4}){3,5}+(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){11,19}+(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00|\()?[0-9](?:[ ().\x2D/]{0,2}[0-9]){6,15}+(?![0-9])",
}


def _gate(kind: str, text: Column, loose: bool) -> Column:
    """Holds for every text in which a rule of this kind can match; decided without the rule's own search."""
    has = lambda *words: functools.reduce(lambda a, w: a | F.contains(text, F.lit(w)), words[1:], F.contains(text, F.lit(words[0])))
    if kind == "email":
        return has("@", " dot ", "at)", "at]", "at}", "at )", "at ]", "at }") if loose else has("@")
    number = text.rlike("[0-9][ ().\\[\\],/_-]{0,6}[0-9]")
    if loose:
        return number
    return has(".") & number if kind == "ip" else has("+") if kind == "phone" else number


#: Characters of context on either side that the features look at.
BEFORE, AFTER = 28, 10
CUES = {
    "email": r"mail|contact|write|reach|adresse|correo|kontakt|courriel",
    "ip": r"\bip\b|host|server|address|ping|login from|adresse|servidor|dns",
    "card": r"card|visa|master|amex|pay|carte|tarjeta|karte|cvv|debit",
    "phone": r"tel|phone|call|mobile|cell|fax|appel|anruf|llama|ring|whatsapp",
}
AGAINST = r"order|invoice|version|\bref|isbn|serial|ticket|\bno\.|num|build|\bid\b|page|total|[$€#£v]\s*$|date|section|chapter|tracking|sku|lot"
FEATURES = (
    "kind", "n_digits", "n_alpha", "n_chars", "n_separators", "luhn", "at_sign", "spelled_out", "plus_or_00", "cue", "against",
    "word_before", "word_after", "octets_ok", "suffix_alpha", "brackets", "groups", "date_like",
)


def base_valid(kind: str, value: Column) -> Column:
    """What a match of the exact rule must hold besides its pattern."""
    n = F.length(digits_of(value))
    if kind == "ip":  # leading zeros count for nothing
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            F.split(value, r"\."), lambda p: F.coalesce(F.right(p, F.lit(9)).try_cast("int"), F.lit(0)) <= 255
        )
    if kind == "card":
        return n.between(16, 19) & luhn_ok(value)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _named(kind: str, spans: Column) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            F.lit(KINDS.index(kind)).alias("order"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")
        ),
    )


def base_spans(kind: str, text: Column) -> Column:
    return _named(kind, F.filter(find_spans(text, BASE[kind], _gate(kind, text, False)), lambda s: base_valid(kind, s["value"])))


def candidates(text: Column) -> Column:
    """All proposals of the loose rules, with their context."""
    named = lambda k: lambda s: F.struct(
        F.lit(KINDS.index(k)).alias("order"), s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind"), s["value"].alias("value"),
        s["before"].alias("before"), s["after"].alias("after"),
    )
    found = {k: find_spans(text, LOOSE[k], _gate(k, text, True), (BEFORE, AFTER)) for k in KINDS}
    return F.concat(*[F.transform(spans, named(k)) for k, spans in found.items()])


def features(s: Column) -> Column:
    """The numbers, in the order of FEATURES, that the trees see of a candidate."""
    value, before, after = s["value"], F.lower(s["before"]), s["after"]
    n = F.length(digits_of(value))
    cue = functools.reduce(lambda a, k: F.when(s["kind"] == k, before.rlike(CUES[k])).otherwise(a), KINDS, F.lit(False))
    octets = F.split(F.regexp_replace(value, r"[^0-9]+", "."), r"\.")
    values = [
        s["order"],
        n,
        F.length(F.regexp_replace(value, "[^A-Za-z]", "")),
        F.length(value),
        F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")),
        n.between(12, 20) & luhn_ok(value),
        value.contains("@"),
        F.lower(value).rlike(r"\bat\b.*\bdot\b"),
        value.rlike(r"^(\+|00)"),
        cue,
        before.rlike(AGAINST),
        before.rlike(r"[\p{L}\p{N}]$"),
        after.rlike(r"^[\p{L}\p{N}_]"),
        (F.size(octets) == 4) & F.forall(octets, lambda p: F.coalesce(F.right(p, F.lit(9)).try_cast("int"), F.lit(999)) <= 255),
        F.length(F.regexp_extract(value, r"([A-Za-z]+)$", 1)),
        value.rlike(r"[\[\](){}]"),
        F.size(F.split(value, r"[^0-9A-Za-z]+")),
        value.rlike(r"^(19|20)?[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,4}"),
    ]
    return F.array(*[F.coalesce(v.cast("int"), F.lit(0)).cast("double") for v in values])


@functools.lru_cache(maxsize=4)
def _fitted(rows: tuple[tuple[tuple[float, ...], int], ...], precision: float) -> tuple[boosting.Boosted, dict[int, float]]:
    """Of every five rows three fit the trees, one calibrates them, and one says, for each kind, the lowest threshold with that precision."""
    part = lambda *which: [r for i, r in enumerate(rows) if i % 5 in which]
    fit, platt, held = part(0, 2, 4), part(1), part(3)
    model = boosting.fit([r[0] for r in fit], [r[1] for r in fit])
    model.calibrate([r[0] for r in platt], [r[1] for r in platt])
    return model, {
        k: boosting.threshold([model.probability(f) for f, _ in held if f[0] == k], [y for f, y in held if f[0] == k], precision) for k in range(len(KINDS))
    }


_examples: dict[tuple, tuple] = {}


def model_for(spark: SparkSession, n_examples: int = 2400, seed: int = 7, precision: float = 0.98) -> tuple[boosting.Boosted, dict[int, float]]:
    """Fit on `n_examples` generated labelled texts (the bound of the sample that reaches the driver).

    The features come from the same expressions that score documents, so training and use can't differ.
    """
    if (key := (n_examples, seed)) not in _examples:
        import json

        made = [{"i": i, "text": t, "kind": k} for i, (t, k) in enumerate(examples(n_examples, seed))]
        frame = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(made)), F.lit("array<struct<i:int,text:string,kind:string>>"))))
        rows = (
            frame.select("i", "kind", F.explode(candidates(F.col("text"))).alias("s"))
            .select("i", F.col("s.start").alias("at"), (F.col("s.kind") == F.col("kind")).cast("int").alias("y"), features(F.col("s")).alias("f"))
            .collect()
        )
        rows.sort(key=lambda r: (r["i"], r["at"], tuple(r["f"])))
        _examples[key] = tuple((tuple(r["f"]), r["y"]) for r in rows)
    return _fitted(_examples[key], precision)


def _greedy(run: Column) -> Column:
    """Of overlapping spans (rank first, base spans before all) those that meet no better one that is kept; base spans are all kept."""
    overlap = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    ranked = F.reverse(F.array_sort(run))
    none = F.slice(run, 1, 0)
    add = lambda kept, s: F.when(s["base"] | ~F.exists(kept, lambda k: overlap(k, s)), F.concat(kept, F.array(s))).otherwise(kept)
    return F.when(F.size(run) == 1, run).otherwise(F.aggregate(ranked, none, add))


def without_overlaps(spans: Column) -> Column:
    """`_greedy` over each run of spans that overlap one another, directly or through others. A run's cost is the square of its own length only."""

    def runs(x: Column) -> Column:
        """x has `all`, sorted by start, and `reach`, the greatest end before each span."""
        n = F.size(x["all"])
        first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(x["all"], i)["start"] >= F.get(x["reach"], i)))
        return let(first, lambda f: F.flatten(F.transform(f, lambda a, j: let(F.slice(x["all"], a + 1, F.coalesce(F.get(f, j + 1), n) - a), _greedy))))

    by_start = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(0)
    reach = lambda s: running(F.transform(s, lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
    ordered = let(F.array_sort(spans, by_start), lambda s: F.struct(s.alias("all"), reach(s).alias("reach")))
    return F.when(F.size(spans) > 1, let(ordered, runs)).otherwise(spans)


def detect(docs: DataFrame, text_col: str = "text", n_examples: int = 2400, seed: int = 7, precision: float = 0.98) -> DataFrame:
    """`docs` with `pii_base` and `pii`: arrays of struct(order, start, end, kind, value) sorted by kind, then start.

    `pii` holds every base span and, from the best score down, each accepted candidate that overlaps neither a base span nor a
    candidate taken before. Columns of these two names in `docs` are replaced.
    """
    model, limits = model_for(docs.sparkSession, n_examples, seed, precision)
    text = F.coalesce(F.col(text_col), F.lit(""))
    limit = lambda s: functools.reduce(lambda a, k: F.when(s["order"] == k, F.lit(limits[k])).otherwise(a), limits, F.lit(2.0))
    names = ("order", "start", "end", "kind", "value")
    # the rank is in the first fields
    ranked = lambda s, p, base: F.struct(
        p.alias("p"), (s["end"] - s["start"]).alias("size"), (-s["start"]).alias("early"), (-s["order"]).alias("low"), F.lit(base).alias("base"), *[s[c].alias(c) for c in names]
    )

    df = docs.withColumn("pii_base", F.array_sort(F.concat(*[base_spans(k, text) for k in KINDS])))
    df = df.withColumn("__lx_c", candidates(text))
    df = df.withColumn("__lx_c", F.transform("__lx_c", lambda s: let(features(s), lambda f: ranked(s, model.expression(lambda i: f[i]), False))))
    df = df.withColumn("__lx_c", F.filter("__lx_c", lambda s: s["p"] >= limit(s)))
    base = F.transform("pii_base", lambda s: ranked(s, F.lit(2.0), True))
    df = df.withColumn("__lx_c", F.when(F.size("__lx_c") > 0, F.concat(base, F.col("__lx_c"))))
    plain = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in names])))
    return df.withColumn("pii", F.when(F.col("__lx_c").isNull(), F.col("pii_base")).otherwise(plain(without_overlaps(F.col("__lx_c"))))).drop("__lx_c")


def redact(docs: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """`docs` with `redacted`: the text with each detected span replaced by its kind in angle brackets."""
    df = detect(docs, text_col, **params)
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.coalesce(gap, F.lit(""))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    out = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return df.withColumn("redacted", F.when(F.col(text_col).isNotNull(), out))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    df = detect(docs.select("doc_id", "text"))
    n = lambda k: F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select("doc_id", *[n(k) for k in KINDS], F.sha2(span_string(F.col("pii_base")), 256).alias("base_sha256"), span_string(F.col("pii")).alias("spans"))
