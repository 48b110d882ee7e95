"""Row filters and predicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import transliterate

#: Fixed value: what a French transcript may consist of.
FRENCH = r"^[0-9a-zA-ZàâäæçéèêëîïôœùûüÿÀÂÄÆÇÉÈÊËÎÏÔŒÙÛÜŸ'’ \-.,;:!?]+$"
#: Knots (seconds, characters) of the curves above or below which a transcript is too long or too short for its duration.
TOO_LONG = ((0.5, 30.0), (1.0, 50.0), (5.0, 200.0), (10.0, 350.0), (20.0, 580.0), (30.0, 750.0))
TOO_SHORT = ((0.5, 2.0), (1.0, 4.0), (5.0, 12.0), (10.0, 25.0), (20.0, 42.0), (30.0, 60.0))


def keep_and_rejected(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for which `keep` is true, and all others (false or unknown)."""
    known = F.coalesce(keep, F.lit(False))
    return df.filter(known), df.filter(~known)


def regex_match(column: Column, regex: str, mode: str = "match") -> Column:
    """"match" is anchored at the start, "fullmatch" at both ends, "search" nowhere."""
    forms = {"match": f"^(?:{regex})", "fullmatch": f"^(?:{regex})$", "search": regex}
    return column.rlike(forms[mode])


def include_exclude(column: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), exclude_all: bool = False) -> Column:
    """Full-matched by some `include` regex (if any are given) and not excluded: by any `exclude` regex or, with `exclude_all`, by all of them."""
    hits = lambda rs: [regex_match(column, r, "fullmatch") for r in rs]
    keep = reduce(lambda a, b: a | b, hits(include)) if include else F.lit(True)
    if exclude:
        keep = keep & ~reduce((lambda a, b: a & b) if exclude_all else (lambda a, b: a | b), hits(exclude))
    return keep


def apply_filters(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all boolean `filter_*` columns (which go), and a row (name added as `failed`) for each filter that another row fails."""
    names = [c for c in df.columns if c.startswith("filter_")]
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(False)) for c in names], F.lit(True))
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(c)) for c in names]))
    return df.filter(ok).drop(*names), df.filter(~ok).withColumn("failed", F.explode(failed)).drop(*names)


def row_status(start: Column, end: Column, duration: Column, text: Column, shortest: float = 0.1, longest: float = 3600.0) -> Column:
    """"ok", or what is wrong with an utterance first: missing duration, negative start, too short, too long, end before start, empty text."""
    return (
        F.when(duration.isNull(), "missing_duration")
        .when(start < 0, "negative_start")
        .when(end <= start, "end_before_start")
        .when(duration < shortest, "too_short")
        .when(duration >= longest, "too_long")
        .when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, "empty_text")
        .otherwise("ok")
    )


def derive_times(start: Column, end: Column, duration: Column) -> dict[str, Column]:
    """The third of start, end and duration from the two others; a duration alone starts at 0."""
    s = F.coalesce(start, F.when(end.isNotNull() & duration.isNotNull(), end - duration), F.when(end.isNull() & duration.isNotNull(), F.lit(0.0)))
    return {"start": s, "end": F.coalesce(end, s + duration), "duration": F.coalesce(duration, end - s)}


def spline(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The not-a-knot cubic through the knots, clamped at the ends; its coefficients are solved here and become literals."""
    xs, ys = np.array(knots, float).T
    n = len(xs)
    h = np.diff(xs)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((ys[i + 1] - ys[i]) / h[i] - (ys[i] - ys[i - 1]) / h[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, b)
    out = F.lit(float(ys[-1]))
    for i in reversed(range(n - 1)):
        t = x - F.lit(float(xs[i]))
        c1 = (ys[i + 1] - ys[i]) / h[i] - h[i] * (2 * m[i] + m[i + 1]) / 6
        piece = F.lit(float(ys[i])) + t * (F.lit(float(c1)) + t * (F.lit(float(m[i] / 2)) + t * F.lit(float((m[i + 1] - m[i]) / (6 * h[i])))))
        out = F.when(x < float(xs[i + 1]), piece).otherwise(out)
    return F.when(x <= float(xs[0]), float(ys[0])).otherwise(out)


def without_words(column: Column, words: Sequence[str]) -> Column:
    """Whether none of the words (of letters, digits and _) stands in the text as a word."""
    one = "|".join(words)
    return ~column.rlike(rf"(^|[^\p{{L}}\p{{N}}_])({one})($|[^\p{{L}}\p{{N}}_])")


def looks_machine_made(text: Column) -> Column:
    """All lower-case, or without any comma."""
    return ((text == F.lower(text)) & text.rlike(r"\p{L}")) | ~F.contains(text, F.lit(","))


def backchannel_only(text: Column, words: Sequence[str], most: int = 4) -> Column:
    """At most `most` tokens, each (without punctuation) in `words`, and at least one."""
    tokens = F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}\s'-]", " ")), r"\s+"), lambda t: t != "")
    return (F.size(tokens) > 0) & (F.size(tokens) <= most) & F.forall(tokens, lambda t: t.isin(*words))


def suspicious(text: Column) -> Column:
    """A small letter three times in a row, a word that begins with a doubled letter once accents are gone, or "familyfont"."""
    return text.rlike(r"([a-z])\1{2,}") | F.lower(transliterate(text)).rlike(r"(?<![a-z0-9_])([a-z])\1") | F.contains(text, F.lit("familyfont"))


def language_accepted(scores: Column, target: str, gap: float = 0.1) -> Column:
    """Whether `target` is the best of a map language -> score, or less than `gap` of the range of the scores behind it."""
    values = F.map_values(scores)
    best, worst, own = F.array_max(values), F.array_min(values), F.element_at(scores, target)
    return F.coalesce((own == best) | ((best - own) / F.nullif(best - worst, F.lit(0.0)) < gap), F.lit(False))
