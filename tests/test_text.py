"""Text functions on exact strings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexispark.functions import normalise as Z
from lexispark.functions import numbers as N
from lexispark.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("f", "text", "expected"),
    [
        (T.collapse_whitespace, "  a  b\n\tc ", "a b c"),
        (T.remove_parenthesis, "a (b) c", "a  c"),
        (T.remove_punctuation, "l'eau, vive-t-elle ?", "l'eau vive-t-elle"),
        (T.normalise_characters, "été “ok” …", 'été "ok" ...'),
        (T.transliterate, "Čœur été ß ﬁn ½ ǆ", "Cur ete  fin 12 dz"),
        (T.remove_tags, "<noise> l' eau", "l'eau"),
        (T.detokenise, "( a ) b , c .", "(a) b, c."),
        (T.roman_value, "MCMXCIV", 1994),
        (T.seconds_clock, "3661.5", "01:01:01.500"),
        (T.clock_seconds, "00:01:01,710", 61.71),
        (T.spoken_duration, "1h2m3s", 3723.0),
        (T.pad_numbers, "a1_b23", "a0000001_b0000023"),
        (T.remove_emoji, "a\U0001f600b", "ab"),
        (lambda c: T.split_position(c, "/", -1), "a/b/c", "c"),
        (lambda c: T.shorten(c, 6), "a b c d e f g h", "a b c … g h"),
    ],
)
def test_text(spark, f, text, expected):
    got = one(spark, text, lambda c: f(c.cast("double")) if f is T.seconds_clock else f(c))
    assert got == pytest.approx(expected) if isinstance(expected, float) else got == expected


@pytest.mark.parametrize(
    ("n", "words"),
    [(0, "zéro"), (21, "vingt et un"), (71, "soixante et onze"), (80, "quatre-vingts"), (81, "quatre-vingt-un"), (91, "quatre-vingt-onze"), (100, "cent"), (200, "deux cents"),
     (1000, "mille"), (80000, "quatre-vingt mille"), (1000000, "un million"), (2000001, "deux millions un")],
)
def test_french(n, words):
    assert N.french(n) == words


def test_other_numbers():
    assert N.english(1342) == "one thousand three hundred and forty-two"
    assert [N.english_ordinal(n) for n in (1, 2, 12, 20, 21)] == ["first", "second", "twelfth", "twentieth", "twenty-first"]
    assert [N.french_ordinal(n) for n in (1, 4, 5, 9, 80)] == ["premier", "quatrième", "cinquième", "neuvième", "quatre-vingtième"]
    assert N.russian(21000) == "двадцать одна тысяча"
    assert N.numbers_to_words("le 007", "fr") == "le zéro zéro sept"
    assert N.numbers_to_words("1 234,50", "fr") == "mille deux cent trente-quatre virgule cinquante"


@pytest.mark.parametrize(
    ("lang", "text", "expected"),
    [
        ("fr", "M. Dupont a payé 1 234,50 € à 14h30 (oui) “vite”", "monsieur dupont a payé mille deux cent trente-quatre euros cinquante à quatorze heures trente oui vite"),
        ("en", "Mr. Smith paid $3,200 for 5%", "mister smith paid three thousand two hundred dollars for five percent"),
        ("ru", "Ёлка 5%", "елка пять процентов"),
        ("ar", "كِتَابٌ ١٢ أحمد", "كتاب اثنا عشر أحمد"),
        ("de", "Schön & gut!", "schön und gut"),
    ],
)
def test_normalisers(spark, lang, text, expected):
    assert one(spark, text, lambda c: Z.format_text(c, lang)) == expected


def test_unknown_language():
    with pytest.raises(ValueError):
        Z.format_text(None, "xx")
