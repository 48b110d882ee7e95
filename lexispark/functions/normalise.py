"""Whole-text normalisers by language: composed of the text functions, numbers by the number words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions import text as T
from lexispark.functions.numbers import CARDINALS, to_words

#: Abbreviations.
ABBREVIATIONS = {
    "fr": {"M.": "monsieur", "MM.": "messieurs", "Mme": "madame", "Mlle": "mademoiselle", "Dr": "docteur", "etc.": "et cetera", "km": "kilomètres", "kg": "kilogrammes"},
    "en": {"Mr.": "mister", "Mrs.": "missis", "Dr.": "doctor", "St.": "saint", "etc.": "et cetera", "vs.": "versus", "km": "kilometers", "kg": "kilograms"},
}


#: Units behind a number, and spellings, in French.
FRENCH_UNITS = {
    "km²": "kilomètres carrés", "m²": "mètres carrés", "cm²": "centimètres carrés", "mm²": "millimètres carrés", "m³": "mètres cubes", "cm³": "centimètres cubes", "mm³": "millimètres cubes",
    "km": "kilomètres", "m": "mètres", "cm": "centimètres", "mm": "millimètres", "kg": "kilogrammes", "g": "grammes", "mg": "milligrammes", "°C": "degrés celsius", "°F": "degrés fahrenheit",
}
FRENCH_SPELLINGS = {"clefs": "clés", "clef": "clé", "bistrots": "bistros", "bistrot": "bistro", "feignants": "fainéants", "feignant": "fainéant", "caetera": "cetera"}
FRACTIONS = {"½": "1/2", "¼": "1/4", "¾": "3/4", "⅓": "1/3", "⅔": "2/3"}


def _french_signs(text: Column) -> Column:
    """Quotes, web addresses, signs, units and prices as they are said, before numbers are put into words."""
    out = F.regexp_replace(text, "``|''", '"')
    web = lambda w: F.replace(F.replace(F.regexp_replace(w, r"(?<=\w)\.(?=\w)", " point "), F.lit("://"), F.lit(" deux points slash slash ")), F.lit("/"), F.lit(" slash "))
    said = lambda w: F.when(w.rlike(r"^(https?://|www\.)"), web(w)).otherwise(w)
    out = F.when(out.rlike(r"(^|\s)(https?://|www\.)"), F.array_join(F.transform(F.split(out, r"\s+"), said), " ")).otherwise(out)
    for sign, plain in FRACTIONS.items():
        out = F.replace(out, F.lit(sign), F.lit(plain))
    out = F.regexp_replace(out, r"(?<![\p{L}\p{N}])-(?=[0-9])", " moins ")
    out = F.regexp_replace(out, r"(?<![0-9])([0-9]{1,2})\s?h\s?00(?![0-9])", "$1 heures ")
    for sign, word in (("€", "euros"), (r"\$", "dollars"), ("£", "livres")):
        out = F.regexp_replace(out, rf"([0-9]),([0-9]{{2}})\s?{sign}", f"$1 {word} $2")
    for unit, word in FRENCH_UNITS.items():
        out = F.regexp_replace(out, rf"(?<=[0-9])\s?{unit}(?![\p{{L}}\p{{N}}²³])", f" {word} ")
    return F.regexp_replace(out, r"(?<=\p{L})2(?=\p{L})", " to ")


def latin(text: Column, lang: str = "fr", lower: bool = True, keep_punctuation: bool = False) -> Column:
    """Typographic characters, hours, abbreviations, symbols and numbers resolved; punctuation removed unless kept.

    In French, too, web addresses, dates, fractions, units and prices are said, what stands in brackets is kept, and an apostrophe ends its word.
    """
    french = lang == "fr"
    out = T.remove_tags(text, glue_apostrophe=not french)
    out = T.normalise_characters(out) if french else T.remove_parenthesis(T.normalise_characters(out))
    out = _french_signs(out) if french else out
    hours = {"fr": r"$1 heures $2", "en": r"$1 $2"}.get(lang)
    if hours:
        out = F.regexp_replace(out, r"(?<![0-9])([0-9]{1,2})\s?[h:]\s?([0-9]{2})(?![0-9:])", hours)
    out = T.replace_words(out, ABBREVIATIONS.get(lang, {}))
    out = T.symbols_to_words(out, lang)
    if lang in CARDINALS:
        out = to_words(out, lang)
    out = F.regexp_replace(out, r"(?<![\p{L}\p{N}])-+|-+(?![\p{L}\p{N}])", " ")
    if not keep_punctuation:
        out = T.remove_punctuation(out)
    out = F.lower(out) if lower else out
    if french:
        out = F.regexp_replace(T.replace_words(out, FRENCH_SPELLINGS), r"'+(?=\S)", "' ")
    return T.collapse_whitespace(T.remove_special(out))


#: Signs and abbreviations in Arabic words.
ARABIC_SIGNS = {
    "ق.م": "قبل الميلاد", "هـ": "هجري", "%": "في المئة", "٪": "في المئة", "€": "يورو", "$": "دولار", "£": "جنيه", "¥": "ين", "₹": "روبية هندية", "&": "و", "+": "زائد",
    "=": "يساوي", "°": "درجة",
}


def arabic(text: Column, keep_punctuation: bool = False, keep_latin: bool = False) -> Column:
    """No links, diacritics or letters stretched beyond two; western digits, signs, dates and numbers in words.

    Letters beyond Arabic ones go unless `keep_latin`; punctuation goes unless kept, but apostrophes and hyphens within words stay.
    """
    out = F.regexp_replace(text, r"https?://\S+|www\.\S+", " ")
    for sign, word in ARABIC_SIGNS.items():
        out = F.replace(out, F.lit(sign), F.lit(f" {word} "))
    out = F.regexp_replace(out, r"[\u064b-\u0652\u0670\u0640]", "")
    out = F.translate(out, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
    out = to_words(out, "ar")
    out = F.regexp_replace(out, r"([\x{0621}-\x{064A}])\1{2,}", "$1$1")
    letters = r"\p{L}\p{M}" if keep_latin else r"\p{IsArabic}&&[\p{L}\p{M}]"
    if keep_punctuation:
        marks = r"\p{P}\p{S}" if keep_latin else r"!-/:-@\[-`{-~،؛؟«»"
        out = F.regexp_replace(out, rf"[^\s{marks}[{letters}]]", "")
        return T.collapse_whitespace(out)
    out = F.regexp_replace(out, r"(?<![\p{L}\p{N}])['’-]+|['’-]+(?![\p{L}\p{N}])", " ")
    return T.collapse_whitespace(F.regexp_replace(out, rf"[^\s'’\-[{letters}]]", " "))


#: Signs and units in Russian words.
RUSSIAN_SIGNS = {
    "°F": "градус по фаренгейту", "°C": "градус по цельсию", "м³": "метр в кубе", "м²": "квадратный метр", "%": "процентов", "€": "евро", "$": "долларов", "£": "фунтов", "&": "энд", "№": "номер",
    "@": "собака", "*": "умножить на", "+": "плюс", "=": "равно", "°": "градусов",
}
RUSSIAN_UNITS = {"кг": "килограмм", "мл": "миллилитр", "км": "километр", "см": "сантиметр", "мм": "миллиметр"}


def russian(text: Column, keep_punctuation: bool = False, split_hyphens: bool = True, lower: bool = True, plain_e: bool = True) -> Column:
    """Dates, numbers, signs and units in words, ё as е, lower case; hyphens split words unless they are kept. Latin words stay as they are."""
    out = F.translate(text, "Ёё", "Ее") if plain_e else text
    for unit, word in RUSSIAN_UNITS.items():
        out = F.regexp_replace(out, rf"(?<=[0-9])\s?{unit}(?![\p{{L}}\p{{N}}²³])", f" {word} ")
    for sign, word in RUSSIAN_SIGNS.items():
        out = F.replace(out, F.lit(sign), F.lit(f" {word} "))
    out = to_words(out, "ru")
    if not keep_punctuation:
        out = F.translate(out, "-'", "  ") if split_hyphens else F.replace(out, F.lit("'"), F.lit(" "))
        out = F.regexp_replace(out, r"(?<![\p{L}\p{N}])-+|-+(?![\p{L}\p{N}])", " ")
        out = T.remove_punctuation(T.normalise_characters(F.translate(out, "—–", "  ")))
    return T.collapse_whitespace(F.lower(out) if lower else out)


def format_text(text: Column, lang: str) -> Column:
    """The normaliser of a language; an unknown one is an error."""
    if lang in ("fr", "en", "de", "es"):
        return latin(text, lang)
    if lang == "ar":
        return arabic(text)
    if lang == "ru":
        return russian(text)
    raise ValueError(f"no normaliser for {lang}")
