"""Text functions as Column expressions. Regexes name their classes outright, so that no Unicode flag changes their meaning."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}]+"
WORD = r"[\p{L}\p{N}_]"
MARKS = r"[!-/:-@\[-`{-~«»“”„’‘…–—¿¡]"


def bind(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _each(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def remove_parenthesis(text: Column) -> Column:
    return F.regexp_replace(text, r"\([^)]*\)", "")


def clean_brackets(text: Column) -> Column:
    """Without (...) and [...], whitespace collapsed."""
    return collapse_whitespace(_each(text, [(r"\([^)]*\)", " "), (r"\[[^\]]*\]", " ")]))


def remove_punctuation(text: Column, strong: bool = False) -> Column:
    """Without punctuation; hyphens and apostrophes stay unless `strong`."""
    keep = MARKS if strong else r"[!-&(-,./:-@\[-`{-~«»“”„…–—¿¡]"
    return collapse_whitespace(F.regexp_replace(text, keep, " "))


#: What typographic characters become.
SPECIAL = [
    ("\u0092", "'"), ("[‘’ʼ´`]", "'"), ("[“”„«»]", '"'), ("[–—−‐‑]", "-"), ("…", "..."),
    ("[\u00a0\u2002\u2003\u2009\u202f]", " "), ("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE"), ("ﬁ", "fi"), ("ﬂ", "fl"),
    ("[\ufeff\u200b\u200e\u200f\u00ad]", ""), ("[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f]", ""),
]


def normalise_characters(text: Column) -> Column:
    """Composed accents; plain quotes, dashes, ellipses, spaces and ligatures; no control characters."""
    # letter + combining mark, for the letters that European languages use
    pairs = []
    for mark, plain, composed in (
        ("\u0301", "aeiouyAEIOUY", "áéíóúýÁÉÍÓÚÝ"), ("\u0300", "aeiouAEIOU", "àèìòùÀÈÌÒÙ"), ("\u0302", "aeiouAEIOU", "âêîôûÂÊÎÔÛ"),
        ("\u0308", "aeiouyAEIOU", "äëïöüÿÄËÏÖÜ"), ("\u0303", "anoANO", "ãñõÃÑÕ"), ("\u0327", "cC", "çÇ"),
    ):
        pairs += [(a + mark, b) for a, b in zip(plain, composed, strict=True)]
    compose = lambda t: F.when(t.rlike("[\u0300-\u0327]"), reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, t)).otherwise(t)
    text = bind(text, compose)
    return _each(text, SPECIAL)


def remove_quotes(text: Column) -> Column:
    return _each(text, [('"', ""), ("''+", ""), (r"(^| )'([^']*)'( |$)", "$1$2$3")])


def remove_tags(text: Column, glue_apostrophe: bool = True, glue_dash: bool = False) -> Column:
    """Without <...> words; the space after a kept apostrophe (and around a dash) closes up."""
    out = F.regexp_replace(text, "<[^>]*>", " ")
    if glue_apostrophe:
        out = F.regexp_replace(out, r"'\s+", "'")
    if glue_dash:
        out = F.regexp_replace(out, r"\s*-\s*", "-")
    return collapse_whitespace(out)


def split_words(text: Column) -> Column:
    """Words at spaces and after apostrophes, which stay with the word before."""
    return F.filter(F.split(F.replace(text, F.lit("'"), F.lit("' ")), r"\s+"), lambda w: w != "")


def split_sentences(text: Column, marks: str = ".?!;") -> Column:
    """Pieces that end with a run of marks, trimmed."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(rf"[^{marks}]+[{marks}]*"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


@lru_cache(maxsize=1)
def _decomposed() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition leaves one ASCII character, and those that it leaves several of."""
    plain = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000}
    return {k: v for k, v in plain.items() if len(v) == 1}, {k: v for k, v in plain.items() if len(v) > 1}


def transliterate(text: Column) -> Column:
    """ASCII: characters are decomposed (NFKD) and what is beyond ASCII then goes, marks first of all."""
    one, several = _decomposed()
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spread = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    plain = bind(F.translate(text, "".join(one), "".join(one.values())), lambda t: F.when(t.rlike(f"[{''.join(several)}]"), spread(t)).otherwise(t))
    return F.when(text.rlike(r"[^\u0000-\u007f]"), F.regexp_replace(plain, r"[^\u0000-\u007f]", "")).otherwise(text)


def remove_special(text: Column, keep: str = r"\p{L}\p{N}\s.,;:!?'\"()%€$&+=@*/°_-") -> Column:
    return F.regexp_replace(text, f"[^{keep}]", "")


def remove_emoji(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]", "")


def replace_word(text: Column, word: str, by: str) -> Column:
    """`word` where no letter, digit or _ touches it."""
    quoted = "".join(c if c.isalnum() or c in " _" else "\\" + c for c in word)
    return F.regexp_replace(text, rf"(?<!{WORD}){quoted}(?!{WORD})", by.replace("\\", "\\\\").replace("$", "\\$"))


def replace_words(text: Column, table: dict[str, str]) -> Column:
    return reduce(lambda t, kv: replace_word(t, *kv), table.items(), text)


#: Symbols in words.
SYMBOLS = {
    "fr": {"%": "pour cent", "€": "euros", "$": "dollars", "£": "livres", "&": "et", "@": "arobase", "+": "plus", "=": "égal", "°": "degrés", "×": "fois"},
    "en": {"%": "percent", "€": "euros", "$": "dollars", "£": "pounds", "&": "and", "@": "at", "+": "plus", "=": "equals", "°": "degrees", "×": "times"},
    "de": {"%": "Prozent", "€": "Euro", "$": "Dollar", "£": "Pfund", "&": "und", "@": "at", "+": "plus", "=": "gleich", "°": "Grad", "×": "mal"},
    "es": {"%": "por ciento", "€": "euros", "$": "dólares", "£": "libras", "&": "y", "@": "arroba", "+": "más", "=": "igual", "°": "grados", "×": "por"},
    "ru": {"%": "процентов", "€": "евро", "$": "долларов", "£": "фунтов", "&": "и", "@": "собака", "+": "плюс", "=": "равно", "°": "градусов", "×": "умножить"},
    "ar": {"%": "في المئة", "€": "يورو", "$": "دولار", "£": "جنيه", "&": "و", "+": "زائد", "=": "يساوي", "°": "درجة"},
}


def symbols_to_words(text: Column, lang: str) -> Column:
    """Currency signs move behind their number, then each symbol becomes its word."""
    out = F.regexp_replace(text, r"([€$£])\s?([0-9][0-9.,]*[0-9]|[0-9])", "$2 $1")
    for sign, word in SYMBOLS[lang].items():
        out = F.replace(out, F.lit(sign), F.lit(f" {word} "))
    return collapse_whitespace(out)


#: Buckwalter's letters for Arabic ones, in the same order.
ARABIC = "ءآأؤإئابةتثجحخدذرزسشصضطظعغـفقكلمنهوىي\u064b\u064c\u064d\u064e\u064f\u0650\u0651\u0652\u0670ٱ"
BUCKWALTER = "'|>&<}AbptvjHxd*rzs$SDTZEg_fqklmnhwYyFNKaui~o`{"


def buckwalter(text: Column) -> Column:
    """Arabic script in Buckwalter's letters."""
    return F.translate(text, ARABIC, BUCKWALTER)


def from_buckwalter(text: Column) -> Column:
    return F.translate(text, BUCKWALTER, ARABIC)


def wer_normalise(text: Column, mode: str = "") -> Column:
    """"fr": un and une become 1. "+": what is no word character becomes a space. "++": words lose a final s, too."""
    if mode == "fr":
        return replace_words(text, {"une": "1", "un": "1"})
    out = text
    if "+" in mode:
        out = collapse_whitespace(F.regexp_replace(out, r"[^\p{L}\p{N}_]+", " "))
    if "++" in mode:
        out = F.regexp_replace(out, r"s(?=\s|$)", "")
    return out


def clean_caption(text: Column) -> Column:
    """Captions: no brackets, emoji or special characters; all-capital lines in sentence case."""
    out = clean_brackets(remove_emoji(normalise_characters(text)))
    shout = lambda t: (t == F.upper(t)) & t.rlike(r"\p{L}")
    sentence = lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2))))
    return bind(collapse_whitespace(remove_special(out)), lambda t: F.when(shout(t), sentence(t)).otherwise(t))


#: Hesitations.
FILLERS = {"fr": ["euh", "heu", "hum", "hm", "mh", "ben", "bah"], "en": ["uh", "um", "hm", "hmm", "er", "erm", "mm"]}


def strip_fillers(text: Column, words: list[str]) -> Column:
    """Without tokens that are hesitations once lower-cased and freed of punctuation."""
    bare = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}']", "")
    return F.array_join(F.filter(F.split(text, " "), lambda w: (w != "") & ~bare(w).isin(*words)), " ")


def detokenise(text: Column) -> Column:
    """No space before punctuation or after an opening bracket."""
    return collapse_whitespace(_each(F.regexp_replace(text, "<[^>]*>", " "), [(r"\s+([.,;:!?)\]])", "$1"), (r"([(\[])\s+", "$1")]))


#: Openings of texts that a recogniser makes up on silence.
MADE_UP = ["sous-titres réalisés par", "merci d'avoir regardé cette vidéo", "voir une autre vidéo"]


def made_up(text: Column) -> Column:
    """Whether a text, without its marks [*], begins with one of these."""
    low = F.lower(F.regexp_replace(F.regexp_replace(text, r"^\[\*\] | \[\*\]", ""), r"^\s+|\s+$", ""))
    return reduce(lambda a, p: a | F.startswith(low, F.lit(p)), MADE_UP, F.lit(False))


def acronyms(text: Column) -> Column:
    """Distinct tokens of two or more capitals; a text that is all capitals has none."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}])\p{Lu}{2,}(?![\p{L}\p{N}])"), F.lit(0)))
    return F.when(text == F.upper(text), F.array().cast("array<string>")).otherwise(found)


def speaker_name(name: Column) -> Column:
    """Lower case, without (...), unaccented, words joined by _."""
    return F.regexp_replace(F.lower(transliterate(F.trim(remove_parenthesis(name)))), r"[^a-z0-9]+", "_")


def dataset_name(path: Column) -> Column:
    """A path's last two folders without the parts that name splits, casing and maximal durations."""
    base = F.array_join(F.slice(F.split(F.regexp_replace(path, "/+$", ""), "/"), -2, 2), "_")
    bare = _each(F.lower(base), [(r"_max[0-9]+", ""), (r"(^|_)(train|dev|test|valid|validation|cased|nocased|casepunc)(?=_|$)", "")])
    return F.regexp_replace(bare, "^_+|_+$", "")


def pad_numbers(id_: Column, width: int = 7) -> Column:
    """Each run of digits padded with zeros to `width`."""
    zeros = "0" * width
    padded = F.regexp_replace(id_, "([0-9]+)", f"{zeros}$1")
    return F.regexp_replace(padded, f"0*?([0-9]{{{width}}})(?![0-9])", "$1")


def shorten(text: Column, most: int) -> Column:
    """Texts of over `most` words keep their first most/2 and last most/2 - 1 words around an ellipsis."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    cut = F.concat(F.slice(words, 1, most // 2), F.array(F.lit("…")), F.slice(words, -(most // 2 - 1), most // 2 - 1))
    return F.when(F.size(words) > most, F.array_join(cut, " ")).otherwise(text)


def split_position(text: Column, separator: str, first: int, last: int | None = None) -> Column:
    """The part at a position (from 0; negative from the end), or the parts first .. last - 1 joined again."""
    parts = F.split(text, "\\Q" + separator + "\\E")
    n = F.size(parts)
    at = lambda i: F.lit(i) if i >= 0 else n + i
    if last is None:
        return F.get(parts, at(first))
    return F.array_join(F.slice(parts, at(first) + 1, F.greatest(at(last) - at(first), F.lit(0))), separator)


def clock_seconds(clock: Column) -> Column:
    """[[HH:]MM:]SS with . or , before the fraction, in seconds."""
    parts = F.reverse(F.split(F.replace(clock, F.lit(","), F.lit(".")), ":"))
    return F.aggregate(F.transform(parts, lambda x, i: x.try_cast("double") * F.pow(F.lit(60.0), i)), F.lit(0.0), lambda a, x: a + x)


def seconds_clock(seconds: Column) -> Column:
    """HH:MM:SS.mmm."""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def spoken_duration(text: Column) -> Column:
    """XhYmZs, each part optional, in seconds."""
    part = lambda unit: F.coalesce(F.regexp_extract(text, rf"([0-9]+(?:\.[0-9]+)?)\s*{unit}", 1).try_cast("double"), F.lit(0.0))
    return part("h") * 3600 + part("m") * 60 + part("s")


def roman_value(text: Column) -> Column:
    """A Roman number's value: a letter counts negatively before a larger one."""
    value = F.create_map(*[F.lit(x) for pair in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in pair])
    digits = F.transform(F.filter(F.split(F.upper(text), ""), lambda c: c != ""), lambda c: F.coalesce(F.element_at(value, c), F.lit(0)))
    follow = F.concat(F.slice(digits, 2, F.greatest(F.size(digits), F.lit(1))), F.array(F.lit(0)))
    return F.aggregate(F.zip_with(digits, follow, lambda a, b: F.when(a < b, -a).otherwise(a)), F.lit(0), lambda a, x: a + x)
