"""Numbers in words for English, French, Russian and Arabic, as an Arrow function over texts.

No expression says these rules; texts without digits pass as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.session import ship

# Number words.
EN = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
EN_TENS = "_ _ twenty thirty forty fifty sixty seventy eighty ninety".split()
FR = "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf".split()
FR_TENS = "_ _ vingt trente quarante cinquante soixante soixante quatre-vingt quatre-vingt".split()
RU = "ноль один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split()
RU_TENS = "_ _ двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split()
RU_HUNDREDS = "_ сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split()
RU_SCALES = [("тысяча", "тысячи", "тысяч"), ("миллион", "миллиона", "миллионов"), ("миллиард", "миллиарда", "миллиардов")]
AR = "صفر واحد اثنان ثلاثة أربعة خمسة ستة سبعة ثمانية تسعة عشرة".split()
AR_TENS = "_ عشرة عشرون ثلاثون أربعون خمسون ستون سبعون ثمانون تسعون".split()


def _scaled(n: int, below: Callable[[int], str], names: list[str], plural: str = "", one: str | None = None) -> str:
    """n in groups of three digits with the names of the groups; `one` replaces "one thousand"."""
    parts = []
    for power in range(len(names), 0, -1):
        count, n = divmod(n, 1000**power)
        if count:
            name = names[power - 1]
            if power == 1 and count == 1 and one:
                parts.append(one)
            else:
                parts.append(f"{below(count)} {name}{plural if count > 1 and power > 1 else ''}")
    if n or not parts:
        parts.append(below(n))
    return " ".join(parts)


def english(n: int) -> str:
    def below(k: int) -> str:
        if k < 20:
            return EN[k]
        if k < 100:
            return EN_TENS[k // 10] + (f"-{EN[k % 10]}" if k % 10 else "")
        return f"{EN[k // 100]} hundred" + (f" and {below(k % 100)}" if k % 100 else "")

    return _scaled(n, below, ["thousand", "million", "billion", "trillion"])


def french(n: int) -> str:
    def below(k: int) -> str:
        if k < 20:
            return FR[k]
        if k < 100:
            tens, unit = divmod(k, 10)
            if tens in (7, 9):
                unit += 10
            stem = FR_TENS[tens]
            if unit == 0:
                return stem + ("s" if tens == 8 else "")
            joint = " et " if unit in (1, 11) and tens < 8 else "-"
            return f"{stem}{joint}{FR[unit]}"
        hundreds, rest = divmod(k, 100)
        stem = "cent" if hundreds == 1 else f"{FR[hundreds]} cent"
        return stem + ("s" if hundreds > 1 and not rest else "") if not rest else f"{stem} {below(rest)}"

    words = _scaled(n, below, ["mille", "million", "milliard", "billion"], "s", "mille")
    # cents and vingts lose their s before mille
    return re.sub(r"(cent|vingt)s mille", r"\1 mille", words)


def russian(n: int) -> str:
    def below(k: int, feminine: bool = False) -> str:
        parts = []
        if k >= 100:
            parts.append(RU_HUNDREDS[k // 100])
            k %= 100
            if not k:
                return parts[0]
        if k >= 20:
            parts.append(RU_TENS[k // 10])
            k %= 10
            if not k:
                return " ".join(parts)
        parts.append({1: "одна", 2: "две"}.get(k, RU[k]) if feminine else RU[k])
        return " ".join(parts)

    parts = []
    for power in (3, 2, 1):
        count, n = divmod(n, 1000**power)
        if count:
            last, teen = count % 10, 10 < count % 100 < 20
            form = 2 if teen or last == 0 or last > 4 else 0 if last == 1 else 1
            parts.append(f"{below(count, power == 1)} {RU_SCALES[power - 1][form]}")
    if n or not parts:
        parts.append(below(n))
    return " ".join(parts)


# Arabic names of powers of a thousand (one, two, three to ten) and of months.
AR_SCALES = [
    ("ألف", "ألفان", "آلاف"), ("مليون", "مليونان", "ملايين"), ("مليار", "ملياران", "مليارات"), ("تريليون", "تريليونان", "تريليونات"),
    ("كوادريليون", "كوادريليونان", "كوادريليونات"), ("كوينتليون", "كوينتليونان", "كوينتليونات"), ("سكستيليون", "سكستيليونان", "سكستيليونات"),
    ("سبتيليون", "سبتيليونان", "سبتيليونات"),
]
AR_MONTHS = "يناير فبراير مارس أبريل مايو يونيو يوليو أغسطس سبتمبر أكتوبر نوفمبر ديسمبر".split()
AR_HIJRI = ["محرم", "صفر", "ربيع الأول", "ربيع الثاني", "جمادى الأولى", "جمادى الثانية", "رجب", "شعبان", "رمضان", "شوال", "ذو القعدة", "ذو الحجة"]
AR_MINUS, AR_POINT = "سالب", "فاصيله"


def arabic(n: int) -> str:
    """Names of powers agree with their count: plural from three to ten, accusative from eleven to ninety-nine."""

    def below(k: int) -> str:
        if k <= 10:
            return AR[k]
        if k < 20:
            return {11: "أحد عشر", 12: "اثنا عشر"}.get(k, f"{AR[k - 10]} عشر")
        if k < 100:
            return AR_TENS[k // 10] if k % 10 == 0 else f"{AR[k % 10]} و {AR_TENS[k // 10]}"
        stem = {1: "مائة", 2: "مئتان", 8: "ثمانمائة"}.get(k // 100, f"{AR[k // 100][:-1]}مائة")
        return stem if k % 100 == 0 else f"{stem} و {below(k % 100)}"

    parts = []
    for power in range(len(AR_SCALES), 0, -1):
        one, two, few = AR_SCALES[power - 1]
        count, n = divmod(n, 1000**power)
        if count == 1 or count == 2:
            parts.append(one if count == 1 else two)
        elif count:
            parts.append(f"{below(count)} {few if 3 <= count % 100 <= 10 else one + 'ا' if count % 100 > 10 else one}")
    if n or not parts:
        parts.append(below(n))
    return " و ".join(parts)


def arabic_dates(text: str) -> str:
    """Dates d/m/y and y/m/d with their month's name; years before 1600 are of the Hijri calendar and come first."""

    def named(year: str, month: str, day: str, whole: str) -> str:
        if not 1 <= int(month) <= 12 or not 1 <= int(day) <= 31:
            return whole
        if int(year) < 1600:
            return f"{year} {AR_HIJRI[int(month) - 1]} {int(day)}"
        return f"{int(day)} {AR_MONTHS[int(month) - 1]} {year}"

    out = re.sub(r"(?<![\d/])(\d{4})/(\d{1,2})/(\d{1,2})(?![\d/])", lambda m: named(m[1], m[2], m[3], m[0]), text)
    return re.sub(r"(?<![\d/])(\d{1,2})/(\d{1,2})/(\d{4})(?![\d/])", lambda m: named(m[3], m[2], m[1], m[0]), out)


def arabic_numbers(text: str) -> str:
    """Dates, signs, points between digits and numbers in words; leading zeros are said one by one."""
    out = arabic_dates(text)
    out = re.sub(r"(?<![\w.,/-])-(?=\d)", f" {AR_MINUS} ", out)
    out = re.sub(r"(?<=\d)[.,](?=\d)", f" {AR_POINT} ", out)

    def say(m: re.Match) -> str:
        rest = m[0].lstrip("0")
        zeros = len(m[0]) - len(rest)
        if len(rest) > 27:
            return " " + " ".join(arabic(int(d)) for d in m[0]) + " "
        return " " + " ".join([AR[0]] * (zeros if rest else max(1, zeros)) + ([arabic(int(rest))] if rest else [])) + " "

    return re.sub(r"\s+", " ", re.sub(r"\d+", say, out)).strip()


CARDINALS = {"en": english, "fr": french, "ru": russian, "ar": arabic}
POINT = {"en": "point", "fr": "virgule", "ru": "запятая", "ar": AR_POINT}
_EN_IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def english_ordinal(n: int) -> str:
    head, joint, last = re.match(r"(.*?)([ -]?)([a-z]+)$", english(n)).groups()
    last = _EN_IRREGULAR.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th")
    return head + joint + last


def french_ordinal(n: int, feminine: bool = False) -> str:
    if n == 1:
        return "première" if feminine else "premier"
    words = french(n)
    if words.endswith("cinq"):
        return words + "uième"
    if words.endswith("neuf"):
        return words[:-1] + "vième"
    return re.sub(r"(e|s)$", "", words) + "ième" if not words.endswith("trois") else words + "ième"


# Russian months and ordinals, both in the genitive.
RU_MONTHS = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
RU_ORDINALS = (
    "нулевого первого второго третьего четвертого пятого шестого седьмого восьмого девятого десятого одиннадцатого двенадцатого тринадцатого четырнадцатого пятнадцатого шестнадцатого"
    " семнадцатого восемнадцатого девятнадцатого"
).split()
RU_TENS_ORDINALS = "_ _ двадцатого тридцатого сорокового пятидесятого шестидесятого семидесятого восьмидесятого девяностого".split()
RU_HUNDREDS_ORDINALS = "_ сотого двухсотого трехсотого четырехсотого пятисотого шестисотого семисотого восьмисотого девятисотого".split()


def russian_ordinal(n: int) -> str:
    """In the genitive; of a compound number only the last word is an ordinal."""
    if n < 20:
        return RU_ORDINALS[n]
    for unit, names in ((20, RU_ORDINALS), (100, RU_TENS_ORDINALS), (1000, RU_HUNDREDS_ORDINALS)):
        last = n % unit if unit != 20 else n % 100 if n % 100 < 20 else n % 10
        if last:
            name = names[last // {20: 1, 100: 10, 1000: 100}[unit]]
            return f"{russian(n - last)} {name}" if n > last else name
    return f"{russian(n // 1000)} тысячного" if n > 1999 else "тысячного"


def russian_dates(text: str) -> str:
    """Days and years beside a month's name, years before "г", and numbers with -го, as ordinals in the genitive."""
    month = rf"(?:{'|'.join(RU_MONTHS)})"
    year = lambda m: f"{russian_ordinal(int(m[1]))} года"
    out = re.sub(rf"(?<!\d)0?(\d{{1,2}})(?=\s+{month}\b)", lambda m: russian_ordinal(int(m[1])), text)
    out = re.sub(r"(?<!\d)([12]\d{3})\s*г(?:ода|\.|(?!\w))", year, out)
    out = re.sub(rf"({month}\s+)([12]\d{{3}})(?!\d)", lambda m: m[1] + russian_ordinal(int(m[2])), out)
    return re.sub(r"(?<!\d)(\d{1,9})-го\b", lambda m: russian_ordinal(int(m[1])), out)


# French months.
FR_MONTHS = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()


def french_dates(text: str) -> str:
    """Dates d/m/y, y/m/d and d/mm with their month's name; the first of a month is "premier". What is no date stays."""

    def named(day: str, month: str, year: str, whole: str) -> str:
        if not 1 <= int(month) <= 12 or not 1 <= int(day) <= 31:
            return whole
        return f"{'premier' if int(day) == 1 else int(day)} {FR_MONTHS[int(month) - 1]} {year}".strip()

    out = re.sub(r"(?<![\d/])(\d{4})/(\d{1,2})/(\d{1,2})(?![\d/])", lambda m: named(m[3], m[2], m[1], m[0]), text)
    out = re.sub(r"(?<![\d/])(\d{1,2})/(\d{1,2})/(\d{4})(?![\d/])", lambda m: named(m[1], m[2], m[3], m[0]), out)
    return re.sub(r"(?<![\d/])(\d{1,2})//?(0\d|1[0-2])(?![\d/])", lambda m: named(m[1], m[2], "", m[0]), out)


def french_fraction(over: int, under: int) -> str:
    name = {2: "demi", 3: "tiers", 4: "quart"}.get(under) or french_ordinal(under)
    return f"{french(over)} {name}{'s' if over > 1 and not name.endswith('s') else ''}"


def spoken(digits: str, lang: str) -> str:
    """A string of digits: leading zeros one by one, numbers of over twelve digits digit by digit."""
    say = CARDINALS[lang]
    if len(digits) > 12:
        return " ".join(say(int(d)) for d in digits)
    zeros = len(digits) - len(digits.lstrip("0"))
    rest = digits.lstrip("0")
    return " ".join([say(0)] * (zeros if rest else max(zeros, 1)) + ([say(int(rest))] if rest else []))


def numbers_to_words(text: str, lang: str) -> str:
    """Spaced thousands, decimals, ordinals (English, French), dates (Arabic) and plain numbers in words."""
    if lang == "ar":
        return arabic_numbers(text)
    out = re.sub(r"(?<![\d.,])(\d{1,3})((?:[  ]\d{3})+)(?!\d)", lambda m: m[0].replace(" ", "").replace(" ", ""), text)
    if lang == "en":
        out = re.sub(r"(?<![\d.,])(\d{1,3}(?:,\d{3})+)(?![\d])", lambda m: m[0].replace(",", ""), out)
        out = re.sub(r"\b(\d{1,12})(?:st|nd|rd|th)\b", lambda m: english_ordinal(int(m[1])), out)
    if lang == "ru":
        out = russian_dates(out)
    if lang == "fr":
        out = french_dates(out)
        out = re.sub(r"(?<![\d/.,-])(\d{1,3})/([1-9]\d{0,3})(?![\d/.,])", lambda m: french_fraction(int(m[1]), int(m[2])) if int(m[2]) > 1 else m[0], out)
        out = re.sub(r"(?<![\d.,])(\d{1,3}(?:,\d{3})+)(?![\d,])", lambda m: m[0].replace(",", ""), out)
        # a point and a comma are said as what they are, wherever they stand between digits
        out = re.sub(r"(?<=\d)([.,])(?=\d)", lambda m: " point " if m[1] == "." else " virgule ", out)
        out = re.sub(r"\b1(ers?|[eè]res?|res?)\b", lambda m: french_ordinal(1, not m[1].startswith("er")), out)
        out = re.sub(r"\b(\d{1,12})(?:i?[eè]mes?|es?)\b", lambda m: french_ordinal(int(m[1])), out)
    out = re.sub(r"(?<!\d)(\d+)[.,](\d+)(?!\d)", lambda m: f" {spoken(m[1], lang)} {POINT[lang]} {spoken(m[2], lang)} ", out)
    out = re.sub(r"\d+", lambda m: f" {spoken(m[0], lang)} ", out)
    return re.sub(r"\s+", " ", out).strip()


def to_words(text: Column, lang: str) -> Column:
    """The text with its numbers in words."""
    if lang not in CARDINALS:
        raise ValueError(f"no number words for {lang}")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: numbers_to_words(t, lang) if isinstance(t, str) and re.search(r"\d", t) else t)

    ship()
    udf = F.pandas_udf(run, "string")
    return udf(text)


#: The words of small numbers, for text that holds no larger ones.
def small_number_words(column: Column, lang: str, upto: int = 100) -> Column:
    """The words of an integer column from 0 to `upto`, by a literal table and without Python; null beyond."""
    words = F.array(*[F.lit(CARDINALS[lang](n)) for n in range(upto + 1)])
    return F.when(column.between(0, upto), F.element_at(words, column.cast("int") + 1))
