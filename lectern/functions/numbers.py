"""Numbers, dates and times as words. Word forms are British: "one hundred and five", hyphenated tens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, WORD, let, sub_map

#: Number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ["thousand", *(f"{x}illion" for x in ["m", "b", "tr", "quadr", "quint", "sext", "sept", "oct", "non"])]
SCALES += [f"{unit}{ten}illion" for ten in "dec vigint trigint quadragint quinquagint sexagint septuagint octogint nonagint".split() for unit in ["", *"un duo tre quattuor quin sex sept octo novem".split()]]
SCALES += ["centillion"]
IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
#: The first digit of a number, that no word runs into, the first letter of a month, and the end of a word.
DIGIT, MONTH_BEGINS, END = rf"\d(?<!{WORD}\d)", rf"(?=[jfmasond])(?<!{WORD})", f"(?!{WORD})"
#: Months and their short forms, the words before a number that make it a year, and the limits of years and quantities.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
YEAR_CUE = rf"(?iu)(?:(?<!{WORD})(?:in|since|by|from|until|till|during|around|about|circa|after|before|summer|winter|spring|autumn|year|early|late){END}(?:{SPACE}+of)?|[,–—-]){SPACE}*$"
YEAR_MIN, YEAR_MAX, MAX_DIGITS = 1100, 2099, 4
#: Patterns of what is read as words, and of the doubled full stop that a time leaves at the end of a sentence.
TIME = rf"(?iu){DIGIT}\d?(?:[:.]\d{{2}})?{SPACE}?[ap]\.?m(?:\.(?={WORD})|{END})"
YEAR_RANGE = rf"{DIGIT}\d{{3}}{SPACE}?[–—-]{SPACE}?\d{{4}}{END}"
DAY_MONTH = rf"(?iu){DIGIT}\d?(?:st|nd|rd|th){SPACE}+(?:{MONTHS}){END}"
MONTH_ORDINAL = rf"(?iu){MONTH_BEGINS}(?:{MONTHS}){SPACE}+\d{{1,2}}(?:st|nd|rd|th){END}"
MONTH_DAY = rf"(?iu){MONTH_BEGINS}(?:{MONTHS}){SPACE}+\d{{1,2}}{END}(?!{SPACE}*(?:st|nd|rd|th))"
ORDINAL = rf"(?iu){DIGIT}\d{{0,2}}(?:st|nd|rd|th){END}"
DECIMAL, INTEGER = rf"{DIGIT}\d*\.\d+{END}", rf"{DIGIT}\d*{END}"
DOUBLED_STOP = r"([ap]\.m)\.\."


def _word(words: list[str], i: Column) -> Column:
    return F.get(F.split(F.lit(" ".join(words)), " "), i.cast("int"))


def below_hundred(n: Column) -> Column:
    tens = _word(TENS, F.floor(n / 10))
    return F.when(n < 20, _word(ONES, n)).when(n % 10 == 0, tens).otherwise(F.concat(tens, F.lit("-"), _word(ONES, n % 10)))


def cardinal(n: Column) -> Column:
    """Words of 0 to 9999."""
    low, hundreds, thousands = n % 100, F.floor(n / 100) % 10, F.floor(n / 1000)
    upper = F.concat_ws(" ", F.when(thousands > 0, F.concat(_word(ONES, thousands), F.lit(" thousand"))), F.when(hundreds > 0, F.concat(_word(ONES, hundreds), F.lit(" hundred"))))
    tail = F.when(low > 0, F.concat(F.lit(" and "), below_hundred(low))).otherwise("")
    return F.when(n < 100, below_hundred(n)).otherwise(F.concat(upper, tail))


def ordinal(n: Column) -> Column:
    forms = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])

    def ending(words: Column) -> Column:
        last = F.regexp_extract(words, "([a-z]+)$", 1)
        regular = F.when(last.endswith("y"), F.regexp_replace(last, "y$", "ieth")).otherwise(F.concat(last, F.lit("th")))
        return F.concat(F.regexp_replace(words, "[a-z]+$", ""), F.coalesce(F.element_at(forms, last), regular))

    return let(cardinal(n), ending)


def year(n: Column) -> Column:
    high, low = F.floor(n / 100), n % 100
    pair = F.when(low == 0, F.lit("hundred")).when(low < 10, F.concat(F.lit("oh-"), _word(ONES, low))).otherwise(below_hundred(low))
    return F.when((high % 10 == 0) & (low < 10), cardinal(n)).otherwise(F.concat(below_hundred(high), F.lit(" "), pair))


def digits(c: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(c, ""), lambda d: d != ""), lambda d: _word(ONES, d.cast("int"))), " ")


def _int(c: Column) -> Column:
    return c.try_cast("int")


def whole(raw: Column) -> Column:
    """Cardinal words of a run of digits as one number, by groups of three; runs too long for the names of groups are read digit by digit."""
    def grouped(d: Column) -> Column:
        many = F.ceil(F.length(d) / 3).cast("int")

        def group(v: Column, k: Column) -> Column:
            named = F.concat_ws(" ", cardinal(v), _word(SCALES, many - k - 1))
            return F.when(v == 0, None).when((k == many) & (v < 100), F.concat(F.lit("and "), below_hundred(v))).otherwise(named)

        at = lambda k: _int(F.substring(F.lpad(d, many * 3, F.lit("0")), k * 3 - 2, F.lit(3)))
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(1), many), lambda k: let(at(k), lambda v: group(v, k))))

    def said(d: Column) -> Column:
        return F.when(F.length(d) <= 4, cardinal(_int(d))).when(F.length(d) <= 3 * len(SCALES) + 3, grouped(d)).otherwise(digits(d))

    return let(F.regexp_replace(raw, r"^0+(?=\d)", ""), said)


def speak_times(c: Column) -> Column:
    def said(m: Column, _: Column) -> Column:
        hour = cardinal(_int(F.regexp_extract(m, r"^(\d{1,2})", 1)))
        minute = _int(F.nullif(F.regexp_extract(m, r"[:.](\d{2})", 1), F.lit("")))
        mid = F.when(minute.isNull() | (minute == 0), "").when(minute < 10, F.concat(F.lit(" oh "), cardinal(minute))).otherwise(F.concat(F.lit(" "), cardinal(minute)))
        half = F.lower(F.regexp_extract(m, r"(?i)([ap])\.?m\.?$", 1))
        return F.concat(hour, mid, F.lit(" "), half, F.lit(".m."))

    return sub_map(c, TIME, said)


def speak_year_ranges(c: Column) -> Column:
    def said(m: Column, _: Column) -> Column:
        a, b = _int(F.regexp_extract(m, r"^(\d+)", 1)), _int(F.regexp_extract(m, r"(\d+)$", 1))
        return F.when(a.between(YEAR_MIN, YEAR_MAX) & b.between(YEAR_MIN, YEAR_MAX), F.concat(year(a), F.lit(" to "), year(b))).otherwise(m)

    return sub_map(c, YEAR_RANGE, said)


def speak_dates(c: Column) -> Column:
    number = lambda m: ordinal(_int(F.regexp_extract(m, r"(\d{1,2})", 1)))
    month = lambda m: F.regexp_extract(m, rf"(?iu)(?<!{WORD})({MONTHS}){END}", 1)
    c = sub_map(c, DAY_MONTH, lambda m, _: F.concat(number(m), F.lit(" of "), month(m)))
    the = lambda m, _: F.concat(month(m), F.lit(" the "), number(m))
    c = sub_map(c, MONTH_ORDINAL, the)
    return sub_map(c, MONTH_DAY, the)


def speak_ordinals(c: Column) -> Column:
    return sub_map(c, ORDINAL, lambda m, _: ordinal(_int(F.regexp_extract(m, r"^(\d+)", 1))))


def speak_decimals(c: Column) -> Column:
    return sub_map(c, DECIMAL, lambda m, _: F.concat(whole(F.regexp_extract(m, r"^(\d+)", 1)), F.lit(" point "), digits(F.regexp_extract(m, r"(\d+)$", 1))))


def year_cue(before: Column) -> Column:
    """Whether the last 24 characters before a number say that it is a year."""
    return F.right(before, F.lit(24)).rlike(YEAR_CUE)


def speak_integers(c: Column) -> Column:
    def said(m: Column, before: Column) -> Column:
        n = F.when(F.length(m) <= MAX_DIGITS, _int(m))
        is_year = (F.length(m) == 4) & n.between(YEAR_MIN, YEAR_MAX) & year_cue(before)
        return F.when((F.length(m) > MAX_DIGITS) | m.startswith("0"), digits(m)).when(is_year, year(n)).otherwise(cardinal(n))

    return sub_map(c, INTEGER, said)


def expand_numbers(c: Column) -> Column:
    """All rewrites in their order; a text without digits has none of them to go through."""
    steps = (speak_times, speak_year_ranges, speak_dates, speak_ordinals, speak_decimals, speak_integers)
    said = let(c, lambda x: F.when(x.rlike(r"\d"), reduce(lambda t, f: f(t), steps, x)).otherwise(x))
    return F.regexp_replace(said, DOUBLED_STOP, "$1.")
