"""Column expressions that normalise text for reading aloud. All stay inside Spark's expressions; no Python runs for a row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations and how they are read.
ABBREVIATIONS = {
    "Mr.": "Mister", "Mrs.": "Missus", "Ms.": "Miz", "Dr.": "Doctor", "Prof.": "Professor", "St.": "Saint",
    "vs.": "versus", "etc.": "et cetera", "e.g.": "for example", "i.e.": "that is", "approx.": "approximately",
}
#: Capitals that stay, and words that become small inside a run of capitals.
KEEP_UPPER = ["OK", "TV", "UK", "US", "USA", "BBC", "DVD", "NASA", "AM", "PM"]
SMALL_WORDS = ["and", "of", "the", "in", "for", "to", "a", "an", "on", "at"]
#: Shortest single word that is restyled, the pattern of words, and the values of roman numerals.
MIN_CAPS = 5
CAPS_WORD = "[A-Za-z][A-Za-z'’]*"
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
#: Letters and digits of any alphabet; of Java's own classes and edges of words only some versions know more than ASCII.
WORD = r"[\p{L}\p{N}_]"
#: White space of any kind.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Patterns of footnote marks and of titles that are numerals, the steps that settle white space, and the sentence
#: in which a word is tried out.
FOOTNOTE = rf"(?i)\[{SPACE}*(?:note{SPACE}*)?\d+{SPACE}*\]"
NUMERAL_TITLE = r"(?i)^(?:chapter\s+)?([ivxlcdm]+)\.?$"
WHITE_SPACE = [(r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{2,}", "\u0000"), (r"\n", " "), ("\u0000", "\n\n"), (r"[ \t]+", " ")]
CARRIER = ("They sailed on towards ", ", arriving at dusk.")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sub_map(c: Column, pattern: str, replace: Callable[[Column, Column], Column]) -> Column:
    """Replace each match by replace(match, gap before it); the pattern must not match the empty string."""
    def parts(x: Column) -> Column:
        return F.struct(F.regexp_extract_all(x, F.lit(f"({pattern})"), 1).alias("found"), F.split(x, pattern, -1).alias("gaps"))

    def joined(p: Column) -> Column:
        return F.array_join(F.transform(p["gaps"], lambda g, i: F.concat(g, F.when(i < F.size(p["found"]), let(F.get(p["found"], i), lambda m: replace(m, g))).otherwise(""))), "")

    return let(c, lambda x: let(parts(x), joined))


def strip_footnotes(c: Column) -> Column:
    return F.regexp_replace(c, FOOTNOTE, "")


def norm_punct(c: Column) -> Column:
    c = F.translate(c, " ‘’“”", " ''\"\"")
    for dash in "—–":
        c = F.replace(c, F.lit(dash), F.lit(f" {dash} "))
    return F.replace(c, F.lit("…"), F.lit("..."))


def expand_abbreviations(c: Column) -> Column:
    short = lambda k: k.replace(".", r"\.")
    return reduce(lambda x, kv: F.regexp_replace(x, f"{short(kv[0])}(?<!{WORD}{short(kv[0])})", kv[1]), ABBREVIATIONS.items(), c)


def normalize_caps(c: Column, min_len: int = MIN_CAPS) -> Column:
    """Small capitals to ordinary case: words in a run of two or more all-caps words, and single long ones."""
    def parts(x: Column) -> Column:
        words = F.regexp_extract_all(x, F.lit(f"({CAPS_WORD})"), 1)
        return let(words, lambda ws: F.struct(ws.alias("words"), F.transform(ws, lambda w: (F.length(w) > 1) & (F.upper(w) == w)).alias("capital"), F.split(x, CAPS_WORD, -1).alias("gaps")))

    def changed(p: Column, w: Column, i: Column) -> Column:
        capital = lambda k: F.coalesce(F.get(p["capital"], k), F.lit(False))
        in_run = capital(i - 1) & (i > 0) | capital(i + 1)
        title = F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, 2, 1 << 30)))
        stays = ~capital(i) | w.isin(KEEP_UPPER) | (~in_run & (F.length(w) < min_len))
        return F.when(stays, w).when(in_run & F.lower(w).isin(SMALL_WORDS), F.lower(w)).otherwise(title)

    def joined(p: Column) -> Column:
        return F.array_join(F.transform(p["gaps"], lambda g, i: F.concat(g, F.coalesce(changed(p, F.get(p["words"], i), i), F.lit("")))), "")

    return let(c, lambda x: let(parts(x), joined))


def norm_whitespace(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for pattern, by in WHITE_SPACE:
        c = F.regexp_replace(c, pattern, by)
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def roman_to_int(c: Column) -> Column:
    """Value of roman numerals without a check of their order; null for anything else."""
    values = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    digits = F.filter(F.transform(F.split(F.lower(c), ""), lambda x: F.element_at(values, x)), lambda x: x.isNotNull())
    signed = lambda ds: F.transform(ds, lambda v, i: F.when(F.get(ds, i + 1) > v, -v).otherwise(v))
    return F.when(F.lower(c).rlike("^[ivxlcdm]+$"), F.aggregate(let(digits, signed), F.lit(0), lambda a, v: a + v))


def chapter_title(c: Column) -> Column:
    numeral = F.regexp_extract(strip(c), NUMERAL_TITLE, 1)
    return F.when(numeral != "", F.concat(F.lit("Chapter "), roman_to_int(numeral).cast("string"))).otherwise(strip(c))


def slugify(c: Column, max_len: int = 40) -> Column:
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, max_len), F.lit("")), F.lit("book"))


def safe_filename(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.translate(c, '/\\:*?"<>|', "")), F.lit("")), F.lit("book"))


def safe_voice_name(c: Column) -> Column:
    """Null where nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", ""), F.lit(""))


def escape_marker(c: Column) -> Column:
    return F.regexp_replace(c, "([\\\\=;#\n])", r"\\$1")


def carrier_sentence(word: Column, say_as: Column) -> Column:
    return F.concat(F.lit(CARRIER[0]), F.coalesce(F.nullif(say_as, F.lit("")), word), F.lit(CARRIER[1]))
