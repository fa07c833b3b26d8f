"""Registered queries: text functions, numbers and segmentation (groups C and D)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import numbers as N
from ..functions import text as X
from ..operators import segment as S
from ..sources.tables import table

# Texts with the features that the documents lack are composed from other tables.
DATED = "SELECT o_orderkey AS id, concat(day(o_orderdate), CASE WHEN day(o_orderdate) IN (11,12,13) THEN 'th' WHEN day(o_orderdate)%10=1 THEN 'st' WHEN day(o_orderdate)%10=2 THEN 'nd' WHEN day(o_orderdate)%10=3 THEN 'rd' ELSE 'th' END) AS nth, monthname(o_orderdate) AS mon, day(o_orderdate) AS d, year(o_orderdate) AS y FROM orders"
ONES = "['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen']"
TENS = "['zero','ten','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety']"


def sql_hundred(n):
    return f"(CASE WHEN ({n})<20 THEN {ONES}[({n})+1] WHEN ({n})%10=0 THEN {TENS}[({n})//10+1] ELSE {TENS}[({n})//10+1]||'-'||{ONES}[({n})%10+1] END)"


def sql_cardinal(n):
    upper = f"concat_ws(' ', CASE WHEN ({n})>=1000 THEN {ONES}[({n})//1000+1]||' thousand' END, CASE WHEN (({n})//100)%10>0 THEN {ONES}[(({n})//100)%10+1]||' hundred' END)"
    return f"(CASE WHEN ({n})<100 THEN {sql_hundred(n)} ELSE {upper} || CASE WHEN ({n})%100>0 THEN ' and '||{sql_hundred(f'({n})%100')} ELSE '' END END)"


def sql_ordinal(n):
    c = sql_cardinal(n)
    last = f"regexp_extract({c}, '([a-z]+)$', 1)"
    form = f"(CASE {last} WHEN 'one' THEN 'first' WHEN 'two' THEN 'second' WHEN 'three' THEN 'third' WHEN 'five' THEN 'fifth' WHEN 'eight' THEN 'eighth' WHEN 'nine' THEN 'ninth' WHEN 'twelve' THEN 'twelfth' ELSE CASE WHEN {last} LIKE '%y' THEN regexp_replace({last}, 'y$', 'ieth') ELSE {last}||'th' END END)"
    return f"(regexp_replace({c}, '[a-z]+$', '') || {form})"


def sql_year(n):
    return f"(CASE WHEN (({n})//100)%10=0 AND ({n})%100<10 THEN {sql_cardinal(n)} ELSE {sql_hundred(f'({n})//100')}||' '||CASE WHEN ({n})%100=0 THEN 'hundred' WHEN ({n})%100<10 THEN 'oh-'||{ONES}[({n})%100+1] ELSE {sql_hundred(f'({n})%100')} END END)"


def dated(spark, d):
    o = table(spark, d, "orders")
    day = F.dayofmonth("o_orderdate")
    suffix = F.when(day.isin(11, 12, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(day.cast("string"), suffix).alias("nth"), F.date_format("o_orderdate", "MMMM").alias("mon"), day.alias("d"), F.year("o_orderdate").alias("y"))


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@register("strip_footnotes", r"SELECT p_partkey, regexp_replace(p_name||' [ '||p_size||' ] x[Note '||p_size||'] y', '(?i)\[\s*(?:note\s*)?\d+\s*\]', '', 'g') AS clean FROM part")
def strip_footnotes(spark, d):
    raw = F.concat("p_name", F.lit(" [ "), "p_size", F.lit(" ] x[Note "), "p_size", F.lit("] y"))
    return table(spark, d, "part").select("p_partkey", X.strip_footnotes(raw).alias("clean"))


@register("norm_punct", "SELECT s_suppkey, replace(replace(replace(replace(replace(replace(replace(replace('“'||s_name||'” ‘x’ a b—c–d…', ' ', ' '), '‘', ''''), '’', ''''), '“', '\"'), '”', '\"'), '—', ' — '), '–', ' – '), '…', '...') AS clean FROM supplier")
def norm_punct(spark, d):
    raw = F.concat(F.lit("“"), "s_name", F.lit("” ‘x’ a b—c–d…"))
    return table(spark, d, "supplier").select("s_suppkey", X.norm_punct(raw).alias("clean"))


def _abbrev_sql(c):
    for k, v in X.ABBREVIATIONS.items():
        c = f"regexp_replace({c}, '\\b{k.replace('.', chr(92) + '.')}', '{v}', 'g')"
    return c


_ABBREV_RAW = "CASE p_size%11 WHEN 0 THEN 'Mr. ' WHEN 1 THEN 'Mrs. ' WHEN 2 THEN 'Ms. ' WHEN 3 THEN 'Dr. ' WHEN 4 THEN 'Prof. ' WHEN 5 THEN 'St. ' WHEN 6 THEN 'xMr. vs. ' WHEN 7 THEN 'etc. ' WHEN 8 THEN 'e.g. ' WHEN 9 THEN 'i.e. ' ELSE 'approx. ' END || p_name"


@register("expand_abbrev", f"SELECT p_partkey, {_abbrev_sql('raw')} AS clean FROM (SELECT p_partkey, {_ABBREV_RAW} AS raw FROM part)")
def expand_abbrev(spark, d):
    return table(spark, d, "part").select("p_partkey", X.expand_abbreviations(F.expr(_ABBREV_RAW)).alias("clean"))


_CAPS_SQL = """
WITH w AS (SELECT id, regexp_extract_all(text, '[A-Za-z][A-Za-z''’]*') AS ws, string_split_regex(text, '[A-Za-z][A-Za-z''’]*') AS gs FROM ({src})),
c AS (SELECT *, list_transform(ws, lambda x: length(x) > 1 AND upper(x) = x) AS up FROM w)
SELECT id, array_to_string(list_transform(gs, lambda g, i: g || CASE WHEN i > len(ws) THEN '' ELSE
  CASE WHEN NOT up[i] OR ws[i] IN ({keep}) OR (NOT (coalesce(up[nullif(i-1, 0)], false) OR coalesce(up[i+1], false)) AND length(ws[i]) < 5) THEN ws[i]
       WHEN (coalesce(up[nullif(i-1, 0)], false) OR coalesce(up[i+1], false)) AND lower(ws[i]) IN ({small}) THEN lower(ws[i])
       ELSE ws[i][1:1] || lower(ws[i][2:]) END END), '') AS clean FROM c
"""
_CAPS = {"keep": ", ".join(f"'{x}'" for x in X.KEEP_UPPER), "small": ", ".join(f"'{x}'" for x in X.SMALL_WORDS)}


@register("normalize_caps", _CAPS_SQL.format(src="SELECT doc_id AS id, text FROM documents", **_CAPS))
def normalize_caps(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("id"), X.normalize_caps(F.col("text")).alias("clean"))


@register("caps_runs", "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''’]*')) AS word, generate_subscripts(regexp_extract_all(text, '[A-Za-z][A-Za-z''’]*'), 1) AS i FROM documents), u AS (SELECT *, length(word) > 1 AND upper(word) = word AS up FROM w), n AS (SELECT *, lag(up) OVER p AS a, lead(up) OVER p AS b FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)) SELECT doc_id, count(*) FILTER (up) AS n_caps, count(*) FILTER (up AND (coalesce(a, false) OR coalesce(b, false))) AS n_in_run FROM n GROUP BY doc_id")
def caps_runs(spark, d):
    words = docs(spark, d).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"({X.CAPS_WORD})"), 1)).alias("i", "word"))
    up = words.withColumn("up", (F.length("word") > 1) & (F.upper("word") == F.col("word")))
    w = Window.partitionBy("doc_id").orderBy("i")
    near = F.coalesce(F.lag("up").over(w), F.lit(False)) | F.coalesce(F.lead("up").over(w), F.lit(False))
    return up.withColumn("near", near).groupBy("doc_id").agg(F.count_if("up").alias("n_caps"), F.count_if(F.col("up") & F.col("near")).alias("n_in_run"))


_WS_SQL = r"trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(replace(replace({c}, chr(13)||chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{2,}}', chr(1), 'g'), chr(10), ' '), chr(1), chr(10)||chr(10)), '[ \t]+', ' ', 'g'))"


@register("norm_whitespace", "SELECT doc_id, " + _WS_SQL.format(c="replace(text, '. ', '.  '||chr(13)||chr(10)||chr(10)||' ')") + " AS clean FROM documents")
def norm_whitespace(spark, d):
    return docs(spark, d).select("doc_id", X.norm_whitespace(F.replace("text", F.lit(". "), F.lit(".  \r\n\n "))).alias("clean"))


_ROMAN = "(CASE p_size//10 WHEN 1 THEN 'X' WHEN 2 THEN 'XX' WHEN 3 THEN 'XXX' WHEN 4 THEN 'XL' WHEN 5 THEN 'L' ELSE '' END || CASE p_size%10 WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' WHEN 5 THEN 'V' WHEN 6 THEN 'VI' WHEN 7 THEN 'VII' WHEN 8 THEN 'VIII' WHEN 9 THEN 'IX' ELSE '' END)"


def roman(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", "p_name", F.expr(_ROMAN.replace("//", " div ")).alias("roman"))


@register("roman_to_int", f"SELECT p_partkey, {_ROMAN} AS roman, p_size AS value FROM part")
def roman_to_int(spark, d):
    return roman(spark, d).select("p_partkey", "roman", X.roman_to_int(F.col("roman")).alias("value"))


@register("chapter_titles", f"SELECT p_partkey, CASE p_partkey%3 WHEN 0 THEN 'Chapter '||p_size WHEN 1 THEN 'Chapter '||p_size ELSE trim(p_name) END AS title FROM part")
def chapter_titles(spark, d):
    raw = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('chapter  ', lower(roman), '.') WHEN 1 THEN concat(' ', roman) ELSE concat(' ', p_name, ' ') END")
    return roman(spark, d).select("p_partkey", X.chapter_title(raw).alias("title"))


@register("slugify", "SELECT doc_id, coalesce(nullif(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40), ''), 'book') AS slug FROM documents")
def slugify(spark, d):
    return docs(spark, d).select("doc_id", X.slugify(F.col("text")).alias("slug"))


@register("job_ids", "SELECT p_partkey, coalesce(nullif(left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40), ''), 'book')||'-'||left(sha256(p_partkey::VARCHAR), 6) AS job_id FROM part")
def job_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(X.slugify(F.col("p_name")), F.lit("-"), F.left(F.sha2(F.col("p_partkey").cast("string"), 256), F.lit(6))).alias("job_id"))


@register("fingerprint", "SELECT doc_id, sha256(text) AS sha FROM documents")
def fingerprint(spark, d):
    return docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha"))


@register("safe_filename", """SELECT p_partkey, coalesce(nullif(trim(translate(p_name||': "'||p_type||'"/?', '/\\:*?"<>|', '')), ''), 'book')||CASE WHEN p_size > 25 THEN ' - '||p_brand ELSE '' END AS name FROM part""")
def safe_filename(spark, d):
    title = X.safe_filename(F.concat("p_name", F.lit(': "'), "p_type", F.lit('"/?')))
    return table(spark, d, "part").select("p_partkey", F.concat(title, F.when(F.col("p_size") > 25, F.concat(F.lit(" - "), "p_brand")).otherwise("")).alias("name"))


@register("safe_voice_name", "SELECT * FROM (SELECT c_custkey, nullif(regexp_replace(regexp_replace(CASE WHEN c_custkey%10=0 THEN '?!' ELSE ' '||c_name||' é' END, '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), '') AS voice FROM customer) WHERE voice IS NOT NULL")
def safe_voice_name(spark, d):
    raw = F.when(F.col("c_custkey") % 10 == 0, "?!").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" é")))
    return table(spark, d, "customer").select("c_custkey", X.safe_voice_name(raw).alias("voice")).where("voice is not null")


@register("escape_marker", r"SELECT doc_id, regexp_replace('a=b;c#d\e'||text, '([\\=;#\n])', '\\\1', 'g') AS marker FROM documents")
def escape_marker(spark, d):
    return docs(spark, d).select("doc_id", X.escape_marker(F.concat(F.lit("a=b;c#d\\e"), F.col("text"))).alias("marker"))


# Every distinct capitalised word of the documents; words of an even length have a respelling.
@register(
    "carrier_sentences",
    """SELECT word, 'They sailed on towards '||CASE WHEN length(word) % 2 = 0 THEN lower(word) ELSE word END||', arriving at dusk.' AS sentence
    FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents)
    WHERE regexp_full_match(word, '[A-Z][a-z]{2,}')""",
)
def carrier_sentences(spark, d):
    words = docs(spark, d).select(F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word")).where(F.col("word").rlike("^[A-Z][a-z]{2,}$")).distinct()
    say = F.when(F.length("word") % 2 == 0, F.lower("word")).otherwise("")
    return words.select("word", X.carrier_sentence(F.col("word"), say).alias("sentence"))


# Numbers ---------------------------------------------------------------------------------------------------------------
@register("number_words", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_orderkey*7+l_partkey)%10000 AS n, {sql_cardinal('(l_orderkey*7+l_partkey)%10000')} AS cardinal, {sql_ordinal('(l_orderkey*7+l_partkey)%10000')} AS ordinal, {sql_year('1100+(l_orderkey*7+l_partkey)%1000')} AS year_words FROM lineitem")
def number_words(spark, d):
    n = (F.col("l_orderkey") * 7 + F.col("l_partkey")) % 10000
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", n.alias("n"), N.cardinal(n).alias("cardinal"), N.ordinal(n).alias("ordinal"), N.year(n % 1000 + 1100).alias("year_words"))


_H, _M = "hour(ts::TIMESTAMP)%12+1", "minute(ts::TIMESTAMP)"


@register("speak_times", f"SELECT event_id, 'at '||{sql_cardinal(_H)}||CASE WHEN event_id%3=0 OR {_M}=0 THEN '' WHEN {_M}<10 THEN ' oh '||{ONES}[{_M}+1] ELSE ' '||{sql_hundred(_M)} END||' '||CASE WHEN hour(ts::TIMESTAMP)<12 THEN 'a' ELSE 'p' END||'.m. sharp' AS spoken FROM events")
def speak_times(spark, d):
    ts = F.col("ts").cast("timestamp")
    minute = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.when(F.col("event_id") % 3 == 1, ".").otherwise(":"), F.lpad(F.minute(ts).cast("string"), 2, "0")))
    raw = F.concat(F.lit("at "), (F.hour(ts) % 12 + 1).cast("string"), minute, F.when(F.hour(ts) < 12, "am").otherwise(" PM"), F.lit(" sharp"))
    return table(spark, d, "events").select("event_id", N.speak_times(raw).alias("spoken"))


@register("speak_year_ranges", f"SELECT id, 'from '||CASE WHEN id%5=0 THEN '1000-'||y ELSE {sql_year('y-100')}||' to '||{sql_year('y')} END||' on' AS spoken FROM ({DATED})")
def speak_year_ranges(spark, d):
    first = F.when(F.col("id") % 5 == 0, "1000").otherwise((F.col("y") - 100).cast("string"))
    return dated(spark, d).select("id", N.speak_year_ranges(F.concat(F.lit("from "), first, F.when(F.col("id") % 5 == 0, "-").otherwise(" – "), F.col("y").cast("string"), F.lit(" on"))).alias("spoken"))


@register("speak_dates", f"SELECT id, CASE id%3 WHEN 0 THEN 'the '||{sql_ordinal('d')}||' of '||mon||' came' ELSE 'on '||mon||' the '||{sql_ordinal('d')}||CASE id%3 WHEN 1 THEN ' came' ELSE ', '||y END END AS spoken FROM ({DATED})")
def speak_dates(spark, d):
    raw = F.expr("CASE id % 3 WHEN 0 THEN concat('the ', nth, ' ', mon, ' came') WHEN 1 THEN concat('on ', mon, ' ', nth, ' came') ELSE concat('on ', mon, ' ', d, ', ', y) END")
    return dated(spark, d).select("id", N.speak_dates(raw).alias("spoken"))


@register("speak_ordinals", f"SELECT id, 'the '||{sql_ordinal('id%1000')}||' time' AS spoken FROM ({DATED})")
def speak_ordinals(spark, d):
    return dated(spark, d).select("id", N.speak_ordinals(F.concat(F.lit("the "), (F.col("id") % 1000).cast("string"), F.lit("th time"))).alias("spoken"))


@register("speak_decimals", f"SELECT p_partkey, 'costs '||{sql_cardinal('p_size*37')}||' point '||{ONES}[p_size%10+1]||' '||{ONES}[p_size//10+1]||' now' AS spoken FROM part")
def speak_decimals(spark, d):
    raw = F.expr("concat('costs ', p_size * 37, '.', p_size % 10, p_size div 10, ' now')")
    return table(spark, d, "part").select("p_partkey", N.speak_decimals(raw).alias("spoken"))


@register("speak_integers", f"SELECT id, CASE id%4 WHEN 0 THEN 'born in '||{sql_year('y')} WHEN 1 THEN 'a crew of '||{sql_cardinal('y')} WHEN 2 THEN 'agent zero '||{ONES}[d%10+1] ELSE 'paid '||{sql_cardinal('id%10000')} END AS spoken FROM ({DATED})")
def speak_integers(spark, d):
    raw = F.expr("CASE id % 4 WHEN 0 THEN concat('born in ', y) WHEN 1 THEN concat('a crew of ', y) WHEN 2 THEN concat('agent 0', d % 10) ELSE concat('paid ', id % 10000) END")
    return dated(spark, d).select("id", N.speak_integers(raw).alias("spoken"))


@register("year_cue", "SELECT id, id%5 IN (0, 2, 3) AS cue FROM (SELECT o_orderkey AS id FROM orders)")
def year_cue(spark, d):
    before = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'it was in ' WHEN 1 THEN 'a crew of ' WHEN 2 THEN 'the summer of ' WHEN 3 THEN 'May 2, ' ELSE 'he paid ' END")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), N.year_cue(before).alias("cue"))


# Numbers in free text, as `numbers.expand_numbers` reads them. DuckDB's \b and \s know ASCII only: before the first step a mark is put
# between letters or numbers of other alphabets and those of ASCII (`sql_marked`), after the last one it is taken out again.
_OTHER, SP_SQL = r"[^\P{L}A-Za-z]|[^\P{N}0-9]", r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"


def sql_marked(c):
    before = rf"regexp_replace({c}, '({_OTHER})([A-Za-z0-9_])', '\1'||chr(2)||'_\2', 'g')"
    return rf"regexp_replace({before}, '([A-Za-z0-9_])({_OTHER})', '\1_'||chr(2)||'\2', 'g')"


def sql_unmarked(c):
    return f"replace(replace({c}, chr(2)||'_', ''), '_'||chr(2), '')"


def _let_sql(name, value, body):
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _int_sql(pattern):
    return f"TRY_CAST(regexp_extract(m, '{pattern}', 1) AS INT)"


def _digits_sql(c):
    return f"array_to_string(list_transform(string_split({c}, ''), lambda x: {ONES}[TRY_CAST(x AS INT) + 1]), ' ')"


def _whole_sql(raw):
    scales = "[" + ", ".join(f"'{x}'" for x in N.SCALES) + "]"
    word = f"CASE WHEN v = 0 THEN NULL WHEN k = len(p) // 3 AND v < 100 THEN 'and '||{sql_hundred('v')} ELSE concat_ws(' ', {sql_cardinal('v')}, {scales}[nullif(len(p) // 3 - k, 0)]) END"
    words = f"list_transform(range(1, len(p) // 3 + 1), lambda k: {_let_sql('v', 'TRY_CAST(substr(p, k * 3 - 2, 3) AS INT)', word)})"
    grouped = _let_sql("p", "lpad(r, ((len(r) + 2) // 3 * 3)::INT, '0')", f"array_to_string(list_filter({words}, lambda w: w IS NOT NULL), ' ')")
    short = _let_sql("n", "TRY_CAST(r AS INT)", sql_cardinal("n"))
    body = f"CASE WHEN len(r) <= 4 THEN {short} WHEN len(r) <= {3 * len(N.SCALES) + 3} THEN {grouped} ELSE {_digits_sql('r')} END"
    return _let_sql("r", f"coalesce(nullif(ltrim({raw}, '0'), ''), '0')", body)


def _sub_sql(src, pattern, said):
    """(id, clean) of `src` with each match m of a pattern said otherwise; g is the text between it and the match before."""
    parts = f"SELECT id, string_split_regex(clean, '{pattern}') AS gs, regexp_extract_all(clean, '{pattern}') AS ms FROM ({src})"
    return f"SELECT id, array_to_string(list_transform(gs, lambda g, i: g||CASE WHEN i > len(ms) THEN '' ELSE {_let_sql('m', 'ms[i]', said)} END), '') AS clean FROM ({parts})"


def sql_numbers(src):
    """(id, clean) of a marked (id, clean) with numbers, dates and times as words, step by step."""
    nth, th = _let_sql("n", _int_sql(r"(\d{1,2})"), sql_ordinal("n")), "(?:st|nd|rd|th)"
    hour, half = _let_sql("n", _int_sql(r"^(\d+)"), sql_hundred("n")), r"lower(regexp_extract(m, '(?i)([ap])\.?m\.?$', 1))"
    minute = _let_sql("n", _int_sql(r"^\d+[:.](\d{2})"), f"CASE WHEN n IS NULL OR n = 0 THEN '' WHEN n < 10 THEN ' oh '||{ONES}[n + 1] ELSE ' '||{sql_hundred('n')} END")
    src = _sub_sql(src, rf"(?i)\b\d{{1,2}}(?:[:.]\d{{2}})?{SP_SQL}?[ap]\.?m\.?\b", f"{hour}||{minute}||' '||{half}||'.m.'")

    years = f"CASE WHEN a BETWEEN 1100 AND 2099 AND b BETWEEN 1100 AND 2099 THEN {sql_year('a')}||' to '||{sql_year('b')} ELSE m END"
    src = _sub_sql(src, rf"\b\d{{4}}{SP_SQL}?[–—-]{SP_SQL}?\d{{4}}\b", _let_sql("a", _int_sql(r"^(\d+)"), _let_sql("b", _int_sql(r"(\d+)$"), years)))

    src = _sub_sql(src, rf"(?i)\b\d{{1,2}}{th}{SP_SQL}+(?:{N.MONTHS})\b", rf"{nth}||' of '||regexp_extract(m, '(\pL+)$', 1)")
    month_the = rf"regexp_extract(m, '^(\pL+)', 1)||' the '||{nth}"
    src = _sub_sql(src, rf"(?i)\b(?:{N.MONTHS}){SP_SQL}+\d{{1,2}}{th}\b", month_the)
    # There is no looking ahead here: what follows is at the start of the text behind.
    src = _sub_sql(src, rf"(?i)\b(?:{N.MONTHS}){SP_SQL}+\d{{1,2}}\b", rf"CASE WHEN regexp_matches(gs[i + 1], '(?i)^{SP_SQL}*{th}') THEN m ELSE {month_the} END")
    src = _sub_sql(src, rf"(?i)\b\d{{1,3}}{th}\b", _let_sql("n", _int_sql(r"^(\d+)"), sql_ordinal("n")))

    whole, parts = _whole_sql(r"regexp_extract(m, '^(\d+)', 1)"), _digits_sql(r"regexp_extract(m, '(\d+)$', 1)")
    src = _sub_sql(src, r"\b\d+\.\d+\b", f"{whole}||' point '||{parts}")

    cue = "in|since|by|from|until|till|during|around|about|circa|after|before|summer|winter|spring|autumn|year|early|late"
    near = sql_marked(f"right({sql_unmarked('g')}, 24)")
    is_year = rf"len(m) = 4 AND n BETWEEN 1100 AND 2099 AND regexp_matches({near}, '(?i)(?:\b(?:{cue})\b(?:{SP_SQL}+of)?|[,–—-]){SP_SQL}*$')"
    number = f"CASE WHEN len(m) > 4 OR m[1:1] = '0' THEN {_digits_sql('m')} WHEN {is_year} THEN {sql_year('n')} ELSE {sql_cardinal('n')} END"
    src = _sub_sql(src, r"\b\d+\b", _let_sql("n", "TRY_CAST(m AS INT)", number))
    return rf"SELECT id, regexp_replace(clean, '([ap]\.m)\.\.', '\1.', 'g') AS clean FROM ({src})"


# Segmentation ------------------------------------------------------------------------------------------------------------
_PARA = "SELECT doc_id, para, trim(p, chr(32)||chr(9)||chr(10)||chr(13)||chr(12)) AS paragraph FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS para FROM documents) WHERE trim(p, chr(32)||chr(9)||chr(10)||chr(13)||chr(12)) <> ''"
_SENT_OF = "list_filter(list_transform(string_split(regexp_replace({c}, '([.!?…][\"''”’)\\]]*\\s+)([\"''“‘(\\[]*[A-Z0-9])', '\\1'||chr(1)||'\\2', 'g'), chr(1)), lambda x: trim(x, chr(32)||chr(9)||chr(10)||chr(13)||chr(12))), lambda x: x <> '')"
_CLAUSE_OF = "string_split(regexp_replace({c}, '([,;:])\\s+', '\\1'||chr(1), 'g'), chr(1))"


@register("split_paragraphs", _PARA)
def split_paragraphs(spark, d):
    return S.paragraphs(docs(spark, d), sep="\n")


@register("split_sentences", f"SELECT doc_id, unnest({_SENT_OF.format(c='text')}) AS sentence, generate_subscripts({_SENT_OF.format(c='text')}, 1) - 1 AS pos FROM documents")
def split_sentences(spark, d):
    return S.sentences(docs(spark, d))


@register("split_clauses", f"SELECT doc_id, unnest({_CLAUSE_OF.format(c='text')}) AS clause, generate_subscripts({_CLAUSE_OF.format(c='text')}, 1) - 1 AS pos FROM documents")
def split_clauses(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(S.clause_array(F.col("text"))).alias("pos", "clause"))


@register("cap_words", "SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_]+(?:[''’-]+[\\p{L}\\p{N}\\p{M}_]+)*')) AS word FROM documents) WHERE regexp_full_match(word, '[A-Z][a-zA-Z''’-]{2,}') GROUP BY ALL")
def cap_words(spark, d):
    return S.cap_words(docs(spark, d)).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def chunk_sql(limit, unit="paragraph"):
    """Rows (doc_id, para, i, text, kind) of all chunks, by recursion over atoms."""
    if unit == "paragraph":
        atoms = f"SELECT doc_id, para, unnest(ts) AS t, generate_subscripts(ts, 1) AS i, nc, len(ts) AS n FROM (SELECT doc_id, para, CASE WHEN length(ss[1]) > {limit} THEN list_concat({_CLAUSE_OF.format(c='ss[1]')}, ss[2:]) ELSE ss END AS ts, CASE WHEN length(ss[1]) > {limit} THEN len({_CLAUSE_OF.format(c='ss[1]')}) ELSE 0 END AS nc FROM (SELECT doc_id, para, {_SENT_OF.format(c='paragraph')} AS ss FROM p))"
        gate, kind = "true", "CASE WHEN i <= nc THEN 'clause' ELSE 'sentence' END"
    else:
        atoms = f"SELECT doc_id, para, t, row_number() OVER (PARTITION BY doc_id, para ORDER BY s, i) AS i, count(*) OVER (PARTITION BY doc_id, para) AS n, s, i AS ci FROM (SELECT doc_id, para, s, unnest(cs) AS t, generate_subscripts(cs, 1) AS i FROM (SELECT doc_id, para, s, CASE WHEN length(x) > {limit} THEN {_CLAUSE_OF.format(c='x')} ELSE [x] END AS cs FROM (SELECT doc_id, para, unnest(ss) AS x, generate_subscripts(ss, 1) AS s FROM (SELECT doc_id, para, {_SENT_OF.format(c='paragraph')} AS ss FROM p))))"
        gate, kind = "a.ci > 1", "CASE WHEN a.ci > 1 THEN 'clause' ELSE 'sentence' END"
    kind = kind if unit != "paragraph" else kind.replace("i <= nc", "a.i <= a.nc")
    fits = f"{gate} AND length(r.cur) + length(a.t) + 1 <= {limit}"
    return f"""
WITH RECURSIVE p AS ({_PARA}), atoms AS ({atoms}),
r(doc_id, para, i, n, cur, done, kind) AS (
  SELECT doc_id, para, i, n, t, NULL::VARCHAR, NULL::VARCHAR FROM atoms WHERE i = 1
  UNION ALL
  SELECT a.doc_id, a.para, a.i, a.n, CASE WHEN {fits} THEN r.cur||' '||a.t ELSE a.t END, CASE WHEN {fits} THEN NULL ELSE r.cur END, CASE WHEN {fits} THEN NULL ELSE {kind} END
  FROM r JOIN atoms a ON a.doc_id = r.doc_id AND a.para = r.para AND a.i = r.i + 1),
flat AS (SELECT doc_id, para, i, done AS text, kind FROM r WHERE done IS NOT NULL UNION ALL SELECT doc_id, para, n + 1, cur, 'paragraph' FROM r WHERE i = n),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para, i) - 1 AS chunk_index, text, kind, length(text) AS n_chars FROM flat)
"""


@register("chunk_paragraphs", chunk_sql(450) + "SELECT * FROM chunks")
def chunk_paragraphs(spark, d):
    return S.chunks(docs(spark, d), sep="\n")


@register("chunk_sentences", chunk_sql(450, "sentence") + "SELECT * FROM chunks")
def chunk_sentences(spark, d):
    return S.chunks(docs(spark, d), sep="\n", unit="sentence")


@register("chunk_text", chunk_sql(450) + "SELECT doc_id, chunk_index, text FROM chunks")
def chunk_text(spark, d):
    return S.chunks(docs(spark, d), sep="\n").select("doc_id", "chunk_index", "text")


@register("break_kinds", chunk_sql(450) + "SELECT doc_id, kind, count(*) AS n, max(n_chars) AS longest FROM chunks GROUP BY ALL")
def break_kinds(spark, d):
    return S.chunks(docs(spark, d), sep="\n").groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))


@register("chunks_per_chapter", chunk_sql(450) + "SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY doc_id")
def chunks_per_chapter(spark, d):
    return S.chunks(docs(spark, d), sep="\n").groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


_PREVIEW = "SELECT * EXCLUDE (running) FROM (SELECT *, sum(n_chars + 1) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS running FROM chunks) WHERE running <= 500 OR chunk_index = 0"


@register("preview_chunks", chunk_sql(450) + _PREVIEW)
def preview_chunks(spark, d):
    return S.preview_chunks(docs(spark, d), sep="\n")


@register("preview_sample", chunk_sql(450) + f"SELECT doc_id, coalesce(nullif(s, ''), left(text, 500)) AS sample FROM documents LEFT JOIN (SELECT doc_id, string_agg(text, ' ' ORDER BY chunk_index) AS s FROM ({_PREVIEW}) GROUP BY doc_id) USING (doc_id)")
def preview_sample(spark, d):
    return S.preview_sample(docs(spark, d), sep="\n")


@register("announce_titles", chunk_sql(450) + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS chunk_index, text, kind, n_chars FROM (SELECT * FROM chunks UNION ALL SELECT doc_id, -1, 'Chapter '||(doc_id + 1)||'.', 'paragraph', length('Chapter '||(doc_id + 1)||'.') FROM documents)")
def announce_titles(spark, d):
    texts = docs(spark, d)
    titles = texts.select("doc_id", F.concat(F.lit("Chapter "), (F.col("doc_id") + 1).cast("string")).alias("title"))
    return S.announced(S.chunks(texts, sep="\n"), titles)
