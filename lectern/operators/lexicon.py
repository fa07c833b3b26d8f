"""Pronunciation lexicon and the mining of unknown names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from .segment import cap_words

#: Rows up to which a dimension is broadcast; a larger one is joined by a shuffle.
SMALL = 500_000


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def lexicon_dim(entries: DataFrame) -> DataFrame:
    """(key, say_as) of entries (word, say_as): empty ones dropped; of case variants the last in key order wins."""
    return entries.where("word <> '' and say_as <> ''").groupBy(F.lower("word").alias("key")).agg(F.max_by("say_as", "word").alias("say_as"))


def apply_lexicon(c: Column, entries: dict[str, str]) -> Column:
    """Respell in one pass, longest word first, without a second look at what was put in. For a lexicon that fits a literal."""
    words = {k.lower(): v for k, v in sorted(entries.items()) if k and v}
    if not words:
        return c
    pattern = r"(?iU)\b(?:" + "|".join("\\Q" + w + "\\E" for w in sorted(words, key=len, reverse=True)) + r")\b"
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return X.sub_map(c, pattern, lambda m, _: F.coalesce(F.element_at(table, F.lower(m)), m))


def _tokens(c: Column) -> Column:
    """Words and what stands between them, in order: what any entry matches is a run of them."""
    return F.split(c, r"(?U)\b", -1)


def lexicon_prefixes(dim: DataFrame) -> DataFrame:
    """The trie of a lexicon (key, say_as) as rows: (prefix, say, more, n) of every beginning of an entry by whole tokens.

    `say` is null if the beginning is no entry itself; `more` tells whether a longer one goes on from it; n is its tokens.
    """
    tokens = F.filter(_tokens(F.col("key")), lambda t: t != "")
    rows = dim.select("say_as", tokens.alias("t")).select("say_as", "t", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("n"))
    whole = F.col("n") == F.size("t")
    rows = rows.select(F.array_join(F.slice("t", F.lit(1), F.col("n")), "").alias("prefix"), F.when(whole, F.col("say_as")).alias("say"), (~whole).alias("more"), "n")
    return rows.groupBy("prefix").agg(F.max("say").alias("say"), F.max("more").alias("more"), F.max("n").alias("n"))


_ENTRIES = "array<struct<prefix:string,at:struct<say:string,more:boolean>>>"


def _table(prefixes: DataFrame, buckets: int) -> DataFrame:
    """One row, one value: the prefixes as a hash table, an array of small maps."""
    at = F.struct("prefix", F.struct("say", "more").alias("at"))
    held = prefixes.groupBy(F.pmod(F.xxhash64("prefix"), F.lit(buckets)).alias("b")).agg(F.collect_list(at).alias("x"))
    every = prefixes.sparkSession.range(buckets).select(F.col("id").alias("b")).join(held, "b", "left")
    ordered = every.agg(F.sort_array(F.collect_list(F.struct("b", "x"))).alias("a"))
    return ordered.select(F.transform("a", lambda v: F.map_from_entries(F.coalesce(v["x"], F.array().cast(_ENTRIES)))).alias("table"))


def respelt(c: Column, table: Column, buckets: int, most: int, blanks: bool = True) -> Column:
    """Respell by a table of prefixes of at most `most` tokens: the leftmost run that is an entry, the longest there, and so on
    behind it. Runs of one token need no order; only longer ones are chosen in turn, since they may overlap. `blanks` tells
    whether an entry may begin with a token that is one blank, which otherwise is not looked up."""

    def at(tb: Column, x: Column) -> Column:
        return F.try_element_at(F.get(tb, F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")), x)

    def longest(tb: Column, low: Column, first: Column, i: Column) -> Column:
        start = F.struct(F.get(low, i).alias("run"), F.when(first["say"].isNotNull(), 1).otherwise(0).alias("n"), first["say"].alias("say"), first["more"].alias("on"))

        def longer(a: Column, k: Column) -> Column:
            def further(run: Column, e: Column) -> Column:
                n, say = F.when(e["say"].isNotNull(), k + 1).otherwise(a["n"]), F.coalesce(e["say"], a["say"])
                return F.struct(run.alias("run"), n.alias("n"), say.alias("say"), F.coalesce(e["more"], F.lit(False)).alias("on"))

            return X.let(F.concat(a["run"], F.get(low, i + k)), lambda run: X.let(at(tb, run), lambda e: further(run, e)))

        steps = F.sequence(F.lit(1), F.lit(most - 1))
        found = F.aggregate(steps, start, lambda a, k: F.when(a["on"] & (i + k < F.size(low)), longer(a, k)).otherwise(a))
        return X.let(found, lambda f: F.when(f["n"] > 0, F.struct(f["n"].alias("n"), f["say"].alias("say"))))

    def hits(tb: Column, low: Column) -> Column:
        alone = lambda e: F.when(e["say"].isNotNull(), F.struct(F.lit(1).alias("n"), e["say"].alias("say")))
        firsts = F.transform(low, lambda x: at(tb, x) if blanks else F.when(x != " ", at(tb, x)))
        return F.transform(firsts, (lambda e: alone(e)) if most == 1 else (lambda e, i: F.when(e["more"], longest(tb, low, e, i)).otherwise(alone(e))))

    def joined(parts: Column, hits: Column) -> Column:
        words = F.zip_with(parts, hits, lambda x, h: F.when(h["n"] == 1, h["say"]).otherwise(x))
        if most == 1:
            return F.array_join(words, "")
        runs = F.filter(F.transform(hits, lambda h, i: F.struct(i.alias("at"), (i + h["n"]).alias("end"), h["say"].alias("say"))), lambda r: r["end"] - r["at"] > 1)
        none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,end:int,say:string>>").alias("kept"))
        taken = F.aggregate(runs, none, lambda a, r: F.when(r["at"] >= a["end"], F.struct(r["end"].alias("end"), F.array_append(a["kept"], r).alias("kept"))).otherwise(a), lambda a: a["kept"])

        def piece(ws: Column, kept: Column, k: Column) -> Column:
            begin = F.coalesce(F.get(kept, k - 1)["end"], F.lit(0))
            size = F.coalesce(F.get(kept, k)["at"], F.size(ws)) - begin
            return F.concat(F.array_join(F.slice(ws, begin + 1, size), ""), F.coalesce(F.get(kept, k)["say"], F.lit("")))

        return X.let(words, lambda ws: X.let(taken, lambda kept: F.array_join(F.transform(F.sequence(F.lit(0), F.size(kept)), lambda k: piece(ws, kept, k)), "")))

    return X.let(table, lambda tb: X.let(_tokens(c), lambda parts: X.let(X.let(F.transform(parts, F.lower), lambda low: hits(tb, low)), lambda hs: joined(parts, hs))))


#: Bytes up to which a lexicon's trie goes to all tasks as one value, and what each of its rows takes besides its strings.
TABLE_BYTES, ROW_BYTES = 128 << 20, 80


def _size(prefixes: DataFrame) -> tuple[int, int, int, bool]:
    """(rows, tokens of the longest, bytes, whether an entry begins with a blank token) of a trie."""
    text = F.octet_length("prefix") + F.coalesce(F.octet_length("say"), F.lit(0)) + ROW_BYTES
    r = prefixes.agg(F.count("*").alias("rows"), F.max("n").alias("most"), F.sum(text).alias("bytes"), F.max(F.col("prefix") == " ").alias("blanks")).first()
    return r["rows"], r["most"] or 0, r["bytes"] or 0, bool(r["blanks"])


def lexicon_join(texts: DataFrame, dim: DataFrame, key: str = "doc_id", text: str = "text", limit: int = TABLE_BYTES) -> DataFrame:
    """(key, said): `apply_lexicon` for a lexicon of any size, phrases and words with apostrophes included.

    The lexicon's trie becomes one value, a hash table, if it is measured to be at most `limit` bytes; texts are respelt where they
    are read. Of a larger lexicon, the entries are kept whose words all occur in the texts (only distinct words are shuffled). If these are
    still too many, the runs of tokens of each text meet the trie, and each text the part of it that it needs, by a shuffle.
    """
    prefixes = lexicon_prefixes(dim)
    rows, most, size, blanks = _size(prefixes)
    if size > limit:
        met = texts.select(F.explode(F.array_distinct(F.transform(_tokens(F.col(text)), F.lower))).alias("w")).distinct()
        needed = dim.select("key", "say_as", F.explode(F.array_distinct(F.filter(_tokens(F.col("key")), lambda t: t != ""))).alias("w"))
        missing = needed.join(met, "w", "left_anti").select("key").distinct()
        prefixes = lexicon_prefixes(dim.join(missing, "key", "left_anti"))
        rows, most, size, blanks = _size(prefixes)
    if not rows:
        return texts.select(key, F.col(text).alias("said"))
    if size > limit:
        return _respelt_by_runs(texts, prefixes, most, key, text)
    buckets = max(1, rows // 4)
    with_table = texts.select(key, text, _table(prefixes, buckets).scalar().alias("_table"))
    return with_table.select(key, respelt(F.col(text), F.col("_table"), buckets, most, blanks).alias("said"))


def _respelt_by_runs(texts: DataFrame, prefixes: DataFrame, most: int, key: str, text: str) -> DataFrame:
    numbered = texts.select(key, text)
    runs = lambda low: F.flatten(F.transform(low, lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(low) - i)), lambda n: F.array_join(F.slice(low, i + 1, n), ""))))
    found = numbered.select(F.col(key).alias("_id"), F.explode(F.array_distinct(X.let(F.transform(_tokens(F.col(text)), F.lower), runs))).alias("prefix"))
    told = found.distinct().join(prefixes, "prefix").groupBy("_id").agg(F.array(F.map_from_entries(F.collect_list(F.struct("prefix", F.struct("say", "more").alias("at"))))).alias("_table"))
    both = numbered.join(told, F.col(key).eqNullSafe(F.col("_id")), "left")
    return both.select(key, F.when(F.col("_table").isNull(), F.col(text)).otherwise(respelt(F.col(text), F.col("_table"), 1, most)).alias("said"))


def clean_text(c: Column, lexicon: dict[str, str] | None = None, respell: bool = True) -> Column:
    """All cleaning in its fixed order, as one projection."""
    for f in (X.strip_footnotes, X.norm_punct, X.expand_abbreviations, X.normalize_caps, N.expand_numbers):
        c = f(c)
    return X.norm_whitespace(apply_lexicon(c, lexicon or {}) if respell else c)


def known_words(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.select(F.explode(F.split(text, r"\s+")).alias("w")).select(F.lower("w").alias("word")).where("word <> ''").distinct()


def unknown_names(counts: DataFrame, known: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words (word, ..) that are in neither dimension, plain or without a trailing 's; three equi anti-joins."""
    known = small(known.select(F.col("word").alias("k")))
    keyed = counts.withColumn("low", F.lower("word"))
    keyed = keyed.join(known, F.col("low") == F.col("k"), "left_anti")
    keyed = keyed.join(small(lexicon.select(F.col("key").alias("x"))), F.col("low") == F.col("x"), "left_anti")
    keyed = keyed.withColumn("stem", F.rtrim("low", F.lit("'s")))
    return keyed.join(known, F.col("stem") == F.col("k"), "left_anti").drop("low", "stem")


def suggest(texts: DataFrame, known: DataFrame, lexicon: DataFrame, k: int = 40) -> DataFrame:
    counts = cap_words(texts).groupBy("word").agg(F.count("*").alias("n"))
    return unknown_names(counts, known, lexicon).orderBy(F.desc("n"), "word").limit(k)


def suggest_per_book(texts: DataFrame, known: DataFrame, lexicon: DataFrame, book: str = "source", k: int = 40) -> DataFrame:
    counts = cap_words(texts, book).groupBy(book, "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy(book).orderBy(F.desc("n"), "word")
    return unknown_names(counts, known, lexicon).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def upsert(lexicon: DataFrame, changes: DataFrame, removed: DataFrame) -> DataFrame:
    """Entries after removals (in any case) and additions (exact case, later wins)."""
    kept = lexicon.join(removed.select(F.lower("word").alias("r")), F.lower("word") == F.col("r"), "left_anti")
    both = kept.withColumn("seq", F.lit(0)).unionByName(changes.withColumn("seq", F.lit(1)))
    return both.groupBy("word").agg(F.max_by("say_as", "seq").alias("say_as"))
