"""Segmentation: paragraphs, sentences, clauses and bounded chunks with the kind of break that follows each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strip

#: Lengths of chunks and previews, and the patterns of sentence ends, clause ends and names.
MAX_CHUNK, PREVIEW = 450, 500
SENTENCE_END = "((?<=[.!?…])[\"'”’)\\]]*\\s+)(?=[\"'“‘(\\[]*[A-Z0-9])"
CLAUSE_END = r"(?<=[,;:])\s+"
CAP_WORD = r"(?U)\b[A-Z][a-zA-Z'’-]{2,}\b"


def paragraphs(df: DataFrame, key: str = "doc_id", text: str = "text", sep: str = "\n\n") -> DataFrame:
    """(key, para, paragraph) of the paragraphs that are not blank; `para` counts the blank ones too."""
    out = df.select(key, F.posexplode(F.split(text, sep, -1)).alias("para", "paragraph"))
    return out.withColumn("paragraph", strip(F.col("paragraph"))).where("paragraph <> ''")


def sentence_array(c: Column) -> Column:
    marked = F.regexp_replace(c, SENTENCE_END, "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001", -1), strip), lambda x: x != "")


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return df.select(key, F.posexplode(sentence_array(F.col(text))).alias("pos", "sentence"))


def clause_array(c: Column) -> Column:
    return F.split(c, CLAUSE_END, -1)


def cap_words(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return df.select(key, F.explode(F.regexp_extract_all(text, F.lit(f"({CAP_WORD})"), 1)).alias("word"))


def _packed(atoms: Column, limit: int) -> Column:
    """Greedy fold of atoms (text, kind before) into chunks (text, kind): flush when the next atom would not fit."""
    empty = F.struct(F.array().cast("array<struct<text:string,kind:string>>").alias("done"), F.lit("").alias("held"))

    def step(a: Column, x: Column) -> Column:
        full = (a["held"] != "") & (F.length(a["held"]) + F.length(x["text"]) + 1 > limit)
        done = F.when(full, F.array_append(a["done"], F.struct(a["held"].alias("text"), x["before"].alias("kind")))).otherwise(a["done"])
        held = F.when(full | (a["held"] == ""), x["text"]).otherwise(F.concat(a["held"], F.lit(" "), x["text"]))
        return F.struct(done.alias("done"), held.alias("held"))

    def finish(a: Column) -> Column:
        return F.when(a["held"] != "", F.array_append(a["done"], F.struct(a["held"].alias("text"), F.lit("sentence").alias("kind")))).otherwise(a["done"])

    return F.aggregate(atoms, empty, step, finish)


def _atoms(parts: Column, kind: str) -> Column:
    return F.transform(parts, lambda x: F.struct(x.alias("text"), F.lit(kind).alias("before")))


def _paragraph_chunks(c: Column, limit: int, strict: bool) -> Column:
    """Whole sentences as atoms. An overlong sentence is split into clauses where it is first (always, if strict)."""
    sentence = F.lit("sentence")

    def clauses(s: Column) -> Column:
        return F.transform(clause_array(s), lambda x, i: F.struct(x.alias("text"), F.when(i == 0, sentence).otherwise("clause").alias("before")))

    def every(found: Column) -> Column:
        return F.flatten(F.transform(found, lambda s: F.when(F.length(s) > limit, clauses(s)).otherwise(F.array(F.struct(s.alias("text"), sentence.alias("before"))))))

    def first(found: Column) -> Column:
        head = F.get(found, F.lit(0))
        start = F.when(F.length(head) > limit, _atoms(clause_array(head), "clause")).otherwise(_atoms(F.slice(found, 1, 1), "sentence"))
        return F.concat(start, _atoms(F.slice(found, 2, 1 << 30), "sentence"))

    return _packed(let(sentence_array(c), every if strict else first), limit)


def _sentence_chunks(c: Column, limit: int) -> Column:
    one = lambda s: F.array(F.struct(s.alias("text"), F.lit("sentence").alias("kind")))
    return F.flatten(F.transform(sentence_array(c), lambda s: F.when(F.length(s) <= limit, one(s)).otherwise(_packed(_atoms(clause_array(s), "clause"), limit))))


def chunk_array(text: Column, sep: str = "\n\n", max_chars: int = MAX_CHUNK, unit: str = "paragraph", strict: bool = False) -> Column:
    """All chunks of a text in order, as structs (text, kind); kind is the break after the chunk."""
    paras = F.filter(F.transform(F.split(text, sep, -1), strip), lambda p: p != "")

    def closed(cs: Column) -> Column:
        return F.transform(cs, lambda c, i: F.struct(c["text"].alias("text"), F.when(i == F.size(cs) - 1, "paragraph").otherwise(c["kind"]).alias("kind")))

    def packed(p: Column) -> Column:
        return let(_paragraph_chunks(p, max_chars, strict) if unit == "paragraph" else _sentence_chunks(p, max_chars), closed)

    return F.flatten(F.transform(paras, packed))


def _exploded(df: DataFrame, key: str, found: Column) -> DataFrame:
    out = df.select(key, F.posexplode(found).alias("chunk_index", "c"))
    return out.select(key, "chunk_index", F.col("c.text").alias("text"), F.col("c.kind").alias("kind"), F.length("c.text").alias("n_chars"))


def chunks(df: DataFrame, key: str = "doc_id", text: str = "text", sep: str = "\n\n", max_chars: int = MAX_CHUNK, unit: str = "paragraph", strict: bool = False) -> DataFrame:
    """(key, chunk_index, text, kind, n_chars) of all chunks. Folds and numbering stay inside a row: nothing is shuffled."""
    return _exploded(df, key, chunk_array(F.col(text), sep, max_chars, unit, strict))


def preview_array(c: Column, sep: str = "\n\n", max_chars: int = PREVIEW, unit: str = "paragraph") -> Column:
    """The first chunks of a text whose lengths, with a space each, stay in the budget; the first one always."""

    def within(cs: Column) -> Column:
        running = lambda i: F.aggregate(F.slice(cs, 1, i + 1), F.lit(0), lambda a, c: a + F.length(c["text"]) + 1)
        return F.filter(cs, lambda c, i: (i == 0) | (running(i) <= max_chars))

    # A chunk has at least one character, so that no more than these can fit.
    return let(F.slice(chunk_array(c, sep, min(MAX_CHUNK, max_chars), unit), 1, max_chars // 2 + 1), within)


def preview_chunks(df: DataFrame, key: str = "doc_id", text: str = "text", sep: str = "\n\n", max_chars: int = PREVIEW, unit: str = "paragraph") -> DataFrame:
    return _exploded(df, key, preview_array(F.col(text), sep, max_chars, unit))


def preview_sample(df: DataFrame, key: str = "doc_id", text: str = "text", sep: str = "\n\n", max_chars: int = PREVIEW) -> DataFrame:
    """(key, sample): the preview chunks joined, else the start of the text. Nothing is shuffled."""
    joined = F.array_join(F.transform(preview_array(F.col(text), sep, max_chars), lambda c: c["text"]), " ")
    return df.select(key, let(joined, lambda j: F.when(j != "", j).otherwise(F.substring(text, 1, max_chars))).alias("sample"))


def announced(found: DataFrame, titles: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks with the title before them as a chunk of its own, numbered anew. titles: (key, title), one for each key of the chunks."""
    head = titles.select(key, F.lit(0).alias("chunk_index"), F.concat("title", F.lit(".")).alias("text"), F.lit("paragraph").alias("kind"), (F.length("title") + 1).alias("n_chars"))
    return head.unionByName(found.withColumn("chunk_index", F.col("chunk_index") + 1))
