"""Worked examples of the text and number functions."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import numbers as N
from lectern.functions import text as X
from lectern.operators import lexicon as L
from lectern.operators import markup as M
from lectern.operators import segment as S

CASES = [
    (X.chapter_title, "Chapter XII", "Chapter 12"), (X.chapter_title, "IV", "Chapter 4"), (X.chapter_title, " The End ", "The End"),
    (X.expand_abbreviations, "Dr. No e.g. St. Paul", "Doctor No for example Saint Paul"),
    (X.normalize_caps, "CENTRAL LONDON HATCHERY", "Central London Hatchery"), (X.normalize_caps, "the BBC and NASA said", "the BBC and NASA said"),
    (X.normalize_caps, "THE HOUSE OF CARDS fell", "the House of Cards fell"), (X.normalize_caps, "a SHORT one, an ODD one", "a Short one, an ODD one"),
    (X.strip_footnotes, "word[12] and [note 3]", "word and "), (X.norm_punct, "“It’s” a—b…", '"It\'s" a — b...'),
    (X.norm_whitespace, "a\r\nb  c\n\n\nd ", "a b c\n\nd"), (X.slugify, "  Héllo, World!  ", "h-llo-world"), (X.slugify, "!!!", "book"),
    (X.safe_filename, 'A: "B"/C?', "A BC"), (X.escape_marker, "a=b;c#d\\e\nf", "a\\=b\\;c\\#d\\\\e\\\nf"), (X.safe_voice_name, "--é!", "--"),
    (N.expand_numbers, "2nd July", "second of July"), (N.expand_numbers, "July 2nd", "July the second"),
    (N.expand_numbers, "July 2, 2000", "July the second, two thousand"), (N.expand_numbers, "at 6.05am", "at six oh five a.m."),
    (N.expand_numbers, "at 6.30 pm", "at six thirty p.m."), (N.expand_numbers, "the 24th", "the twenty-fourth"), (N.expand_numbers, "9.6", "nine point six"),
    (N.expand_numbers, "born in 1992", "born in nineteen ninety-two"), (N.expand_numbers, "a crew of 1400", "a crew of one thousand four hundred"),
    (N.expand_numbers, "1500 roubles", "one thousand five hundred roubles"), (N.expand_numbers, "007 and 12345", "zero zero seven and one two three four five"),
    (N.expand_numbers, "1989-1990", "nineteen eighty-nine to nineteen ninety"), (N.expand_numbers, "in 2005", "in two thousand and five"), (N.expand_numbers, "in 1905", "in nineteen oh-five"),
    (N.expand_numbers, "no digits", "no digits"), (N.expand_numbers, "", ""),
    (lambda c: L.apply_lexicon(c, {"Kizhi": "Kee-zhee", "": "x", "no": ""}), "KIZHI, kizhis no", "Kee-zhee, kizhis no"),
    (M.block_text, "<span>A</span>bout <b>x</b>&amp;lt;", "About x&lt;"), (M.block_text, "<span>A</span> SQUAT", "A SQUAT"),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_worked_example(spark, k):
    f, given, expected = CASES[k]
    df = spark.createDataFrame([(given,), (None,)], "t string")
    got = [r[0] for r in df.select(f(F.col("t"))).collect()]
    assert got[0] == expected


def test_null_stays_null_or_default(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(X.norm_punct(F.col("t"))).first()[0] is None
    assert df.select(X.slugify(F.col("t"))).first()[0] == "book"


def test_sentences_and_chunks(spark):
    df = spark.createDataFrame([(1, '"Where?" she asked. Then he left! "Yes." And so.\n\nNext, one.'), (2, ""), (3, None), (4, "x, " * 300)], "doc_id long, text string")
    found = [r.sentence for r in S.sentences(df.where("doc_id = 1")).orderBy("pos").collect()]
    assert found == ['"Where?" she asked.', "Then he left!", '"Yes."', "And so.", "Next, one."]
    chunks = S.chunks(df).orderBy("doc_id", "chunk_index").collect()
    assert [r.kind for r in chunks if r.doc_id == 1] == ["paragraph", "paragraph"] and not [r for r in chunks if r.doc_id in (2, 3)]
    long = [r for r in chunks if r.doc_id == 4]
    assert len(long) > 1 and all(r.n_chars <= 450 for r in long) and [r.kind for r in long[:-1]] == ["clause"] * (len(long) - 1)
    strict = S.chunks(spark.createDataFrame([(1, "Short one. " + "Y, " * 300)], "doc_id long, text string"), strict=True).collect()
    assert all(r.n_chars <= 450 for r in strict)


def test_leaf_blocks_of_nested_markup(spark):
    html = "<blockquote>outer <p>inner</p> lost</blockquote><blockquote>kept</blockquote><ul><li>one<li>two</ul><p>open<p>next<script>var t='</p>'</script>"
    got = M.texts(M.leaf_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))).orderBy("pos").collect()
    assert [(r.tag, r.text) for r in got] == [("p", "inner"), ("blockquote", "kept"), ("li", "one"), ("li", "two"), ("p", "open"), ("p", "next")]


def test_anchors_and_sections(spark):
    html = '<p id="a">A</p><p>b</p><h2><a name="c"></a>C</h2><p>d</p>'
    blocks = M.texts(M.leaf_blocks(spark.createDataFrame([(1, html)], "page_id long, html string")))
    toc = spark.createDataFrame([(1, 0, "a", "First"), (1, 1, "c", "Second"), (1, 2, "gone", "None")], "page_id long, seq int, fragment string, title string")
    out = M.asof_sections(blocks, M.anchors(blocks, toc)).orderBy("pos").collect()
    assert [(r.text, r.title) for r in out] == [("A", "First"), ("b", "First"), ("C", "Second"), ("d", "Second")]


def test_lexicon_join_equals_literal(spark):
    df = spark.createDataFrame([(1, "The cat, THE dog’s and more"), (2, "")], "doc_id long, text string")
    entries = {"the": "thuh", "dog": "dawg"}
    dim = L.lexicon_dim(spark.createDataFrame(list(entries.items()), "word string, say_as string"))
    a = {r.doc_id: r.said for r in L.lexicon_join(df, dim).collect()}
    b = {r.doc_id: r.said for r in df.select("doc_id", L.apply_lexicon(F.col("text"), entries).alias("said")).collect()}
    assert a == b


def test_narration_plan_takes_another_estimate(spark):
    from lectern.operators import pace

    chunks = spark.createDataFrame([(0, "one two three", "clause"), (1, "four", "paragraph"), (2, " ", "sentence")], "chunk_index int, text string, kind string")
    syllables = lambda words, wpm: words * 3 / wpm * 10
    for estimate, speech in ((pace.words_seconds, [1800, 600, 0]), (syllables, [900, 300, 0])):
        plan = pace.narration_plan(chunks, F.lit(100.0), F.lit(1.0), estimate=estimate).orderBy("chunk_index").collect()
        assert [r.speech_ms for r in plan] == speech and [r.gap_ms for r in plan] == [250, 1900, 0]


def test_times_in_either_case(spark):
    from lectern.functions import numbers

    texts = ["at 3 PM.", "7:05 a.m. sharp", "10.30 P.M", "12aM", "3 am3"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.s for r in df.select("k", numbers.speak_times(F.col("t")).alias("s")).orderBy("k").collect()]
    assert got == ["at three p.m..", "seven oh five a.m.. sharp", "ten thirty p.m.", "twelve a.m.", "3 am3"]
