"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from lectern import catalog, plans  # noqa: F401

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    expected = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in expected.fetchall()), key=repr)


def test_turns_with_abbreviations_and_digits_keep_to_their_sql(spark, tmp_path):
    turns = [(1, 0, "a", "St. Ann met  Dr. Who IN THE 3 HALLS\nof ROME."), (1, 1, "b", None), (2, 0, "a", "Mr. X[3] paid 12 pounds\u2026"), (2, 1, "b", "")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    asked = catalog.QUERIES["clean_text"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in asked.collect()) == sorted(c.sql(catalog.ORACLES["clean_text"]).fetchall())
    whole = {r.id: r.clean for r in catalog.QUERIES["clean_turns"](spark, str(tmp_path)).collect()}
    assert whole == {1000: "Saint Ann met Doctor Who in the three Halls of ROME.", 1001: None, 2000: "Mister X paid twelve pounds...", 2001: ""}


def test_gains_do_not_depend_on_the_order_of_clips(spark):
    import random

    from lectern.operators import signal as G

    draw = random.Random(5)
    clips = [(draw.choice("ab"), [draw.gauss(0, 1) * 10.0 ** draw.randint(-6, 6) for _ in range(9)]) for _ in range(500)] + [("c", [0.0]), ("d", [math.nan]), ("e", [])]
    seen = set()
    for k in range(4):
        draw.shuffle(clips)
        rows = spark.createDataFrame(spark.sparkContext.parallelize(clips, 1 + 3 * k), "book string, samples array<double>")
        seen.add(tuple(sorted((r.book, repr(r.gain)) for r in G.normalized(rows, "book", "samples", 0.1, 0.3).select("book", "gain").distinct().collect())))
    energy = {b: math.fsum(sum(v * v for v in s) for x, s in clips if x == b) for b in "ab"}
    count = {b: sum(len(s) for x, s in clips if x == b) for b in "ab"}
    assert len(seen) == 1
    gains = dict(seen.pop())
    assert gains["c"] == gains["e"] == "1.0" and gains["d"] == "nan"
    assert all(math.isclose(float(gains[b]), 0.1 / math.sqrt(energy[b] / count[b]), rel_tol=1e-15) for b in "ab")


CLEANED = {
    "Mr. X[3] paid 12 pounds…": "Mister X paid twelve pounds...",
    "the 2nd Sept, 12345.06 and 2½ of “THE OLD MILL” at 6.05pm.": 'thuh second of Sept, twelve thousand three hundred annd forty-five point zero six annd 2½ of "thuh Old Mill" at six oh five p.m.',
    "In 1905–1910, a crew of 1400;\r\nborn in the summer of  1992": "In nineteen oh-five to nineteen ten, a crew of one thousand four hundred; born in thuh summer of nineteen ninety-two",
    "July 2, 2000 [ Note 12 ]\n\n \nMarch 3 th 21st May 4th agent 007 no. 12345  ": "July thuh second, two thousand\n\nMarch three th twenty-first of May thuh fourth agent zero zero seven no. one two three four five",
    "1000000.5 12005.1 1002100.25 000.7 é12 12é 12² _7": "one million point five twelve thousand annd five point one one million two thousand one hundred point two five zero point seven é12 12é 12² _7",
    "e.g. St. Ann’s BBC, THE  REST\tof ROMEO": "for example Saint Ann's BBC, thuh Rest of Romeo",
    "6 pm 12:30 A.M. 13:00am 7 p.m.x May 5": "six p.m. twelve thirty a.m. thirteen a.m. seven p.m.x May thuh fifth",
    " \n\n": "", "": "", "ZU Der, und QUE une": "tsu dair, und kay oon", None: None,
}


def test_clean_text_takes_all_its_steps_as_its_sql_does(spark, tmp_path):
    from lectern.functions import numbers

    texts = [*CLEANED, "9" * 310 + ".5", "7" * 306 + ".5", "12345678901234567890.1", "iné 1992 éin 1992 in" + " " * 22 + "1992 in" + " " * 23 + "1992", "x\x0b　"]
    spark.createDataFrame([(0, k, t) for k, t in enumerate(texts)], "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = dict(tuple(r) for r in catalog.QUERIES["clean_text"](spark, str(tmp_path)).select("id", "clean").collect())
    assert [got[k] for k in range(len(CLEANED))] == list(CLEANED.values())
    assert got == dict(c.sql(f"SELECT id, clean FROM ({catalog.ORACLES['clean_text']})").fetchall())
    assert got[len(CLEANED)].startswith("nine nine nine ") and got[len(CLEANED) + 1].startswith("seven hundred annd seventy-seven centillion ") and len(numbers.SCALES) == 101


def test_sums_in_order_have_the_bits_of_one_addition_after_the_other(spark):
    import random
    from functools import reduce

    from lectern.operators import signal as G

    draw = random.Random(9)
    groups = {
        "any": [draw.random() for _ in range(700)],
        "wide": [draw.random() * 10.0 ** draw.randint(-20, 9) for _ in range(700)],
        "growing": [1.7 ** (k / 3) for k in range(700)],
        "halves": [3 * 2.0**52] + [draw.choice([0.0, 1.0, 2.0, 3.0, 5.0]) for _ in range(700)],  # ties, settled by the last bit
        "ones": [1.0] * 700,  # comes to powers of two exactly
        "loud first": [1.0] + [2.0**-53] * 300 + [2.0**-52] * 3 + [1e-16] * 300,
        "silent first": [0.0] * 300 + [5e-324, 1e-300, 0.1, 0.2, 0.3],
        "silent": [0.0] * 30, "single": [0.1], "huge": [1e308] * 5 + [0.1] * 30, "nan": [0.1] * 20 + [math.nan] + [0.1] * 20,
    }
    rows = [(g, 3 * k - 50, v) for g, vs in groups.items() for k, v in enumerate(vs)] + [("any", 5_000, None), (None, 1, 0.1), (None, 2, 0.7)]
    expected = {g: reduce(lambda a, v: a + v, vs, 0.0).hex() for g, vs in (groups | {None: [0.1, 0.7]}).items()}
    for size in (8, 4096):
        draw.shuffle(rows)
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), "g string, k long, v double")
        assert {r.g: r.v.hex() for r in G.sum_in_order(df, "g", "k", "v", size=size).collect()} == expected
    assert math.fsum(groups["any"]).hex() != expected["any"]


def test_normalized_levels_have_the_bits_of_their_sql(spark, tmp_path):
    import random

    draw = random.Random(2)
    clips = [(k, [draw.gauss(0, 0.3) for _ in range(16)], k % 3) for k in range(900)]
    odd = [([0.1, None], 1), ([None], 4), ([0.0, 0.0], 5), ([], 6), (None, 7), ([0.5], None), ([], 2), (None, 2)]
    spark.createDataFrame(clips + [(900 + k, *x) for k, x in enumerate(odd)], "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    bits = lambda rows: sorted((r[0], r[1] and [v.hex() for v in r[1]]) for r in rows)
    for d, files in ((SF, ""), (str(tmp_path), "/*.parquet")):
        c = duckdb.connect(config={"threads": 1})
        c.sql(f"CREATE TABLE embeddings AS SELECT * FROM '{d}/embeddings.parquet{files}' ORDER BY vec_id")
        assert bits(catalog.QUERIES["normalize_levels"](spark, d).select("vec_id", "samples").collect()) == bits(c.sql(f"SELECT vec_id, samples FROM ({catalog.ORACLES['normalize_levels']})").fetchall())


def test_toc_flatten_holds_no_host_in_one_row(spark):
    plan = catalog.QUERIES["toc_flatten"](spark, SF)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Generate" not in plan


def test_anchor_positions_take_pages_apart_once(spark):
    plan = catalog.QUERIES["anchor_positions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in x and "html:string" in x for x in plan.split("\n")) == 1


def test_flatten_toc_goes_depth_first(spark):
    from lectern.operators import markup

    node = "struct<href string, title string, children array<struct<href string, title string>>>".replace(" string", ":string").replace(" array", ":array")
    toc = spark.createDataFrame([("b", [("x#1", "X", [("y", "Y")]), (None, None, [("z#2", "Z")])])], f"book_id string, toc array<{node}>")
    assert [tuple(r) for r in markup.flatten_toc(toc, 2).orderBy("seq").collect()] == [("b", 0, "x", "1", "X"), ("b", 1, "y", "", "Y"), ("b", 2, "z", "2", "Z")]


def test_anchors_prefer_ids_and_take_names_of_links_only(spark):
    from lectern.operators import markup

    html = '<h1 data-id="a" id=b>one</h1><p><a name="a">two</a></p><p><span id="a">three</span></p><p><img name="c">four</p><p><a class="x" name=\'d\' id="e">five</a></p>'
    blocks = markup.leaf_blocks(spark.createDataFrame([(1, html)], "page_id long, html string"))
    toc = spark.createDataFrame([(1, f, k, f.upper()) for k, f in enumerate("abcde")], "page_id long, fragment string, seq int, title string")
    assert {(r.title, r.pos) for r in markup.anchors(blocks, toc).collect()} == {("A", 2), ("B", 0), ("D", 4), ("E", 4)}


def test_places_in_groups_cross_ranges(spark):
    from lectern.operators import ranks

    ids = [5, 99_999, 100_000, 100_001, 350_000, 900_000, 900_001, 1_000_000, 1_000_001, 1_000_002]
    rows = spark.createDataFrame([("a", i) for i in ids] + [(None, i) for i in ids[:3]], "g string, i long")
    assert sorted(((r.g or "", r.i, r.n) for r in ranks.numbered(rows, "g", "i", "n").collect())) == sorted([("a", i, k) for k, i in enumerate(ids)] + [("", i, k) for k, i in enumerate(ids[:3])])
    assert {(r.g, r.i, r.n) for r in ranks.first_or_last(rows, "g", "i", "n", 7).collect()} == {("a", 1_000_000, 7), (None, 100_000, 2)}


def test_text_queries_shuffle_no_texts(spark):
    for name in ("page_text", "preview_sample", "lexicon_join"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        # A subquery's own plan is indented by a colon; it holds the lexicon, not texts.
        assert not [x for x in plan.split("\n") if "Exchange" in x and not x.lstrip().startswith(":")]


PHRASED = {" York's": "of york", "New York": "noo yawk", "York": "yawk", "york minster": "YM", "O'Brien": "oh bryan", "O'Brien's": "oh bryanz", "'tis": "it is", "Mr.X": "mister x", "a b c": "abc", "b c d": "bcd", "c": "see", "a": "ay", "Straße nach": "road to", "x-y": "ex why", "Ωmega": "om", "2 b": "two bee"}
SPOKEN = [
    "New York Minster, new  york; NEW YORK york minster", "O'Brien's O'Brien o'brienx O'BRIENS", "rock'tis 'tis x'tis y", "Mr.X Mr. X mr.xy", "a b c d a b b c d a b c", "die STRASSE nach, Straße Nach Rom", "x-y x - y x-yz",
    "ωmega Ωmegas", "2 b or not 2 bee 2 b", "", " ", "York", "x York's yard", "a\nb c", "New York" * 3, "New York " * 3000, "é́a c",
]


@pytest.mark.parametrize("limit", [1 << 30, 1500, 0])
def test_phrases_in_any_lexicon_are_respelt_as_by_the_pattern(spark, limit):
    from pyspark.sql import functions as F

    from lectern.operators import lexicon as L

    texts = spark.createDataFrame([(k % 7, t) for k, t in enumerate([*SPOKEN, None])], "doc_id int, text string")
    more = {f"never {k}": "x" for k in range(50)} if limit == 1500 else {}
    dim = L.lexicon_dim(spark.createDataFrame(list((PHRASED | more).items()), "word string, say_as string"))
    expected = texts.select("text", L.apply_lexicon(F.col("text"), PHRASED).alias("said"))
    said = lambda df: sorted((r.said is None, r.said or "") for r in df.collect())
    if limit:
        assert said(L.lexicon_join(texts, dim, limit=limit)) == said(expected)
    else:  # by runs, which needs ids that tell texts apart
        one = texts.withColumn("doc_id", F.monotonically_increasing_id())
        assert said(L.lexicon_join(one, dim, limit=limit)) == said(expected)
    assert said(L.lexicon_join(texts, dim.limit(0), limit=limit)) == said(texts.select(F.col("text").alias("said")))


def test_a_lexicon_of_many_entries(spark):
    from pyspark.sql import functions as F

    from lectern.operators import lexicon as L

    ids = spark.range(1_000_000)
    dim = ids.select(F.concat(F.lit("name"), F.col("id").cast("string"), F.when(F.col("id") % 10 == 0, " of old").otherwise("")).alias("key"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("say_as"))
    texts = spark.createDataFrame([(1, "Name7 of old, name20 of old and name20 of, name999999"), (2, "nobody")], "doc_id int, text string")
    out = L.lexicon_join(texts, dim)
    assert {r.doc_id: r.said for r in out.collect()} == {1: "n7 of old, n20 and name20 of, n999999", 2: "nobody"}


PAGES = {
    "<body>a<table><tr><td>x<table><tr><td>y</td></tr></table>LEAK</td></tr></table>b</body>": ([], "ab"),
    "<body><p>one<p>two<ul><li>a<li>b</ul>": (["one", "two", "a", "b"], "one\n\ntwo\n\na\n\nb"),
    "<body><ul><li>out<ol><li>in</li></ol>lost</li><li>last</ul>": (["in", "last"], "in\n\nlast"),
    "<body><p>x<sup>1<sup>2</sup>3</sup>y<sup>4<p>z</table></p>": (["xy", "z"], "xy\n\nz"),
    "<body><nav>never closed<p>gone</p>": ([], None),
    "<body><figure/><p>kept</p><script>var t = '<table>';</script><p>too</p>": (["kept", "too"], "kept\n\ntoo"),
    "<body><blockquote><div>said</div></blockquote><h1><div>Box</div></h1><li>loose</li>": (["said", "Box", "loose"], "said\n\nBox\n\nloose"),
    "": ([], None),
}


def test_nested_and_unclosed_markup(spark):
    from lectern.operators import markup

    pages = spark.createDataFrame([(k, h) for k, h in enumerate([*PAGES, None])], "page_id int, html string")
    blocks = {}
    for r in markup.texts(markup.leaf_blocks(pages)).orderBy("page_id", "pos").collect():
        blocks.setdefault(r.page_id, []).append(r.text)
    whole = {r.page_id: r.text for r in markup.page_text(pages).collect()}
    for k, (expected, text) in enumerate([*PAGES.values(), ([], None)]):
        assert blocks.get(k, []) == expected and whole[k] == text, k


def test_deep_nesting_and_running_depth(spark):
    import random

    from pyspark.sql import functions as F

    from lectern.operators import markup

    rng = random.Random(6)
    arrays = [[rng.choice([-3, -1, 0, 1, 2, -(1 << 40)]) for _ in range(n)] for n in (0, 1, 2, 3, 10, 1000)]
    df = spark.createDataFrame([(k, a) for k, a in enumerate(arrays)], "k int, a array<bigint>").withColumn("d", markup.running_depth(F.col("a")))
    for r in df.collect():
        depth, out = 0, []
        for x in arrays[r.k]:
            depth = max(0, depth + x)
            out.append(depth)
        assert r.d == out
    html = "<body>" + "<table><td>" * 3000 + "x" + "</table>" * 3000 + "<p>left</p>"
    assert markup.page_text(spark.createDataFrame([(1, html)], "page_id int, html string")).first().text == "left"


def test_anchors_in_blocks_that_hold_blocks_are_at_these(spark):
    from pyspark.sql import functions as F

    from lectern.operators import markup

    html = ("<body><p>zero</p><ul><li><p>one</p><a id=a></a><p>two</p><span><b id=b></b></span></li><li><p>three</p><a id=c></a></ul>"
            "<div id=d><p>four</p></div><blockquote><p>five</p><p>six</p><a name=e></a></blockquote><li id=f><p>seven</p></li><h2>eight <i><u id=g>u</u></i></h2>")  # fmt: skip
    page = spark.createDataFrame([(1, html)], "page_id int, html string").withColumn("p", markup.structure(F.col("html"))).select("page_id", "p.*")
    toc = spark.createDataFrame([(1, f, k, f) for k, f in enumerate("abcdefg")], "page_id int, fragment string, seq int, title string")
    blocks = sorted((r.pos, r.text) for r in page.select(F.inline("blocks")).collect())
    after = {r.title: [t for p, t in blocks if p >= r.pos][:1] for r in markup.anchor_positions(page, toc).collect()}
    assert after == {"a": ["one"], "b": ["three"], "c": ["three"], "d": ["four"], "e": ["five"], "f": ["seven"], "g": []}


def test_contents_of_any_depth(spark):
    from lectern.operators import markup

    rows = [("b", f"{k}", f"{k - 1}" if k else None, 0, f"f{k}#x" if k % 3 else "", f"T{k}") for k in range(9)]
    rows += [("b", "side", "3", 1, "s", "S"), ("b", "lost", "nowhere", 7, "l", "L"), ("c", "0", None, 0, None, "none"), ("c", "1", "0", 0, "only", "O")]
    out = markup.flatten_nodes(spark.createDataFrame(rows, "book_id string, node string, parent string, place int, href string, title string"))
    assert sorted(tuple(r) for r in out.collect()) == [
        ("b", 0, "f1", "x", "T1"), ("b", 1, "f2", "x", "T2"), ("b", 2, "f4", "x", "T4"), ("b", 3, "f5", "x", "T5"), ("b", 4, "f7", "x", "T7"), ("b", 5, "f8", "x", "T8"),
        ("b", 6, "s", "", "S"), ("b", 7, "l", "", "L"), ("c", 0, "only", "", "O"),
    ]
    kind = "struct<href:string,title:string>"
    for _ in range(5):
        kind = f"struct<href:string,title:string,children:array<{kind}>>"
    node = None
    for k in range(5, -1, -1):
        node = (f"h{k}", f"T{k}") if node is None else (f"h{k}", f"T{k}", [node])
    deep = markup.flatten_toc(spark.createDataFrame([("d", [node])], f"book_id string, toc array<{kind}>"))
    assert [(r.seq, r.href) for r in deep.orderBy("seq").collect()] == [(k, f"h{k}") for k in range(6)]


def test_places_with_hashed_ids_are_dealt_evenly(spark):
    from pyspark.sql import functions as F

    from lectern.operators import ranks

    ids = spark.range(40_000).select(F.when(F.col("id") < 30_000, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 3000).cast("string"))).alias("g"), F.xxhash64("id").alias("i"))
    ids = ids.unionByName(spark.createDataFrame([(None, 3), (None, None)], "g string, i long"))
    out = ranks.numbered(ids, "g", "i", "n").collect()
    by = {}
    for r in out:
        by.setdefault(r.g, []).append((r.i is not None, r.i or 0, r.n))
    assert all([n for _, _, n in sorted(rows)] == list(range(len(rows))) for rows in by.values()) and len(out) == 40_002
    dealt = ids.repartitionByRange("g", "i").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in dealt) < 2 * 40_000 / len(dealt)
    last = ranks.first_or_last(ids, "g", "i", "n", 7)
    assert {(r.g, r.i, r.n) for r in last.collect()} == {(g, rows[min(7, len(rows) - 1)][1] if rows[min(7, len(rows) - 1)][0] else None, min(7, len(rows) - 1)) for g, rows in ((g, sorted(x)) for g, x in by.items())}


def test_book_chapters_reads_pages_once_for_texts_and_once_for_numbers(spark):
    from lectern.operators import markup
    from lectern.plans import markup as plans_

    pages = plans_.marked_pages(spark, SF)
    toc = spark.createDataFrame([r.asDict() for r in plans_.marked_toc(spark, SF).collect()], plans_.marked_toc(spark, SF).schema)
    plan = markup.book_chapters(pages, toc)._jdf.queryExecution().executedPlan().toString()
    # The numbers were found by another scan, whose narrow rows are written; here they are read.
    assert len([x for x in plan.split("\n") if "FileScan" in x and "html" in x]) == 1 and "SortMergeJoin" not in plan
    exchanges = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert not [x for x in exchanges if "html" in x or "text" in x]


def test_recordings_in_blocks_are_as_whole_ones(spark):
    import random

    from pyspark.sql import functions as F

    from lectern.operators import signal

    rng = random.Random(8)
    clips = {k: [rng.choice([0.0, 0.0, 0.0, 0.5, -0.7, 0.02]) for _ in range(n)] for k, n in enumerate([1, 2, 5, 24, 25, 400, 401])} | {100: [0.0] * 60, 101: [0.9] * 60, 102: [0.0] * 30 + [1.0] + [0.0] * 300 + [1.0]}
    df = spark.createDataFrame(list(clips.items()), "k int, samples array<double>")
    long = signal.samples_long(df, "k", "samples")
    for size, fan in ((4, 2), (5, 3), (64, 256)):
        blocks = signal.in_blocks(long, "k", size)
        got = {tuple(r) for r in signal.silence_runs_in_blocks(blocks, "k", size, least=2, fan=fan).collect()}
        assert got == {tuple(r) for r in signal.silence_runs(long, "k", least=2).collect()}
        out = {(r.k, r.buckets): [] for r in df.selectExpr("k", "explode(array(1, 3, 10)) as buckets").collect()}
        for r in signal.envelopes_in_blocks(blocks, "k", size, [1, 3, 10]).orderBy("bucket").collect():
            out[r.k, r.buckets].append(r.peak)
        for b in (1, 3, 10):
            assert {r.k: r.p for r in df.select("k", signal.waveform_peaks(F.col("samples"), b).alias("p")).collect()} == {k: p for (k, n), p in out.items() if n == b}
    levels = lambda rows: {r.k: [x if x is None else round(x, 9) for x in r[1:]] for r in rows.collect()}
    assert levels(signal.levels_in_blocks(signal.in_blocks(long, "k", 8), "k", 8, 4)) == levels(signal.clip_levels(long, "k", 4))
    assert signal.silence_runs_in_blocks(signal.in_blocks(long.limit(0), "k", 4), "k", 4).count() == 0
