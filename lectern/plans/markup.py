"""Registered queries: scans and structure extraction (groups A and B)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions.text import let
from ..operators import markup as M
from ..operators.ranks import first_or_last, numbered
from ..sources.shared import settled
from ..sources.tables import table

_CLEAN = r"regexp_replace(regexp_replace({c}, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<sup\b[^>]*>.*?</sup\s*>|<table\b[^>]*>.*?</table\s*>|<figure\b[^>]*>.*?</figure\s*>|<nav\b[^>]*>.*?</nav\s*>', '', 'g')"
_BR = "regexp_replace(" + _CLEAN + r", '(?i)<br\b[^>]*>', ' ', 'g')"
_TEXT = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({c}, '<[^>]*>', '', 'g'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[\s\x{{00A0}}]+', ' ', 'g'))".replace('\\"', '"')
#: Pieces between block borders; a piece is a leaf block if it starts with a block's opening tag.
_BLOCKS = (
    "pieces AS (SELECT page_id, unnest(string_split(regexp_replace(" + _BR.format(c="html") + r", '(?i)(</?(?:p|h[1-6]|blockquote|li|article|div|footer|body|ul)\b)', chr(1)||'\1', 'g'), chr(1))) AS piece, generate_subscripts(string_split(regexp_replace(" + _BR.format(c="html") + r", '(?i)(</?(?:p|h[1-6]|blockquote|li|article|div|footer|body|ul)\b)', chr(1)||'\1', 'g'), chr(1)), 1) AS k FROM pages),"
    r" blocks AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, lower(regexp_extract(piece, '(?i)^<(\w+)', 1)) AS tag, regexp_extract(piece, '(?s)^<[^>]*>(.*)$', 1) AS inner_html FROM pieces WHERE regexp_matches(piece, '(?i)^<(p|h[1-6]|blockquote|li)\b')),"
    " texts AS (SELECT page_id, pos, tag, " + _TEXT.format(c="inner_html") + " AS text FROM blocks)"
)


def pages(spark, d):
    return table(spark, d, "pages")


def blocks(spark, d):
    return M.leaf_blocks(pages(spark, d).select("page_id", "html"))


@register("scan_chapters", "SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chapter_index, doc_id, length(text) AS n_chars FROM documents")
def scan_chapters(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("book"), "doc_id", F.length("text").alias("n_chars"))
    return numbered(settled(rows, "chapters"), "book", "doc_id", "chapter_index").select("book", "chapter_index", "doc_id", "n_chars")


@register("spine_documents", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT DISTINCT page_id FROM pages)")
def spine_documents(spark, d):
    there = pages(spark, d).select(F.col("page_id").alias("doc_id")).distinct()
    return table(spark, d, "documents").select("doc_id", "source").join(there, "doc_id", "left_semi")


@register("metadata_defaults", r"SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), ''), regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1)) AS title, coalesce(nullif(regexp_extract(html, '(?i)<meta\s+name=\"author\"\s+content=\"([^\"]*)\"', 1), ''), 'Unknown') AS author, coalesce(nullif(regexp_extract(html, '(?i)<html[^>]*\blang=\"([^\"]*)\"', 1), ''), 'en') AS language FROM pages")
def metadata_defaults(spark, d):
    first = lambda p, default: F.coalesce(F.nullif(F.trim(F.regexp_extract("html", p, 1)), F.lit("")), default)
    stem = F.regexp_extract("url", r"([^/]+?)(\.[^./]*)?$", 1)
    return pages(spark, d).select("page_id", first(r"(?is)<title>(.*?)</title>", stem).alias("title"), first(r'(?i)<meta\s+name="author"\s+content="([^"]*)"', F.lit("Unknown")).alias("author"), first(r'(?i)<html[^>]*\blang="([^"]*)"', F.lit("en")).alias("language"))


@register("pick_cover", "SELECT split_part(url, '/', 3) AS host, arg_min(url, page_id) AS cover FROM pages WHERE lower(url) LIKE '%/en/%' OR lower(url) LIKE '%th%' GROUP BY 1")
def pick_cover(spark, d):
    named = F.lower("url").contains("/en/") | F.lower("url").contains("th")
    return pages(spark, d).where(named).groupBy(F.get(F.split("url", "/"), F.lit(2)).alias("host")).agg(F.min_by("url", "page_id").alias("cover"))


@register("cover_choice", "SELECT p_partkey, coalesce(CASE WHEN p_size % 4 = 0 THEN 'custom-'||p_partkey END, CASE WHEN p_size % 2 = 0 THEN 'own-'||p_partkey END) AS cover, CASE WHEN (CASE WHEN p_size % 3 = 0 THEN 'image/png' ELSE 'image/jpeg' END) LIKE '%png' THEN '.png' ELSE '.jpg' END AS ext FROM part")
def cover_choice(spark, d):
    custom, own = (F.when(F.col("p_size") % n == 0, F.concat(F.lit(f"{name}-"), F.col("p_partkey").cast("string"))) for n, name in ((4, "custom"), (2, "own")))
    media = F.when(F.col("p_size") % 3 == 0, "image/png").otherwise("image/jpeg")
    return table(spark, d, "part").select("p_partkey", F.coalesce(custom, own).alias("cover"), F.when(media.endswith("png"), ".png").otherwise(".jpg").alias("ext"))


@register("html_clean", "SELECT page_id, " + _BR.format(c="html") + " AS clean FROM pages")
def html_clean(spark, d):
    return pages(spark, d).select("page_id", M.clean_html(F.col("html")).alias("clean"))


@register("leaf_blocks", f"WITH {_BLOCKS} SELECT page_id, pos, tag, inner_html FROM blocks")
def leaf_blocks(spark, d):
    return blocks(spark, d).select("page_id", "pos", "tag", F.col("inner").alias("inner_html"))


@register("block_text", f"WITH {_BLOCKS} SELECT page_id, pos, text FROM texts WHERE text <> ''")
def block_text(spark, d):
    return M.texts(blocks(spark, d)).select("page_id", "pos", "text")


@register("page_text", f"WITH {_BLOCKS} SELECT p.page_id, coalesce(t, nullif({_TEXT.format(c=_BR.format(c='html'))}, '')) AS text FROM pages p LEFT JOIN (SELECT page_id, string_agg(text, chr(10)||chr(10) ORDER BY pos) AS t FROM texts WHERE text <> '' GROUP BY 1) x ON x.page_id = p.page_id")
def page_text(spark, d):
    return M.page_text(pages(spark, d))


_TOC = "SELECT split_part(url, '/', 3) AS book_id, page_id, url||CASE WHEN page_id % 3 = 0 THEN '' ELSE '#s'||page_id % 5 END AS full_href, 'T'||page_id AS title FROM pages"


def toc(spark, d):
    href = F.concat("url", F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("#s"), (F.col("page_id") % 5).cast("string"))))
    return pages(spark, d).select(F.get(F.split("url", "/"), F.lit(2)).alias("book_id"), "page_id", href.alias("full_href"), F.concat(F.lit("T"), F.col("page_id").cast("string")).alias("title"))


@register(
    "toc_flatten",
    # A page stands under the page whose number lacks its last binary one, if that is in the book; every seventh has no href.
    rf"""WITH RECURSIVE t AS ({_TOC}),
    n AS (SELECT c.*, p.page_id AS parent FROM t c LEFT JOIN t p ON p.book_id = c.book_id AND p.page_id = (c.page_id & (c.page_id - 1)) AND c.page_id > 0),
    w AS (SELECT book_id, page_id, [page_id] AS path FROM n WHERE parent IS NULL
        UNION ALL SELECT n.book_id, n.page_id, list_append(w.path, n.page_id) FROM n JOIN w ON w.book_id = n.book_id AND w.page_id = n.parent)
    SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY path) - 1 AS seq, split_part(full_href, '#', 1) AS href,
        CASE WHEN strpos(full_href, '#') > 0 THEN substr(full_href, strpos(full_href, '#') + 1) ELSE '' END AS fragment, title
    FROM w JOIN t USING (book_id, page_id) WHERE page_id % 7 <> 0""",
)
def toc_flatten(spark, d):
    parent = F.when(F.col("page_id") > 0, F.col("page_id").bitwiseAND(F.col("page_id") - 1))
    href = F.when(F.col("page_id") % 7 != 0, F.col("full_href"))
    return M.flatten_nodes(toc(spark, d).select("book_id", F.col("page_id").alias("node"), parent.alias("parent"), F.col("page_id").alias("place"), href.alias("href"), "title"))


# Up to three places inside each page, and the page itself but for every fifth.
_PLACES = """SELECT url||CASE WHEN k = 0 THEN '' ELSE '#s'||k END AS full_href, page_id * 10 + k AS seq, 'T'||page_id||'.'||k AS title
    FROM (SELECT url, page_id, unnest(range(0, page_id % 4 + 1)) AS k FROM pages) WHERE k > 0 OR page_id % 5 <> 0"""


@register(
    "toc_group",
    f"""SELECT href, coalesce(list(fragment ORDER BY seq) FILTER (fragment <> ''), []) AS fragments, arg_min(title, seq) FILTER (fragment = '') AS title
    FROM (SELECT split_part(full_href, '#', 1) AS href, seq, title,
        CASE WHEN strpos(full_href, '#') > 0 THEN substr(full_href, strpos(full_href, '#') + 1) ELSE '' END AS fragment FROM ({_PLACES}))
    GROUP BY href""",
)
def toc_group(spark, d):
    rows = pages(spark, d).select("url", "page_id", F.explode(F.sequence(F.lit(0), (F.col("page_id") % 4).cast("int"))).alias("k")).where("k > 0 or page_id % 5 <> 0")
    href = F.concat("url", F.when(F.col("k") == 0, "").otherwise(F.concat(F.lit("#s"), F.col("k").cast("string"))))
    title = F.concat(F.lit("T"), F.col("page_id").cast("string"), F.lit("."), F.col("k").cast("string"))
    return M.grouped_toc(rows.select(*M.split_href(href), (F.col("page_id") * 10 + F.col("k")).alias("seq"), title.alias("title")))


# Every third block of a page is an anchor.
_ASOF = f"WITH {_BLOCKS}, b AS (SELECT * FROM texts WHERE text <> ''), m AS (SELECT page_id, pos, text AS title FROM b WHERE pos % 3 = 1)"


def sections(spark, d):
    found = M.texts(blocks(spark, d)).select("page_id", "pos", "text")
    marks = found.where("pos % 3 = 1").select("page_id", "pos", F.col("pos").alias("seq"), F.col("text").alias("title"))
    return found, marks, M.asof_sections(found, marks)


@register("asof_sections", f"{_ASOF} SELECT b.page_id, b.pos, b.text, m.pos AS seq, m.title FROM b ASOF LEFT JOIN m ON b.page_id = m.page_id AND b.pos >= m.pos")
def asof_sections(spark, d):
    return sections(spark, d)[2]


@register("multi_anchor_pages", f"{_ASOF} SELECT page_id, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 2")
def multi_anchor_pages(spark, d):
    return sections(spark, d)[1].groupBy("page_id").agg(F.count("*").alias("n")).where("n >= 2")


@register("assemble_sections", f"{_ASOF} SELECT page_id, seq, string_agg(text, chr(10)||chr(10) ORDER BY pos) AS text FROM (SELECT b.page_id, b.pos, b.text, m.pos AS seq FROM b ASOF LEFT JOIN m ON b.page_id = m.page_id AND b.pos >= m.pos) GROUP BY page_id, seq")
def assemble_sections(spark, d):
    return M.assembled(sections(spark, d)[2], "page_id", "seq")


@register("preamble_chapters", f"{_ASOF}, s AS (SELECT page_id, string_agg(text, chr(10)||chr(10) ORDER BY pos) AS text FROM (SELECT b.page_id, b.pos, b.text, m.pos AS seq FROM b ASOF LEFT JOIN m ON b.page_id = m.page_id AND b.pos >= m.pos) WHERE seq IS NULL GROUP BY page_id) SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'T'||page_id ELSE 'Introduction' END AS title, text FROM s WHERE length(text) >= 20")
def preamble_chapters(spark, d):
    head = M.assembled(sections(spark, d)[2].where("seq is null"), "page_id").where(F.length("text") >= 20)
    listed = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("T"), F.col("page_id").cast("string")))
    return head.select("page_id", F.coalesce(listed, F.lit("Introduction")).alias("title"), "text")


# Pages with anchors: directly in the heading, deep inside the first paragraph, and between two blocks. The table of contents
# lists all three for two pages of three, one that exists and one that does not for others, and some pages as a whole.
_MARKED = r"""marked AS (SELECT page_id, split_part(url, '/', 3) AS book, regexp_replace(regexp_replace(replace(html, '<h1>', '<h1><span id="s1"></span>'),
        '(?s)^(.*?)<p><b>', '\1<p><b><a class="x" id=''s2''></a>'), '(?s)^(.*?)</p><p>', '\1</p><a name="s3"></a><p>') AS html FROM pages),
    toc AS (SELECT page_id, 's'||k AS fragment, k AS seq, 'T'||page_id||'.'||k AS title FROM pages, range(1, 4) r(k) WHERE page_id % 3 <> 0
        UNION ALL SELECT page_id, CASE k WHEN 1 THEN 'nowhere' ELSE 's2' END, k, 'N'||page_id FROM pages, range(1, 3) r(k) WHERE page_id % 6 = 3
        UNION ALL SELECT page_id, '', 0, CASE WHEN page_id % 5 = 0 THEN 'Cover ' ELSE 'File ' END||page_id FROM pages WHERE page_id % 4 = 0)"""
_PIECES = r"""cut AS (SELECT page_id, string_split(regexp_replace({clean}, '(?i)(</?(?:p|h[1-6]|blockquote|li|article|div|footer|body|ul)\b)', chr(1)||'\1', 'g'), chr(1)) AS ps FROM marked),
    pieces AS (SELECT page_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS k FROM cut),
    blocks AS (SELECT page_id, k::DOUBLE AS place, {text} AS text FROM (SELECT *, regexp_extract(piece, '(?s)^<[^>]*>(.*)$', 1) AS inside FROM pieces WHERE regexp_matches(piece, '(?i)^<(p|h[1-6]|blockquote|li)\b')) WHERE {text} <> ''),
    named AS (SELECT page_id, k, unnest(regexp_extract_all(piece, '\s(?:id|name)=["''](s\d)', 1)) AS fragment FROM pieces),
    marks AS (SELECT page_id, seq, title, k + CASE fragment WHEN 's2' THEN 0.5 ELSE 0 END AS place FROM named JOIN toc USING (page_id, fragment))""".format(clean=_BR.format(c="html"), text=_TEXT.format(c="inside"))


def marked_pages(spark, d):
    first = lambda c, old, new: F.regexp_replace(c, f"(?s)^(.*?){old}", f"$1{new}")
    html = first(F.replace("html", F.lit("<h1>"), F.lit('<h1><span id="s1"></span>')), "<p><b>", "<p><b><a class=\"x\" id='s2'></a>")
    return pages(spark, d).select("page_id", F.get(F.split("url", "/"), F.lit(2)).alias("book"), first(html, "</p><p>", '</p><a name="s3"></a><p>').alias("html"))


def marked_toc(spark, d):
    p, name = pages(spark, d).select("page_id"), lambda start, *rest: F.concat(F.lit(start), *[x if x is not None else F.lit(".") for x in rest])
    text = lambda c: F.col(c).cast("string")
    three = p.where("page_id % 3 <> 0").select("page_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seq"))
    three = three.select("page_id", name("s", text("seq")).alias("fragment"), "seq", name("T", text("page_id"), None, text("seq")).alias("title"))
    one = p.where("page_id % 6 = 3").select("page_id", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("seq"))
    one = one.select("page_id", F.when(F.col("seq") == 1, "nowhere").otherwise("s2").alias("fragment"), "seq", name("N", text("page_id")).alias("title"))
    own = F.concat(F.when(F.col("page_id") % 5 == 0, "Cover ").otherwise("File "), text("page_id"))
    return three.unionByName(one).unionByName(p.where("page_id % 4 = 0").select("page_id", F.lit("").alias("fragment"), F.lit(0).alias("seq"), own.alias("title")))


@register("anchor_positions", f"WITH {_MARKED}, {_PIECES} SELECT m.page_id, m.seq, m.title, (SELECT count(*) FROM blocks b WHERE b.page_id = m.page_id AND b.place < m.place) AS blocks_before FROM marks m")
def anchor_positions(spark, d):
    # Blocks before a name are counted in the page's row, so that pages are taken apart once.
    before = lambda blocks, name: F.size(F.filter(blocks, lambda b: b["pos"] < name["pos"])).cast("long")
    counted = lambda page: F.transform(page["names"], lambda x: x.withField("blocks_before", before(page["blocks"], x)))
    found = marked_pages(spark, d).select("page_id", let(M.structure(F.col("html"), whole_page=False), counted).alias("names"))
    return M.anchor_positions(found, marked_toc(spark, d)).select("page_id", "seq", "title", "blocks_before")


# Pages with a table in a table, a list in a list item, list items that hold other elements or are never closed, a heading around
# a box, and notes in notes or never closed.
_NEST = "<table><tr><td>a<TABLE><tr><td>b</td></tr></table>LEAK</td></tr></table><ul><li>outer<ul><li>deep {}</li></ul>lost</li><li><div>held</div> too</li></ul><ol><li>open<li>second</ol><h2><div>Boxed</div></h2><blockquote><div>said</div></blockquote><p>x<sup>1<sup>2</sup>3</sup>y<sup>never<p>z</p></nav>"


def nested_pages(spark, d):
    before, after = _NEST.split("{}")
    added = F.concat(F.lit(f"</h1>{before}"), F.col("page_id").cast("string"), F.lit(after))
    return pages(spark, d).select("page_id", F.replace("html", F.lit("</h1>"), added).alias("html"))


@register(
    "nested_blocks",
    rf"""WITH nested AS (SELECT page_id, replace(html, '</h1>', '</h1>{_NEST.split("{}")[0]}'||page_id||'{_NEST.split("{}")[1]}') AS html FROM pages),
    plain AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g') AS html FROM nested),
    -- Each piece begins with a tag of the kind; what stands at depth 0 stays. The depth is a running sum that stops at 0.
    t AS (SELECT page_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (SELECT page_id, string_split(regexp_replace(html, '(?i)(</?(?:table|figure|nav)\b)', chr(1)||'\1', 'g'), chr(1)) AS ps FROM plain)),
    t1 AS (SELECT *, sum(CASE WHEN regexp_matches(p, '(?i)^<(?:table|figure|nav)\b') THEN 1 WHEN regexp_matches(p, '(?i)^</(?:table|figure|nav)\b') THEN -1 ELSE 0 END) OVER w AS s FROM t WINDOW w AS (PARTITION BY page_id ORDER BY k)),
    t2 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY k)) AS depth FROM t1),
    whole AS (SELECT page_id, string_agg(regexp_replace(p, '(?i)^</?(?:table|figure|nav)\b[^>]*>', ''), '' ORDER BY k) AS html FROM t2 WHERE depth = 0 GROUP BY 1),
    -- Notes end at the border of a block at the latest: each border begins a part of its own.
    n AS (SELECT page_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (SELECT page_id, string_split(regexp_replace(html, '(?i)(</?(?:sup|p|h[1-6]|blockquote|li|article|section|header|div|footer|body|ul|ol)\b)', chr(1)||'\1', 'g'), chr(1)) AS ps FROM whole)),
    n0 AS (SELECT *, sum(CASE WHEN regexp_matches(p, '(?i)^</?sup\b') THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY k) AS part FROM n),
    n1 AS (SELECT *, sum(CASE WHEN regexp_matches(p, '(?i)^<sup\b') THEN 1 WHEN regexp_matches(p, '(?i)^</sup\b') THEN -1 ELSE 0 END) OVER (PARTITION BY page_id, part ORDER BY k) AS s FROM n0),
    n2 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id, part ORDER BY k)) AS depth FROM n1),
    clean AS (SELECT page_id, regexp_replace(string_agg(regexp_replace(p, '(?i)^</?sup\b[^>]*>', ''), '' ORDER BY k), '(?i)<br\b[^>]*>', ' ', 'g') AS html FROM n2 WHERE depth = 0 GROUP BY 1),
    -- A block ends at the next tag that its kind does not hold; quotations and list items count if that is their own end.
    b AS (SELECT page_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (SELECT page_id, string_split(regexp_replace(html, '(?i)(</?(?:p|h[1-6]|blockquote|li|article|section|header|div|footer|body|ul|ol)\b)', chr(1)||'\1', 'g'), chr(1)) AS ps FROM clean)),
    b1 AS (SELECT page_id, k, p, lower(regexp_extract(p, '(?i)^(</?\w+)', 1)) AS tag FROM b),
    ends AS (SELECT page_id, k, tag FROM b1 WHERE regexp_matches(tag, '^</?(p|h[1-6]|blockquote|li|article|section|header|div|footer|body|ul|ol)$')),
    starts AS (SELECT x.page_id, x.k, x.tag, (SELECT min((e.k, e.tag)) FROM ends e WHERE e.page_id = x.page_id AND e.k > x.k AND (x.tag = '<p' OR regexp_matches(e.tag, '^</?(p|h[1-6]|blockquote|li|body)$')
            OR (x.tag = '<li' AND e.tag IN ('<ul', '</ul', '<ol', '</ol')) OR (x.tag LIKE '<h_' AND e.tag IN ('<ul', '</ul', '<ol', '</ol', '<article', '</article', '<footer', '</footer')))) AS stop
        FROM b1 x WHERE regexp_matches(x.tag, '^<(p|h[1-6]|blockquote|li)$')),
    leaves AS (SELECT page_id, k, tag[2:] AS tag, stop[1] AS upto FROM starts WHERE tag = '<p' OR tag LIKE '<h_' OR (tag = '<blockquote' AND stop[2] = '</blockquote') OR (tag = '<li' AND stop[2] IN ('</li', '<li', '</ul', '</ol'))),
    texts AS (SELECT l.page_id, l.k, l.tag, string_agg(b.p, '' ORDER BY b.k) AS whole FROM leaves l JOIN b ON b.page_id = l.page_id AND b.k >= l.k AND b.k < coalesce(l.upto, 1000000000) GROUP BY ALL)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, tag, {_TEXT.format(c="whole")} AS text FROM texts""",
)
def nested_blocks(spark, d):
    return M.leaf_blocks(nested_pages(spark, d)).select("page_id", "pos", "tag", M.block_text(F.col("inner")).alias("text"))


_BARE = "regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"


@register(
    "book_chapters",
    rf"""WITH {_MARKED}, {_PIECES},
    files AS (SELECT page_id, title FROM toc WHERE fragment = ''),
    split AS (SELECT page_id FROM marks GROUP BY 1 HAVING count(*) >= 2),
    placed AS (SELECT b.page_id, b.place, b.text, (SELECT max((m.place, m.seq)) FROM marks m WHERE m.page_id = b.page_id AND m.place <= b.place) AS x FROM blocks b WHERE b.page_id IN (FROM split)),
    parts AS (SELECT page_id, coalesce(x[2], -1)::INT AS part, string_agg(text, chr(10)||chr(10) ORDER BY place) AS text FROM placed GROUP BY 1, 2),
    titled AS (SELECT p.page_id, part, CASE WHEN part < 0 THEN coalesce(f.title, 'Introduction') ELSE m.title END AS title, text
        FROM parts p LEFT JOIN files f USING (page_id) LEFT JOIN marks m ON m.page_id = p.page_id AND m.seq = p.part),
    whole AS (SELECT d.page_id, 0 AS part, coalesce(f.title, nullif({_TEXT.format(c="regexp_extract(d.html, '(?is)<h1>(.*?)</h1>', 1)")}, '')) AS title, t AS text
        FROM marked d LEFT JOIN files f USING (page_id) JOIN (SELECT page_id, string_agg(text, chr(10)||chr(10) ORDER BY place) AS t FROM blocks GROUP BY 1) USING (page_id)
        WHERE d.page_id NOT IN (FROM split)),
    chapters AS (SELECT book, c.*, row_number() OVER (PARTITION BY book ORDER BY c.page_id, part) AS n
        FROM (FROM titled UNION ALL FROM whole WHERE title IS NULL OR NOT starts_with(title, 'Cover')) c JOIN marked USING (page_id) WHERE length(text) >= 200),
    named_ AS (SELECT book, page_id, part, coalesce(title, 'Chapter '||n) AS title, text FROM chapters)
    SELECT book, page_id, part, title, text FROM (SELECT book, page_id, part, title, CASE WHEN {_BARE.format(c="title")} <> ''
            AND {_BARE.format(c="title")} = {_BARE.format(c="split_part(text, chr(10)||chr(10), 1)")}
        THEN substr(text, length(split_part(text, chr(10)||chr(10), 1)) + 3) ELSE text END AS text FROM named_) WHERE length(text) >= 200""",
)
def book_chapters(spark, d):
    return M.book_chapters(marked_pages(spark, d), marked_toc(spark, d))


@register("min_length_filter", "SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(text) >= 200")
def min_length_filter(spark, d):
    return table(spark, d, "documents").where(F.length("text") >= M.MIN_CHAPTER).select("doc_id", F.length("text").alias("n_chars"))


_TITLES = "CASE p_partkey % 9 WHEN 0 THEN 'Cover' WHEN 1 THEN 'TITLE  page' WHEN 2 THEN 'Also by' WHEN 3 THEN 'Covering fire' WHEN 4 THEN NULL ELSE p_name END"


@register("front_matter_filter", f"SELECT * FROM (SELECT p_partkey, {_TITLES} AS title FROM part) WHERE title IS NULL OR NOT regexp_matches(title, '(?i)^(cover|title\\s*page|copyright|contents|table of contents|dedication|colophon|also by|about the author|other books)')")
def front_matter_filter(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.expr(_TITLES).alias("title"))
    return rows.where(F.coalesce(~F.col("title").rlike(M.FRONT_MATTER), F.lit(True)))


@register("title_fallback", "SELECT p_partkey, p_brand AS book, coalesce(CASE WHEN p_size % 3 = 0 THEN p_name END, nullif(CASE WHEN p_size % 3 = 1 THEN p_type ELSE '' END, ''), 'Chapter '||row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)) AS title FROM part WHERE p_size > 5")
def title_fallback(spark, d):
    listed, heading = F.when(F.col("p_size") % 3 == 0, F.col("p_name")), F.when(F.col("p_size") % 3 == 1, F.col("p_type")).otherwise("")
    rows = table(spark, d, "part").where("p_size > 5").select("p_partkey", F.col("p_brand").alias("book"), F.coalesce(listed, F.nullif(heading, F.lit(""))).alias("title"))
    placed = numbered(rows, "book", "p_partkey", "n")
    return placed.select("p_partkey", "book", F.coalesce("title", F.concat(F.lit("Chapter "), (F.col("n") + 1).cast("string"))).alias("title"))


@register("strip_leading_title", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name||'!'||chr(10)||chr(10)||p_type END AS text FROM part")
def strip_leading_title(spark, d):
    title = F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise("zz")
    return table(spark, d, "part").select("p_partkey", M.strip_leading_title(title, F.concat("p_name", F.lit("!")), F.col("p_type")).alias("text"))


@register("repair_metadata", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_suppkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name||' by '||s_name ELSE p_name||' by '||s_name END AS title, CASE l_suppkey % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Jane Roe' ELSE 'x' END AS author FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_suppkey % 3 < 2 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trim(p_name), s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_suppkey % 3 = 2")
def repair_metadata(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = lines.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    kind = F.col("l_suppkey") % 3
    title = F.when(kind == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" by "), "s_name"))
    author = F.when(kind == 0, "Unknown").when(kind == 1, "Jane Roe").otherwise(" ")
    t, a = M.repair_metadata(title, author)
    return rows.select(*lines.columns, t.alias("title"), a.alias("author"))


@register("book_summary_rollup", "SELECT source AS book, doc_id AS chapter, sum(length(text))::BIGINT AS chars, count(*) AS chapters, grouping_id(source, doc_id) AS level FROM documents WHERE length(text) > 0 GROUP BY ROLLUP (source, doc_id)")
def book_summary_rollup(spark, d):
    rows = table(spark, d, "documents").where(F.length("text") > 0).select(F.col("source").alias("book"), F.col("doc_id").alias("chapter"), F.length("text").alias("n"))
    return rows.rollup("book", "chapter").agg(F.sum("n").alias("chars"), F.count("*").alias("chapters"), F.grouping_id().alias("level"))


@register("clamped_chapter", "SELECT book, doc_id, idx FROM (SELECT source AS book, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE idx = least(7, n - 1)")
def clamped_chapter(spark, d):
    return first_or_last(table(spark, d, "documents").select(F.col("source").alias("book"), "doc_id"), "book", "doc_id", "idx", 7)
