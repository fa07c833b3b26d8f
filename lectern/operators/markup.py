"""Structure from page markup: leaf blocks, their text, sections between anchors, titles and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, strip
from ..sources.shared import settled
from .lexicon import small
from .ranks import numbered

#: Fixed value: shortest text of a chapter.
MIN_CHAPTER = 200
#: Elements that are dropped (those that hold no markup, may hold their like, stand in a line), block elements,
#: and elements that end a paragraph.
RAW, NESTING, INLINE = "script|style", "table|figure|nav", "sup"
BLOCKS = "p|h[1-6]|blockquote|li"
BORDERS = BLOCKS + "|article|section|header|div|footer|body|ul|ol"
#: Titles of front matter.
FRONT_MATTER = r"(?i)^(cover|title\s*page|copyright|contents|table of contents|dedication|colophon|also by|about the author|other books)"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
#: Fixed value: a title that names its author.
TITLE_BY_AUTHOR = r"(?i)^(.{2,}?)\s+by\s+(.{2,})$"


def running_depth(steps: Column) -> Column:
    """The running sum of an array of whole numbers that never falls below 0, at each place.

    The array is cut into about sqrt(n) parts; what a part does to a depth is its sum and its least running sum, so that each part
    is run through on its own from the depth at which it begins, and no long array is built up element by element.
    """
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    width = F.ceil(F.sqrt(F.size(steps))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.size(steps) - 1, width), lambda a: F.slice(steps, a + 1, width))

    def told(part: Column) -> Column:
        return F.aggregate(part, F.struct(zero.alias("sum"), zero.alias("least")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.least(a["least"], a["sum"] + x).alias("least")))

    def begin(a: Column, part: Column) -> Column:
        return let(told(part), lambda t: F.struct((F.greatest(a["depth"], -t["least"]) + t["sum"]).alias("depth"), F.array_append(a["begins"], a["depth"]).alias("begins")))

    def within(part: Column, depth: Column) -> Column:
        step = lambda a, x: let(F.greatest(zero, a["depth"] + x), lambda d: F.struct(d.alias("depth"), F.array_append(a["depths"], d).alias("depths")))
        return F.aggregate(part, F.struct(depth.alias("depth"), none.alias("depths")), step, lambda a: a["depths"])

    begins = lambda ps: F.aggregate(ps, F.struct(zero.alias("depth"), none.alias("begins")), begin, lambda a: a["begins"])
    return F.when(F.size(steps) == 0, none).otherwise(let(parts, lambda ps: F.flatten(F.zip_with(ps, begins(ps), within))))


#: More than any depth.
_ALL = 1 << 40


def without_subtrees(c: Column, names: str, borders: str | None = None) -> Column:
    """Markup without the elements of these names, whole: tags are matched by their running depth, whatever lies in them.

    An element that is never closed reaches to the end, or, if `borders` are given, to the next tag of such a name. Closing tags
    without an element go alone.
    """
    any_name = f"{names}|{borders}" if borders else names
    tag = rf"(?is)^</?(?:{names})\b[^>]*>"
    reset = F.lit(-_ALL) if borders else F.lit(0)

    def step(piece: Column) -> Column:
        opened, closed = piece.rlike(rf"(?i)^<(?:{names})\b(?![^>]*/>)"), piece.rlike(rf"(?i)^</(?:{names})\b")
        border = piece.rlike(rf"(?i)^</?(?:{borders})\b") if borders else F.lit(False)
        return F.when(opened, 1).when(closed, -1).when(border, reset).otherwise(0).cast("long")

    pieces = F.split(c, rf"(?i)(?=</?(?:{any_name})\b)", -1)
    kept = lambda ps: F.zip_with(ps, running_depth(F.transform(ps, step)), lambda p, d: F.when(d == 0, F.regexp_replace(p, tag, "")).otherwise(""))
    return F.when(c.rlike(rf"(?i)</?(?:{names})\b"), let(pieces, lambda ps: F.array_join(kept(ps), ""))).otherwise(c)


def clean_html(c: Column) -> Column:
    """Markup without comments and dropped elements; a line break is a blank."""
    c = F.regexp_replace(c, "(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, rf"(?is)<({RAW})\b[^>]*>.*?</\1\s*>", "")  # ends at its first closing tag, whatever it holds
    c = without_subtrees(without_subtrees(c, NESTING), INLINE, BORDERS)
    return F.regexp_replace(c, r"(?i)<br\b[^>]*>", " ")


def block_text(c: Column) -> Column:
    c = F.regexp_replace(c, "<[^>]*>", "")
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(c, r"[\s ]+", " "))


def _until(names: str) -> str:
    return rf"((?:(?!</?(?:{names})\b).)*+)"


#: Innermost blocks. A paragraph ends at any border; headings, quotations and list items may hold elements that are no blocks.
LEAF_BLOCK = (
    rf"(?is)(?:<p\b[^>]*>{_until(BORDERS)}|<h[1-6]\b[^>]*>{_until(BLOCKS + '|body|ul|ol|article|footer')}"
    rf"|<blockquote\b[^>]*>{_until(BLOCKS + '|body')}(?=</blockquote\b)|<li\b[^>]*>{_until(BLOCKS + '|body|ul|ol')}(?=</li\b|<li\b|</[uo]l\b))"
)
#: Elements without content of their own.
VOID = r"(?i)^<(br|hr|img|input|wbr|col|area|embed|source|track)\b|/>$"


def _leaves(clean: Column) -> Column:
    """The innermost blocks of clean markup, as an array."""
    return F.regexp_extract_all(clean, F.lit(f"({LEAF_BLOCK})"), 1)


def _inner(block: Column) -> Column:
    return F.regexp_extract(block, r"(?s)^<[^>]*>(.*)$", 1)


def leaf_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, tag, attrs, inner) of innermost blocks in order: a quotation or list item counts only if it reaches its end (a list
    item also a sibling's start or the end of its list) without a block inside."""
    found = pages.select(key, F.posexplode(_leaves(clean_html(F.col(html)))).alias("pos", "block"))
    tag = F.lower(F.regexp_extract("block", r"(?i)^<(\w+)", 1))
    return found.select(key, "pos", tag.alias("tag"), F.regexp_extract("block", r"(?s)^<\w+\b([^>]*)>", 1).alias("attrs"), _inner(F.col("block")).alias("inner"))


def texts(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("text", block_text(F.col("inner"))).where("text <> ''")


def page_text_column(html: Column) -> Column:
    """The blocks of a page joined by blank lines, else all its text."""
    blocks = lambda clean: F.array_join(F.filter(F.transform(_leaves(clean), lambda b: block_text(_inner(b))), lambda t: t != ""), "\n\n")
    return let(clean_html(html), lambda clean: let(blocks(clean), lambda t: F.when(t != "", t).otherwise(F.nullif(block_text(clean), F.lit("")))))


def page_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text) of each page. Nothing is shuffled."""
    return pages.select(key, page_text_column(F.col(html)).alias("text"))


def assembled(blocks: DataFrame, *keys: str) -> DataFrame:
    """Texts of blocks (pos, text) joined in order by blank lines, for each combination of keys."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "text")))
    return blocks.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


def toc_nodes(toc: DataFrame, depth: int | None = None) -> DataFrame:
    """(book_id, node, parent, place, href, title) of a nested column `toc` (nodes of href, title, children): as deep as its type."""
    node = lambda path: F.concat_ws("/", path)
    level, out, k = toc.select("book_id", F.posexplode("toc").alias("i", "at")).withColumn("path", F.array("i")), None, 1
    while True:
        above = F.when(F.size("path") > 1, node(F.slice("path", F.lit(1), F.size("path") - 1)))
        here = level.select("book_id", node("path").alias("node"), above.alias("parent"), F.col("i").alias("place"), F.col("at.href").alias("href"), F.col("at.title").alias("title"))
        out = here if out is None else out.unionByName(here)
        if "children" not in level.schema["at"].dataType.names or k == depth:
            return out
        level = level.select("book_id", "path", F.posexplode("at.children").alias("i", "at")).select("book_id", "i", "at", F.concat("path", F.array("i")).alias("path"))
        k += 1


def flatten_nodes(nodes: DataFrame) -> DataFrame:
    """(book_id, seq, href, fragment, title) of tables of contents as rows (book_id, node, parent, place among siblings, href,
    title), depth first, of any depth; nodes without href are left out, those below them are not.

    Each level is one join of the level above with its children, until a level is empty; a node's path of places orders it. Nodes
    whose parent is null or not in the book are at the top. (Recursive SQL does the same, up to a limit of rows.)
    """
    nodes = settled(nodes.select("book_id", "node", "parent", "place", "href", "title"), "toc")
    there = nodes.select("book_id", F.col("node").alias("parent")).distinct()
    # The rows of one parent are one task's, but not those of one book.
    level = settled(nodes.join(there, ["book_id", "parent"], "left_anti").withColumn("path", F.array("place")), "toc-level")
    out = level
    while not level.isEmpty():
        above = level.select("book_id", F.col("node").alias("parent"), "path")
        level = settled(nodes.join(above, ["book_id", "parent"]).withColumn("path", F.concat("path", F.array("place"))).select(out.columns), "toc-level")
        out = out.unionByName(level)
    listed = out.where("coalesce(href, '') <> ''").select("book_id", "path", "href", "title")
    return numbered(listed, "book_id", "path", "seq").select("book_id", "seq", *split_href(F.col("href")), "title")


def flatten_toc(toc: DataFrame, depth: int | None = None) -> DataFrame:
    """(book_id, seq, href, fragment, title) of a nested table of contents, `depth` levels or all that its type has."""
    return flatten_nodes(toc_nodes(toc, depth))


def split_href(c: Column) -> list[Column]:
    parts = F.split(c, "#", 2)
    return [F.get(parts, F.lit(0)).alias("href"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("fragment")]


def grouped_toc(toc: DataFrame) -> DataFrame:
    """(href, fragments in order, title of the whole file: the first)."""
    fragments = F.transform(F.sort_array(F.collect_list(F.when(F.col("fragment") != "", F.struct("seq", "fragment")))), lambda x: x["fragment"])
    return toc.groupBy("href").agg(fragments.alias("fragments"), F.min_by(F.when(F.col("fragment") == "", F.col("title")), F.when(F.col("fragment") == "", F.col("seq"))).alias("title"))


def anchors(blocks: DataFrame, toc: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, seq, pos, title) of located fragments: the first block with that id on or in it, else with a link of that name."""
    tags = F.concat(F.lit("<x "), "attrs", F.lit(">"), "inner")
    value = r"""\s*=\s*["']?([^"'\s>]+)"""
    found = lambda rank, pattern: F.transform(F.regexp_extract_all(tags, F.lit(pattern + value), 1), lambda x: F.struct(F.lit(rank).alias("rank"), x.alias("fragment")))
    named = blocks.select(key, "pos", F.explode(F.concat(found(0, r"(?i)<[^>]*?\sid"), found(1, r"(?i)<a\b[^>]*?\sname"))).alias("x"))
    named = named.select(key, "pos", "x.rank", "x.fragment")
    return named.join(toc, [key, "fragment"]).groupBy(key, "seq", "title").agg(F.min(F.struct("rank", "pos")).alias("at")).select(key, "seq", "title", F.col("at.pos").alias("pos"))


#: Begin and end an item of `_items` that is an innermost block.
_MARK, _END = "\u0001", "\u0002"


def _items(clean: Column) -> Column:
    """The body in order: innermost blocks whole, between _MARK and _END, and all tags outside of them."""
    body = F.regexp_replace(F.translate(clean, _MARK + _END, ""), r"(?is)^.*?<body\b[^>]*>", "")
    marked = F.regexp_replace(body, rf"{LEAF_BLOCK}(?:</(?:{BLOCKS})\s*>)?", f"{_MARK}$0{_END}")
    return F.regexp_extract_all(marked, F.lit(rf"(?is)({_MARK}[^{_END}]*{_END}|</?[a-z][^>]*>)"), 1)


def _holder(items: Column, k: Column) -> Column:
    """The number of the tag that holds the k-th item, if that is a block, else null; the item lies outside of innermost blocks.

    Tags are read backwards. Elements that are closed before the item are passed over; list items, whose closing tags may be
    left out, count only outside of those.
    """
    start = F.struct(F.lit(0).alias("closed"), F.lit(False).alias("item_closed"), F.lit(False).alias("over"), F.lit(None).cast("int").alias("at"))

    def back(a: Column, n: Column) -> Column:
        tag = F.get(items, n)
        passed, closing, li = tag.startswith(_MARK) | tag.rlike(VOID) | tag.rlike(r"(?i)^</?(?:p|h[1-6])\b"), tag.startswith("</"), tag.rlike(r"(?i)^</?li\b")
        at = lambda closed, item_closed, over=F.lit(False), found=F.lit(None).cast("int"): F.struct(closed.alias("closed"), item_closed.alias("item_closed"), over.alias("over"), found.alias("at"))
        block = F.when(tag.rlike(rf"(?i)^<(?:{BLOCKS})\b"), n)
        return (
            F.when(a["over"] | passed | (li & (a["closed"] > 0)), a)
            .when(li & closing, at(a["closed"], F.lit(True)))
            .when(li & a["item_closed"], at(a["closed"], F.lit(False)))
            .when(closing, at(a["closed"] + 1, a["item_closed"]))
            .when(a["closed"] > 0, at(a["closed"] - 1, a["item_closed"]))
            .otherwise(at(a["closed"], a["item_closed"], F.lit(True), block))
        )

    return F.when(k > 0, F.aggregate(F.sequence(k - 1, F.lit(0), F.lit(-1)), start, back, lambda a: a["at"]))


def _named(items: Column) -> Column:
    """(fragment, rank, pos, i) of all ids (rank 0) and names of links (rank 1)."""
    value = lambda tag, name: F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*["']?([^"'\s>]+)""", 1)

    def names(tags: Column, tag: Column, i: Column, k: Column) -> Column:
        # Elements that are open between the block's own tag and this one.
        before = F.slice(tags, F.lit(2), F.greatest(i - 1, F.lit(0)))
        opened = F.size(F.filter(before, lambda t: ~t.startswith("</") & ~t.rlike(VOID))) - F.size(F.filter(before, lambda t: t.startswith("</")))
        inside = F.get(items, k).startswith(_MARK)
        pos = F.when(inside, 2 * k + F.when((i > 0) & (opened > 0), 1).otherwise(0)).when(tag.rlike(rf"(?i)^<(?:{BLOCKS})\b"), 2 * k).otherwise(2 * F.coalesce(_holder(items, k), k))
        one = lambda rank, fragment: F.struct(fragment.alias("fragment"), F.lit(rank).alias("rank"), pos.alias("pos"), i.alias("i"))
        both = F.array(one(0, value(tag, "id")), one(1, F.when(tag.rlike(r"(?i)^<a\b"), value(tag, "name")).otherwise("")))
        return F.filter(both, lambda x: x["fragment"] != "")

    none = F.array().cast("array<struct<fragment:string,rank:int,pos:int,i:int>>")
    has = r"(?is)<[^>]*\s(id|name)\s*="
    tags = lambda item: F.regexp_extract_all(item, F.lit("(</?[a-zA-Z][^>]*>)"), 1)
    of_item = lambda item, k: let(tags(item), lambda ts: F.flatten(F.transform(ts, lambda t, i: F.when(t.rlike(has), names(ts, t, i, k)).otherwise(none))))
    return F.flatten(F.transform(items, lambda item, k: F.when(item.rlike(has), of_item(item, k)).otherwise(none)))


def structure(html: Column, whole_page: bool = True) -> Column:
    """(blocks, names, text, heading) of a page, found in its row; without `whole_page` only (blocks, names).

    `blocks` has (pos, text) of the innermost blocks with text, `names` (fragment, rank, pos, i) of all ids and link names. A block,
    and what stands directly in a block, is at the block; what lies deeper is behind it, so that its section begins with the next
    block. Places of blocks are even. `text` are the blocks, else all text; `heading` is the first one of the first three ranks.
    """
    def blocks(items: Column) -> Column:
        found = F.transform(items, lambda x, k: F.struct((2 * k).alias("pos"), F.when(x.startswith(_MARK), block_text(_inner(F.translate(x, _MARK + _END, "")))).otherwise("").alias("text")))
        return F.filter(found, lambda b: b["text"] != "")

    heading = lambda clean: block_text(F.regexp_extract(clean, r"(?is)<(h[1-3])\b[^>]*>(.*?)</\1\s*>", 2))
    whole = lambda clean, bs: F.when(F.size(bs) > 0, F.array_join(F.transform(bs, lambda b: b["text"]), "\n\n")).otherwise(F.nullif(block_text(clean), F.lit("")))
    page = lambda clean, bs: [whole(clean, bs).alias("text"), F.nullif(heading(clean), F.lit("")).alias("heading")] if whole_page else []
    out = lambda clean, items, bs: F.struct(bs.alias("blocks"), _named(items).alias("names"), *page(clean, bs))
    return let(clean_html(html), lambda clean: let(_items(clean), lambda items: let(blocks(items), lambda bs: out(clean, items, bs))))


def anchor_positions(parsed: DataFrame, toc: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, seq, title, pos, ..) of the fragments of `toc` (key, fragment, seq, title) on pages (key, names): the first element with
    that id, else the first link with that name, with all further fields of `names`."""
    named = parsed.select(key, F.inline("names"))
    more = [c for c in named.columns if c not in (key, "fragment", "rank", "pos", "i")]
    at = F.min(F.struct("rank", "pos", "i", *more)).alias("at")
    return named.join(toc, [key, "fragment"]).groupBy(key, "seq", "title").agg(at).select(key, "seq", "title", *[F.col(f"at.{c}").alias(c) for c in ("pos", *more)])


def _page_chapters(page: Column, fragments: Column, file_title: Column) -> Column:
    """(part, title, text) of a page's chapters, from its structure and the entries (fragment, seq, title) that name it."""
    joined = lambda bs: F.array_join(F.transform(bs, lambda b: b["text"]), "\n\n")

    def mark(entry: Column) -> Column:
        at = F.array_min(F.transform(F.filter(page["names"], lambda x: x["fragment"] == entry["fragment"]), lambda x: F.struct(x["rank"], x["pos"], x["i"])))
        return F.struct(at["pos"].alias("pos"), entry["seq"].alias("seq"), entry["title"].alias("title"))

    def split(marks: Column) -> Column:
        first = F.struct(F.lit(-1).alias("part"), F.coalesce(file_title, F.lit("Introduction")).alias("title"), joined(F.filter(page["blocks"], lambda b: b["pos"] < F.get(marks, F.lit(0))["pos"])).alias("text"))
        end = lambda k: F.coalesce(F.get(marks, k + 1)["pos"], F.lit((1 << 31) - 1))
        sections = F.transform(marks, lambda m, k: F.struct(m["seq"].cast("int").alias("part"), m["title"].alias("title"), joined(F.filter(page["blocks"], lambda b: (b["pos"] >= m["pos"]) & (b["pos"] < end(k)))).alias("text")))
        return F.concat(F.array(first), sections)

    title = F.coalesce(F.nullif(file_title, F.lit("")), page["heading"])
    whole = F.array(F.struct(F.lit(0).alias("part"), title.alias("title"), page["text"].alias("text")))
    kept = F.filter(whole, lambda c: F.coalesce(~strip(c["title"]).rlike(FRONT_MATTER), F.lit(True)))
    found = F.array_sort(F.filter(F.transform(fragments, mark), lambda m: m["pos"].isNotNull()))
    chapters = let(found, lambda ms: F.when(F.size(ms) >= 2, split(ms)).otherwise(kept))
    return F.filter(chapters, lambda c: F.length(c["text"]) >= MIN_CHAPTER)


def book_chapters(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """(book, page_id, part, title, text): the chapters of books from their pages (book, page_id in reading order, html).

    `toc` has (page_id, fragment, seq, title); an empty fragment names the whole page. A page is split if two or more of its
    fragments are located: what stands before the first is a chapter of its own, part -1. Other pages are one chapter, named by
    the table of contents, else by their first heading, else by number, unless the name is that of front matter. Chapters
    under MIN_CHAPTER characters are left out, before and after a repeated title at their head is cut off.

    The contents are joined once, by a broadcast if they are counted small; a page is taken apart in its row. Only numbers of
    chapters without a name need the other chapters of a book: their places come from narrow rows.
    """
    entry = F.when(F.col("fragment") != "", F.struct("fragment", "seq", "title"))
    named = toc.groupBy("page_id").agg(F.collect_list(entry).alias("fragments"), F.min_by(F.when(F.col("fragment") == "", F.col("title")), F.when(F.col("fragment") == "", F.col("seq"))).alias("file_title"))
    kind = dict(toc.dtypes)
    none = F.array().cast(f"array<struct<fragment:string,seq:{kind['seq']},title:string>>")
    chapters = let(structure(F.col("html")), lambda page: _page_chapters(page, F.coalesce("fragments", none), F.col("file_title")))
    listed = pages.join(small(named), "page_id", "left").select("book", "page_id", F.inline(chapters))
    narrow = settled(listed.select("book", "page_id", "part", F.col("title").isNull().alias("unnamed")), "chapters")
    places = numbered(narrow, "book", ["page_id", "part"], "n").where("unnamed")
    numbers = small(places.select("page_id", "part", (F.col("n") + 1).cast("string").alias("n")))
    chapters = listed.join(numbers, ["page_id", "part"], "left").withColumn("title", F.coalesce("title", F.concat(F.lit("Chapter "), F.col("n"))))
    blocks = F.split("text", "\n\n", 2)
    text = F.coalesce(strip_leading_title(F.col("title"), F.get(blocks, F.lit(0)), F.get(blocks, F.lit(1))), F.lit(""))
    return chapters.select("book", "page_id", "part", "title", text.alias("text")).where(F.length("text") >= MIN_CHAPTER)


def asof_sections(blocks: DataFrame, marks: DataFrame, key: str = "page_id") -> DataFrame:
    """Blocks with the `seq` and `title` of the last anchor at or before them (null before the first): a window, no range join."""
    left = blocks.select(key, "pos", F.lit(None).cast("int").alias("seq"), F.lit(None).cast("string").alias("title"), "text", F.lit(1).alias("is_block"))
    right = marks.select(key, "pos", F.col("seq").cast("int").alias("seq"), "title", F.lit(None).cast("string").alias("text"), F.lit(0).alias("is_block"))
    w = Window.partitionBy(key).orderBy("pos", "is_block", "seq").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("is_block") == 0, F.struct("seq", "title")), ignorenulls=True).over(w)
    return left.unionByName(right).withColumn("at", last).where("is_block = 1").select(key, "pos", "text", F.col("at.seq").alias("seq"), F.col("at.title").alias("title"))


def strip_leading_title(title: Column, first: Column, rest: Column) -> Column:
    """The text without its first block, if that is the title in letters and digits."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    return F.when((bare(title) != "") & (bare(title) == bare(first)), rest).otherwise(F.concat_ws("\n\n", first, F.nullif(rest, F.lit(""))))


def repair_metadata(title: Column, author: Column) -> tuple[Column, Column]:
    useless = F.lower(F.trim(F.coalesce(author, F.lit("")))).isin("", "unknown") | (F.trim(author) == F.trim(title))
    split = useless & title.rlike(TITLE_BY_AUTHOR)
    return F.when(split, strip(F.regexp_extract(title, TITLE_BY_AUTHOR, 1))).otherwise(title), F.when(split, strip(F.regexp_extract(title, TITLE_BY_AUTHOR, 2))).otherwise(author)
