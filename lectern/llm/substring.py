"""Substring deduplication by prefix-free parsing: bytes covered by a LENGTH-byte string that starts elsewhere too are removed.

A rolling hash triggers phrase borders that depend on content only: the border of a string is the last minimum of the hashes
of its first REACH windows, so that equal strings have the same border at the same place and no string is without one. All
strings of a text with one border form an entry: the text from the first of them to the end of the last. Equal entries are one
phrase of the dictionary, and a table of entries is the parse. Phrases met twice are settled as a whole; of the other
phrases only those that share the text right of their border with a different phrase need to look inside, once for each
phrase however often it occurs: a suffix array over the phrases of a right context, to depth LENGTH, brings their strings into
byte order, and equal strings are neighbours in it. Equal strings have one right context, so the order inside each is all of
the corpus order that repeats can be seen in. Matches never cross texts because entries lie inside one.

Phrases and right contexts are known by 64-bit fingerprints; strings inside them are compared byte by byte (by fingerprint
for the right contexts of over TOGETHER phrases). Null texts count as empty; texts under LENGTH bytes lose nothing, an empty
table gives no rows, a very long text is one buffer of a task. Rows that share a doc_id are texts of their own. Rows with a
null doc_id are judged and count as a place like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import BROADCAST_ROWS, bounded_batches, fresh, hot_keys, mixed, saved, sized, spread_join, text_bytes, tidy

LENGTH, WINDOW, REACH = 400, 16, 256
#: Bytes right of a border that every string with that border contains.
RIGHT = LENGTH - REACH
#: Phrases with one right context that one task compares; contexts with more are counted over all tasks.
TOGETHER = 2000
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, 1 << 64))
        k *= 2
    return out


_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def forget_powers() -> None:
    """Drop the tables of the longest buffer that a worker has met; Spark uses workers again for later stages."""
    _POWERS.update(up=np.ones(1, np.uint64), down=np.ones(1, np.uint64))


class Fingerprints:
    """Hashes of any part of a buffer of at least WINDOW bytes, and its borders."""

    def __init__(self, buffer: bytes):
        h = np.frombuffer(buffer, np.uint8).astype(np.uint64) + np.uint64(0x51_7C_C1_B7)
        width, factor = 1, 0xD6E8FEB86659FD93
        while width < WINDOW:
            h = h[:-width] * np.uint64(factor) + h[width:]
            h ^= h >> np.uint64(29)
            width, factor = 2 * width, factor * factor % (1 << 64) | 1
        self.windows = mixed(h)
        n = len(self.windows) + 1
        if len(_POWERS["up"]) < n:
            _POWERS["up"], _POWERS["down"] = _powers(BASE, n), _powers(_INVERSE, n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(self.windows * _POWERS["up"][: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[start + length - WINDOW + 1] - self.sums[start]) * _POWERS["down"][start])

    def borders(self) -> np.ndarray:
        """For each place, that of the last least hash among the REACH windows from it."""
        low = (self.windows >> np.uint64(32) << np.uint64(32)) | np.arange(len(self.windows) - 1, -1, -1, dtype=np.uint64)
        width = 1
        while width < REACH:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        return len(self.windows) - 1 - (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def entries(texts: list[bytes]) -> list[np.ndarray]:
    """(text number, first start, last start, key of the right context, key of the whole) of all entries of the texts."""
    long_ = [k for k, t in enumerate(texts) if len(t) >= LENGTH]
    if not long_:
        return [np.zeros(0, np.int64)] * 5
    print_ = Fingerprints(b"".join(texts[k] for k in long_))
    border = print_.borders()
    sizes = np.array([len(texts[k]) for k in long_])
    base = np.cumsum(sizes) - sizes
    counts = sizes - LENGTH + 1
    at = np.concatenate([np.arange(b, b + c) for b, c in zip(base, counts, strict=True)])
    owner = np.repeat(np.arange(len(long_)), counts)
    head = np.flatnonzero(np.concatenate([[True], (border[at][1:] != border[at][:-1]) | (owner[1:] != owner[:-1])]))
    last = np.concatenate([head[1:], [len(at)]]) - 1
    lo, hi, mark, own = at[head], at[last], border[at[head]], owner[head]
    right = print_.of(mark, RIGHT)
    whole = mixed(print_.of(lo, hi - lo + LENGTH) + (mark - lo).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + (hi - lo).astype(np.uint64))
    return [np.array(long_)[own], lo - base[own], hi - base[own], right.view(np.int64), whole.view(np.int64)]


def _dense(key: np.ndarray) -> np.ndarray:
    """The place of each key's value among the distinct values in their order."""
    order = np.argsort(key)
    rank = np.empty(len(key), np.uint32)
    rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
    return rank


def suffix_array(buffer: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the LENGTH-byte strings that begin at `starts`, by their bytes, and whether each equals the one before it.

    Suffixes get ranks by prefix doubling until a power of two covers over half of LENGTH; two overlapping ones cover it all.
    """
    n, width = len(buffer), 8
    padded = np.frombuffer(buffer + bytes(width), np.uint8)
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = key << np.uint64(8) | padded[k : k + n]
    rank = _dense(key)

    def pair(at: np.ndarray, gap: int) -> np.ndarray:
        return rank[at].astype(np.uint64) << np.uint64(32) | rank[at + gap]

    while 2 * width <= LENGTH:
        # The last places have no second half; no string of LENGTH bytes looks there.
        rank = _dense(pair(np.arange(len(rank) - width), width))
        width *= 2
    key = pair(starts, LENGTH - width)
    order = np.argsort(key)
    return order, np.concatenate([[False], key[order][1:] == key[order][:-1]])


def repeated_strings(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content number, first, last) of the runs of strings that occur twice among contents of at least LENGTH bytes."""
    sizes = np.array([len(c) for c in contents])
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(contents)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    order, equal = suffix_array(b"".join(contents), (np.cumsum(sizes) - sizes)[owner] + offset)
    twice = np.zeros(len(order), bool)
    twice[order[equal]] = twice[order[np.flatnonzero(equal) - 1]] = True
    at = np.flatnonzero(twice)
    if not len(at):
        return at, at, at
    cut = np.flatnonzero((np.diff(at) > 1) | (owner[at][1:] != owner[at][:-1])) + 1
    first, last = at[np.concatenate([[0], cut])], at[np.concatenate([cut, [len(at)]]) - 1]
    return owner[first], offset[first], offset[last]


def with_spans(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Texts with their `spans` (structs of the other columns) as an array. Texts are shuffled only if there are too many spans to broadcast."""
    few = spans.count() <= BROADCAST_ROWS
    lists = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(*[c for c in spans.columns if c != "row"]))).alias("spans"))
    return docs.join(F.broadcast(lists) if few else lists, "row", how)


def merged(spans: DataFrame) -> DataFrame:
    """Starts (row, lo, hi) with neighbouring and overlapping ones joined where what they cover touches."""

    w = Window.partitionBy("row").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("lo") > reach + LENGTH), 1).otherwise(0)
    marked = spans.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("row", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("row", "lo", "hi")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """Starts (row, lo, hi) of strings that start anywhere else too; texts: (row, text) with distinct texts."""
    bounded_batches(texts.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = b.column(0), 0
            for some in slices(b.column(1).to_pylist()):
                k, lo, hi, right, whole = entries(some)
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(k + at)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(right), pa.array(whole)], names=["row", "lo", "hi", "right", "whole"])
                at += len(some)
        forget_powers()

    parsed = saved(texts.mapInArrow(tidy(parse), "row long, lo int, hi int, right long, whole long"), "parse")
    place = F.xxhash64("row", "lo")
    phrases = saved(parsed.groupBy("right", "whole").agg(F.count("*").alias("n"), F.min(place).alias("first")), "dictionary")
    several = phrases.groupBy("right").agg(F.count("*").alias("k")).where("k > 1")
    wanted = phrases.join(several, "right", "left").where("n > 1 or k > 1").withColumn("k", F.coalesce("k", F.lit(1)))
    met = spread_join(parsed, wanted, ["right", "whole"], "inner", hot_keys(parsed, ["right", "whole"], "parse"), "met").withColumn("look", (F.col("k") > 1) & (place == F.col("first"))).where("n > 1 or look")
    met = saved(met.select("row", "lo", "hi", "right", "n", "k", "look"), "met")

    # Of each phrase to look into, one place: its content goes to the others with the same right context.
    held = with_spans(texts, met.where("look").select("row", "lo", "hi", "right", "k"), "inner").select("row", "text", F.explode("spans").alias("s"))
    content = F.expr(f"substring(text, s.lo + 1, s.hi - s.lo + {LENGTH})")
    held = held.select("row", "s.lo", "s.right", "s.k", content.alias("content"))

    def runs(rows: list, contents: list[bytes]) -> pa.RecordBatch:
        k, first, last = repeated_strings(contents)
        lo = np.array([r[1] for r in rows], np.int64)[k]
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in k.tolist()], pa.int64()), pa.array((lo + first).astype(np.int32)), pa.array((lo + last).astype(np.int32))], names=["row", "lo", "hi"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, contents, groups = [], [], np.zeros(0, np.uint64)
        for b in batches:
            rows += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            contents += b.column(3).to_pylist()
            groups = np.concatenate([groups, b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(groups.view(np.int64), groups.view(np.int64)[-1])) if len(groups) else 0
            if cut:
                yield runs(rows[:cut], contents[:cut])
                rows, contents, groups = rows[cut:], contents[cut:], groups[cut:]
        if rows:
            yield runs(rows, contents)

    columns = "row long, lo int, hi int"
    inside = held.where(f"k <= {TOGETHER}").select("row", "lo", "right", "content").repartition("right").sortWithinPartitions("right").mapInArrow(tidy(look), columns)
    found = met.where("n > 1").select("row", "lo", "hi").unionByName(inside)
    if not met.where(f"look and k > {TOGETHER}").isEmpty():
        found = found.unionByName(_one_by_one(held.where(f"k > {TOGETHER}").select("row", "lo", "right", "content")))
    return found


def _one_by_one(held: DataFrame) -> DataFrame:
    """The same for right contexts with very many phrases: their strings are counted by fingerprint over all tasks."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, lo, right, content in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                at = np.arange(len(content) - LENGTH + 1)
                key = Fingerprints(content).of(at, LENGTH).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row)), pa.array((lo + at).astype(np.int32)), pa.array(np.full(len(at), right)), pa.array(key)], names=["row", "lo", "right", "key"])

    all_ = saved(held.mapInArrow(strings, "row long, lo int, right long, key long"), "strings")
    twice = all_.groupBy("right", "key").agg(F.count("*").alias("n")).where("n > 1").select("right", "key")
    return all_.join(twice, ["right", "key"], "left_semi").select("row", "lo", F.col("lo").alias("hi"))


def deduplicated(docs: DataFrame, text: str = "text", as_text: bool = False) -> DataFrame:
    """Every row with n_bytes, n_removed, n_spans and what is left of the text; other columns are kept.

    What is left is `kept_bytes`, or `kept_text` without the pieces of characters that a cut went through.
    """
    bounded_batches(docs.sparkSession)
    new = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_text", T.StringType()) if as_text else T.StructField("kept_bytes", T.BinaryType())]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in {f.name for f in new}])
    body, x, y = (fresh(docs, n) for n in ("_body", "_x", "_y"))
    kept = docs.columns
    docs = docs.withColumn(body, text_bytes(f"`{text}`")).withColumn(x, F.xxhash64(body)).withColumn(y, F.xxhash64(F.lit(3), body))
    keys = docs.where(F.octet_length(body) >= LENGTH).select(F.col(x).alias("row"), F.col(y).alias("y"))
    # A text is known by its hash. Of equal texts one takes part; each of them is then removed as a whole.
    many = saved(keys.groupBy("row", "y").agg(F.count("*").alias("n")).where("n > 1").select("row", "n"), "copied")
    texts = docs.where(F.octet_length(body) >= LENGTH).select(F.col(x).alias("row"), F.col(body).alias("text"))
    once = texts.join(sized(many), "row", "left")
    first = saved(once.where("n is not null").select("row", "text").dropDuplicates(["row"]), "copies") if not many.isEmpty() else None
    distinct = once.where("n is null").select("row", "text")
    distinct = distinct.unionByName(first) if first is not None else distinct
    spans = saved(merged(repeated_spans(distinct)), "spans")
    whole = many.select("row", F.lit(0).alias("lo"), F.lit(-1).alias("hi"))
    spans = saved(spans.join(many, "row", "left_anti").unionByName(whole), "cover")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, n, left = [], [], [], []
            for t, ss in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                at, gone, pieces = 0, 0, []
                for s in ss or []:
                    lo, hi = s["lo"], len(t) if s["hi"] < 0 else s["hi"] + LENGTH
                    pieces.append(t[at:lo])
                    gone, at = gone + hi - lo, hi
                sizes.append(len(t))
                removed.append(gone)
                n.append(len(ss or []))
                rest = b"".join([*pieces, t[at:]])
                left.append(rest.decode("utf-8", "ignore") if as_text else rest)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(b.num_columns - 2)], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(left, pa.string() if as_text else pa.binary())], names=[*kept, *[f.name for f in new]])

    out = T.StructType([*[f for f in docs.schema.fields if f.name in kept], *new])
    mine = fresh(docs, "_spans")
    lists = spans.groupBy(F.col("row").alias(x)).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias(mine))
    lists = F.broadcast(lists) if spans.count() <= BROADCAST_ROWS else lists
    return docs.join(lists, x, "left").select(*[F.col(f"`{c}`") for c in kept], body, mine).mapInArrow(tidy(cut), out)


def query(spark, sf_dir: str) -> DataFrame:
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
