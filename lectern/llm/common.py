"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import settled as saved
from ..sources.shared import shared_dir as shared_dir

#: Words of the contracts: runs of anything but ASCII white space. bytes.split() without arguments splits at exactly these.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Documents that go to a Python worker at once; bounds its memory together with BATCH_BYTES.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Give the memory that a worker has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which the worker, which Spark uses again, gives the memory that it has freed back to the system."""

    def and_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return and_release


def tidy_fit(fit: Callable) -> Callable:
    """`fit`, after which the driver gives the memory of its sample back to the system; the JVM beside it grows with later stages."""

    @functools.wraps(fit)
    def and_release(*args, **named):
        try:
            return fit(*args, **named)
        finally:
            release()

    return and_release


def text_bytes(name: str = "text") -> Column:
    """UTF-8 of a text, empty for null."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null ids fall in no held-out class."""
    return F.crc32(doc_id.cast("string")) % n


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def append_columns(df: DataFrame, text: str, fields: list[tuple[str, T.DataType]], kernel: Callable[[list[bytes]], list[pa.Array]]) -> DataFrame:
    """Each row with more columns that `kernel` derives from a slice of whole texts. Columns of the same names are replaced."""
    names = {n.lower() for n, _ in fields}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    bounded_batches(df.sparkSession)
    body = fresh(df, "_bytes")
    keep = df.columns
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                texts = b.column(b.num_columns - 1).to_pylist()
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], *kernel(texts)], names=[*keep, *[n for n, _ in fields]])

    return df.withColumn(body, text_bytes(f"`{text}`")).mapInArrow(tidy(run), schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, y, text as bytes) of at most `per_class` labelled documents of either class, the first by a hash of the id.

    Rows whose crc32(doc_id) mod 4 is 2 are held out. At most 2 * per_class ids are broadcast.
    """
    pool = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    pool = pool.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    order = F.xxhash64(F.lit(17), F.col("doc_id"))
    some = [pool.where(F.col("y") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    return docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(some[0].unionByName(some[1])), "doc_id")


class Ids(dict):
    """Number of each distinct word, with what `describe` says of it; emptied by `trim` so that a worker's memory stays bounded."""

    def __init__(self, describe: Callable[[bytes], tuple], limit: int = 200_000):
        self.describe, self.limit = describe, limit
        self.rows: list[tuple] = []

    def __missing__(self, word: bytes) -> int:
        self.rows.append(self.describe(word))
        self[word] = n = len(self.rows) - 1
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()
            self.rows.clear()


def numbered_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of an array of texts in lower case (A-Z), the number of each word in its place, and where each text's begin."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    coded = split.values.dictionary_encode()
    words, number = coded.dictionary.view(pa.binary()).to_pylist(), coded.indices.to_numpy()
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    if b"" in words:  # white space at an end of a text
        there = number != words.index(b"")
        number, offsets = number[there], np.concatenate([[0], np.cumsum(there)])[offsets]
    return words, number, offsets


def runs_of(texts: pa.Array, most: int = 4 << 20) -> Iterator[pa.Array]:
    """Parts of an array of about `most` bytes, or of one longer text."""
    group = (np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) - 1) // most
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield texts.slice(a, b - a)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (the splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def platt(s: np.ndarray, y: np.ndarray, steps: int = 100) -> np.ndarray:
    """Weights (columns of s, then a constant) of a logistic regression with Platt's smoothed targets, by damped Newton steps."""
    s = np.asarray(s, float).reshape(len(y), -1)
    mean, spread = s.mean(axis=0), s.std(axis=0) + 1e-9
    x = np.column_stack([(s - mean) / spread, np.ones(len(s))])
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    loss = lambda w: np.logaddexp(0, x @ w).sum() - t @ (x @ w) + 5e-3 * (w @ w)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(len(w)), x.T @ (p - t) + 1e-2 * w)
        rate = 1.0
        while loss(w - rate * step) > loss(w) and rate > 1e-6:
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-6:
            break
    w[:-1] /= spread
    w[-1] -= w[:-1] @ mean
    return w


#: Ids that a broadcast may hold; beyond it the same join is done by a shuffle.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A saved table of few narrow columns, marked for broadcast only if it is counted to be small."""
    return F.broadcast(df) if df.count() <= limit else df


#: A key is hot if it has more rows than both; so there are at most HOT_KEYS hot ones, however large the table.
HOT_ROWS, HOT_KEYS = 1000, 100_000


def hot_keys(df: DataFrame, keys: list[str], name: str) -> DataFrame | None:
    """The keys of a saved table that would bring too many rows to one task of a join (at most HOT_KEYS), or none."""
    bar = max(HOT_ROWS, df.count() // HOT_KEYS)
    hot = saved(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > bar).select(*keys), f"{name}-hot")
    return None if hot.isEmpty() else hot


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, hot: DataFrame | None, name: str) -> DataFrame:
    """`left` joined (inner, left or left_semi) with `right`, which has each key once; `hot` are the hot keys of `left`.

    Rows of hot keys stay where they are and meet the few rows of `right` that they need by a broadcast; others are shuffled.
    """
    if hot is None:
        return left.join(right, keys, how)
    few = saved(right.join(F.broadcast(hot), keys, "left_semi"), f"{name}-few")
    # `few` has hot keys only, so that rows need to be told apart first only where those without a partner stay.
    on_hot = (left.join(F.broadcast(hot), keys, "left_semi") if how == "left" else left).join(F.broadcast(few), keys, how)
    return on_hot.unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, root) of every node of `edges` (a, b): the smallest id reachable.

    Each round takes the least root among a node and its neighbours, then the root of that root; tables are saved each round.
    Centres of stars and roots of large components are hot keys and go by broadcast.
    """
    both = saved(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), f"{name}-edges")
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), f"{name}-labels")
    centres = hot_keys(both, ["b"], name)
    while True:
        near = spread_join(both, labels.withColumnRenamed("id", "b"), ["b"], "inner", centres, name)
        near = near.groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        own = labels.join(near, "id").select("id", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        own = saved(own, f"{name}-near")
        up = own.select(F.col("id").alias("root"), F.col("root").alias("above"))
        up = spread_join(own, up, ["root"], "left", hot_keys(own, ["root"], name), name)
        new = saved(up.select("id", F.least("root", F.coalesce("above", "root")).alias("root"), "was"), f"{name}-labels")
        if new.where("root <> was").isEmpty():
            return new.select("id", "root")
        labels = new.select("id", "root")
