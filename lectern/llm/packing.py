"""Packing documents into sequences of at most CAPACITY tokens: patterns fitted to the histogram of lengths.

Documents are tokenised word by word with a cache; longer ones are cut into pieces. The histogram of piece lengths (at most
CAPACITY numbers) is all that the driver sees. Patterns of few lengths that fill a sequence are enumerated, their repeat
counts are fitted to the histogram by non-negative least squares and rounded down, and what is left is packed best-fit on
the histogram, again as patterns with counts. The pieces of one length are ranked by salted groups, and a piece's rank gives
its pattern, its sequence and its place: the plan's size depends on CAPACITY, not on the data.

Null texts count as empty (only the end id). Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, release, runs_of, saved, sized, tidy

CAPACITY, END_ID = 2048, 0
#: Most patterns that are fitted, and the sweeps of the fit.
PATTERNS, SWEEPS = 6000, 40
#: Pieces of one length that one salted group ranks, on average at most.
GROUP = 50_000


#: Words of lower-case Latin letters, which the tokenizer neither changes nor splits before it merges, with at most one closing
#: mark, which is a token of its own by the tokenizer's pattern.
_PLAIN, _MARK = "^[a-zß-öø-ÿ]+[.,;:!?]?$", "([.,;:!?])$"
#: Begins the strings of special tokens; they are matched before lower-casing.
_SPECIAL = "<|"
#: Words that are merged in one call.
_TOGETHER = 4000


class WordTokens:
    """Ids of whole texts by a tokenizer file, word by word; no token of such a file spans ASCII white space.

    The tokenizer lower-cases, so words are looked up in lower case; texts that may hold a special token are left as they
    are. Each distinct word of a slice of texts is looked up once; beyond `limit` words the cache starts anew.
    """

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id ends a word or mark.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for t, n in vocabulary.items() if t.endswith("</w>")]] = True
        self.limit = limit
        self._emptied()

    def _emptied(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sizes, self.flat = array("q"), array("H")

    def _merged(self, words: pa.Array) -> None:
        """Number words that are not known, and keep their ids."""
        is_plain = pc.match_substring_regex(words, _PLAIN)
        plain, other = words.filter(is_plain), words.filter(pc.invert(is_plain))
        for at in range(0, len(plain), _TOGETHER):
            some = plain.slice(at, _TOGETHER)
            apart = pc.replace_substring_regex(some, _MARK, r" \1")
            ids = np.array(self.plain.encode(" ".join(apart.to_pylist()), add_special_tokens=False).ids, np.uint16)
            # A word has one end, and a second one if it has a mark.
            lengths = [pc.binary_length(x).to_numpy() for x in (some, apart)]
            last = np.flatnonzero(self.ends[ids])[np.cumsum(1 + lengths[1] - lengths[0]) - 1]
            self._kept(some, np.diff(last, prepend=-1), ids)
        rest = other.view(pa.binary()).to_pylist()
        for at in range(0, len(rest), _TOGETHER):
            some = rest[at : at + _TOGETHER]
            got = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)]
            self._kept(other.slice(at, _TOGETHER), np.array([len(x) for x in got]), np.fromiter(chain.from_iterable(got), np.uint16))

    def _kept(self, words: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.sizes)
        self.known.update(zip(words.view(pa.binary()).to_pylist(), range(n, n + len(words)), strict=True))
        self.sizes.frombytes(sizes.astype(np.int64).tobytes())
        self.flat.frombytes(ids.tobytes())

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array one after another, and where each text's ids begin (and the last ends)."""
        if len(self.known) > self.limit:
            self._emptied()
        texts = pc.if_else(pc.match_substring(texts, _SPECIAL), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        coded = split.values.dictionary_encode()
        words = coded.dictionary.view(pa.binary()).to_pylist()
        found = list(map(self.known.get, words))
        if missing := [k for k, x in enumerate(found) if x is None]:
            self._merged(coded.dictionary.take(pa.array(missing)))
            for k in missing:
                found[k] = self.known[words[k]]
            if 2 * len(missing) >= _TOGETHER:  # merging leaves much that is freed, but held by the worker
                release()
        number = np.array(found, np.int64)[coded.indices.to_numpy()] if found else np.zeros(0, np.int64)
        size = np.array(self.sizes, np.int64)
        sizes = size[number]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.array(self.flat, np.uint16)[np.repeat((np.cumsum(size) - size)[number] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[split.offsets.to_numpy() - split.offsets[0].as_py()]


@lru_cache(2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            texts = b.column(1)
            row = 0
            for some in runs_of(texts):
                ids, ends = word_tokens(path).ids(some)
                for lo, hi in zip(ends.tolist(), ends[1:].tolist()):
                    own = np.append(ids[lo:hi].astype("<u4"), np.uint32(END_ID))
                    for k, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        at.append(row)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                    row += 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def candidate_patterns(h: np.ndarray, capacity: int, seed: int = 11) -> list[tuple[int, ...]]:
    """Distinct patterns, longest first, that fill a sequence exactly: all pairs, and sets of three to six drawn by the histogram."""
    there = np.flatnonzero(h)
    out = {(capacity,)} if h[capacity] else set()
    out |= {(int(max(a, capacity - a)), int(min(a, capacity - a))) for a in there if a < capacity and h[capacity - a]}
    rng = np.random.default_rng(seed)
    odds = h[there] / h.sum()
    for size in (3, 4, 5, 6):
        drawn = rng.choice(there, (4 * PATTERNS, size - 1), p=odds)
        last = capacity - drawn.sum(axis=1)
        good = (last > 0) & (h[np.clip(last, 0, capacity)] > 0)
        rows = -np.sort(-np.column_stack([drawn, last])[good], axis=1)
        for r in rows:
            if len(out) >= PATTERNS * (size - 1) // 5:
                break
            out.add(tuple(map(int, r)))
    return sorted(out, reverse=True)


def fitted_counts(patterns: list[tuple[int, ...]], h: np.ndarray) -> np.ndarray:
    """Non-negative least squares by coordinate descent: repeat counts whose sum of patterns comes nearest to the histogram."""
    left = h.astype(float)
    cells = [np.unique(p, return_counts=True) for p in patterns]
    x = np.zeros(len(patterns))
    for _ in range(SWEEPS):
        moved = 0.0
        for j, (at, times) in enumerate(cells):
            new = max(0.0, x[j] + (left[at] @ times) / (times @ times))
            if new != x[j]:
                left[at] -= (new - x[j]) * times
                moved = max(moved, abs(new - x[j]))
                x[j] = new
        if moved < 0.5:
            break
    return x


def plan(h: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use each length exactly as often as the histogram h (by length) has it."""
    left = h.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if not left.sum():
        return out
    patterns = candidate_patterns(h, capacity)
    for j in np.argsort(-(counts := fitted_counts(patterns, h)), kind="stable"):
        at, times = np.unique(patterns[j], return_counts=True)
        n = int(min(counts[j], (left[at] // times).min()))
        if n:
            left[at] -= n * times
            out.append((patterns[j], n))
    there = np.flatnonzero(left)
    while len(there):
        used: dict[int, int] = {}
        pattern, room = [], capacity
        k = len(there)
        while k:
            k = int(np.searchsorted(there[:k], room, side="right"))
            while k and left[there[k - 1]] <= used.get(int(there[k - 1]), 0):
                k -= 1
            if k:
                a = int(there[k - 1])
                n = min(room // a, int(left[a]) - used.get(a, 0))
                pattern += [a] * n
                used[a] = used.get(a, 0) + n
                room -= n * a
        n = min(int(left[a]) // c for a, c in used.items())
        for a, c in used.items():
            left[a] -= n * c
        out.append((tuple(pattern), n))
        there = there[left[there] > 0]
    return out


def places(chosen: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: a run of ranks of a length for each place of a pattern."""
    rows, next_rank, sequence = [], {}, 0
    for pattern, n in chosen:
        offset = 0
        for a in pattern:
            rank = next_rank.get(a, 0)
            rows.append((a, rank, sequence, offset))
            next_rank[a] = rank + n
            offset += a
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (a saved table with doc_id, piece, length) with `sequence_id` and `offset`."""
    spark = parts.sparkSession
    h = np.zeros(capacity + 1, np.int64)
    for r in parts.groupBy("length").count().collect():  # at most `capacity` rows
        h[r["length"]] = r["count"]
    table = places(plan(h, capacity))
    salts = 16 + int(h.sum()) // GROUP
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = saved(sizes.select("length", "salt", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")), "before")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("own", own).join(sized(before, 200_000), ["length", "salt"])
    ranked = ranked.select(*parts.columns, (F.col("own") + F.col("before")).alias("rank"))
    shared = spark.sparkContext.broadcast(table)  # bounded by the number of patterns
    fields = parts.columns

    def run(batches):
        t = shared.value
        key = (t[:, 0] << 44) | t[:, 1]
        for b in batches:
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            k = np.searchsorted(key, (b.column("length").to_numpy(zero_copy_only=False) << 44) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in fields], pa.array(t[k, 2] + rank - t[k, 1]), pa.array(t[k, 3])], names=[*fields, "sequence_id", "offset"])

    return ranked.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in parts.dtypes) + ", sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All rows of (doc_id, text) as pieces with their places."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return packed(saved(pieces(docs, path), "pieces"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
