"""Prefix trie of conversations: for each distinct beginning of turns, who shares it and what keeping it once saves.

A turn is known by a digest of (role, text), 128 bits, so texts are never shuffled. Conversations, as rows of digests, are
dealt by ranges of (digests, conv_id), so that equal conversations and common first turns, however many, fall to as many
shards as their number needs. A shard is a padded matrix of turn ids, in blocks of WIDTH columns: numpy's lexsort orders it, the
change masks of neighbours, OR-accumulated along the columns, mark where the nodes of each depth start, and reduceat
aggregates every depth from the deepest up. Nodes on the path of a shard's first or last row may go on in other shards: the two
rows are passed on with their shares of these nodes, and the same step over all shards' boundary rows (shards of them, if they are
many) recombines them. Each node counts itself in its subtree's sums where it is complete.

The sorted ids of the conversations that end at a node are one digest, which can only be computed in order: for nodes that
lie in several shards, each shard joins its ids to a text, and one task passes over these texts in order, a batch at a time.

Turns are ordered by turn (null first), then by digest, so ties and repeated rows have a defined order and count each. Null
roles and texts are empty. Rows without conv_id belong to no conversation. Very long texts are digested where they are read; a
conversation of very many turns is one row of 40 bytes a turn in its task. Further columns play no part. An empty table gives no
rows, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, saved, sized, spread_join, tidy

#: Bytes of a turn's digest, columns of a block of the padded matrix, and turns of a shard on average at most.
DIGEST, WIDTH, SHARD_TURNS = 16, 16, 300_000
FAMILY, MOST_HEAD = 5, 9
NOBODY = np.iinfo(np.int64).max
EMPTY = hashlib.sha256(b"").hexdigest()
STATS = ["n", "least", "kids", "leaves", "saved", "size"]
NODE = [("conv_id", "long"), ("depth", "long"), ("parent_conv_id", "long"), ("parent_key", "binary"), ("key", "binary"), ("n_convs", "long"), ("n_children", "long"), ("n_leaves", "long"), ("saved_tokens", "long"), ("ends_sha256", "string")]
PASSED = [("path", "binary"), ("at", "long"), *[(s, "array<long>") for s in STATS]]
ENDS = [("shard", "long"), ("ids", "binary")]
SCHEMA = ", ".join(f"{n} {t}" for n, t in [("kind", "string"), *NODE, *PASSED, *ENDS])
ARROW = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


@dataclass
class Rows:
    """Rows of turn digests with, for each depth from 0 to the row's length, its shares of the node there.

    `digest` has the two halves of all turns, `length` the turns of each row, `at` breaks ties of equal rows.
    """

    digest: np.ndarray
    length: np.ndarray
    at: np.ndarray
    stats: dict[str, np.ndarray]


def _paths(column: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    length = np.concatenate([np.diff(np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, 4 * c.offset)) if len(c) else np.zeros(0, np.int32) for c in column]) // DIGEST
    held = b"".join(b"".join(c.to_pylist()) for c in column)
    return np.frombuffer(held, ">u8").reshape(-1, 2).astype(np.uint64), length.astype(np.int64)


def conversation_rows(batches: list[pa.RecordBatch]) -> Rows:
    """From (conv_id, path, sizes): each conversation is one member of all nodes on its path."""
    digest, length = _paths([b.column(1) for b in batches])
    conv = np.concatenate([b.column(0).to_numpy() for b in batches])
    root = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    size = np.zeros(int((length + 1).sum()), np.int64)
    inner = np.ones(len(size), bool)
    inner[root] = False
    size[inner] = np.concatenate([b.column(2).flatten().to_numpy() for b in batches])
    none = np.zeros_like(size)
    return Rows(digest, length, conv, {"n": none + 1, "least": np.repeat(conv, length + 1), "kids": none, "leaves": none, "saved": none, "size": size})


def passed_rows(batches: list[pa.RecordBatch]) -> Rows:
    digest, length = _paths([b.column(0) for b in batches])
    at = np.concatenate([b.column(1).to_numpy() for b in batches])
    return Rows(digest, length, at, {s: np.concatenate([b.column(2 + k).flatten().to_numpy() for b in batches]) for k, s in enumerate(STATS)})


def _ids(digest: np.ndarray) -> np.ndarray:
    """Numbers from 1 in the order of the digests."""
    if not len(digest):
        return np.zeros(0, np.int64)
    order = np.lexsort((digest[:, 1], digest[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (digest[order[1:]] != digest[order[:-1]]).any(axis=1)
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new)
    return ids


def _block(ids: np.ndarray, begin: np.ndarray, length: np.ndarray, rows: np.ndarray, s: int) -> np.ndarray:
    """Columns s .. s + WIDTH of the padded matrix for some rows; rows that have ended have zeros."""
    columns = s + np.arange(WIDTH)
    there = columns < length[rows, None]
    return np.where(there, ids[np.where(there, begin[rows, None] + columns, 0)] if len(ids) else 0, 0)


def sorted_rows(r: Rows) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows (digests, shorter first, then `at`), and for each row in it the first depth at which it differs from
    the row before (its length + 1 if it doesn't)."""
    n, ids = len(r.length), _ids(r.digest)
    begin = np.concatenate([[0], np.cumsum(r.length)[:-1]]).astype(np.int64)
    rank = np.zeros(n, np.int64)  # the number of rows of earlier groups
    longest = int(r.length.max(initial=0))
    for s in range(0, longest, WIDTH):
        act = np.flatnonzero(r.length > s)
        ended = np.bincount(rank[r.length <= s], minlength=n)
        m = _block(ids, begin, r.length, act, s)
        o = np.lexsort([*m.T[::-1], rank[act]])
        m, before = m[o], rank[act][o]
        group = np.ones(len(o), bool)
        group[1:] = before[1:] != before[:-1]
        part = group.copy()
        part[1:] |= (m[1:] != m[:-1]).any(axis=1)
        first = np.maximum.accumulate(np.where(group, np.arange(len(o)), 0))
        start = np.maximum.accumulate(np.where(part, np.arange(len(o)), 0))
        rank[act[o]] = before + ended[before] + start - first
    order = np.lexsort((r.at, rank))
    begin, length = begin[order], r.length[order]
    fresh, changed = length + 1, np.zeros(n, bool)
    for s in range(0, longest, WIDTH):
        act = np.flatnonzero((length > s) & ~changed)
        act = act[act > 0]
        differ = _block(ids, begin, length, act, s) != _block(ids, begin, length, act - 1, s)
        marks = np.logical_or.accumulate(differ, axis=1)
        same = WIDTH - marks.sum(axis=1)
        fresh[act] = np.where(same < WIDTH, s + same + 1, fresh[act])
        changed[act] = same < WIDTH
    fresh[0] = 0
    return order, fresh


def _keys(digest: np.ndarray) -> list[bytes]:
    """A key for each beginning of a path, the empty one included."""
    h, out = hashlib.sha256(), []
    out.append(h.digest()[:DIGEST])
    for turn in digest.astype(">u8"):
        h.update(turn.tobytes())
        out.append(h.digest()[:DIGEST])
    return out


def fold(r: Rows, shard: int, whole: bool, conversations: bool) -> Iterator[dict[str, list]]:
    """Complete nodes, boundary rows and ids of boundary nodes of one shard; all nodes are complete if it is the `whole` table."""
    n = len(r.length)
    order, fresh = sorted_rows(r)
    begin = np.concatenate([[0], np.cumsum(r.length)[:-1]]).astype(np.int64)[order]
    entry = np.concatenate([[0], np.cumsum(r.length + 1)[:-1]]).astype(np.int64)[order]
    length, at = r.length[order], r.at[order]
    path = lambda i: r.digest[begin[i] : begin[i] + length[i]]
    key_of = lru_cache(None)(lambda i: _keys(path(i)))
    first_keys, last_keys = key_of(0), key_of(n - 1)
    shared = int(fresh[1:].min(initial=length[0] + 1)) - 1 if n > 1 else int(length[0])  # depth to which first and last row agree
    shared = min(shared, int(length[0]))
    ends = _ends(at, length, fresh) if conversations else {}
    by_length = np.argsort(-length, kind="stable")
    leaves_at, saved_at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    kids_at = np.zeros(n, np.int64)
    mine = {0: [[] for _ in STATS], n - 1: [[] for _ in STATS]}
    waiting: tuple[np.ndarray, dict[str, list]] | None = None
    for d in range(int(length[by_length[0]]), -1, -1):
        act = np.sort(by_length[: int(np.searchsorted(-length[by_length], -d, "right"))])
        e = entry[act] + d
        st = np.flatnonzero(fresh[act] <= d)
        total = lambda values: np.add.reduceat(values, st)
        count, least, size = total(r.stats["n"][e]), np.minimum.reduceat(r.stats["least"][e], st), r.stats["size"][e][st]
        kids, leaves, kept = total(r.stats["kids"][e] + kids_at[act]), total(r.stats["leaves"][e] + leaves_at[act]), total(r.stats["saved"][e] + saved_at[act])
        rows = act[st]
        open_ = np.zeros(len(st), bool)
        if not whole:
            open_[0] |= d <= length[0]
            open_[-1] |= d <= length[-1]
        if waiting is not None:  # the nodes below, whose parents are these
            above = np.searchsorted(rows, waiting[0], "right") - 1
            known = ~open_[above]
            key = lambda i: first_keys[d] if i == 0 and d <= length[0] else last_keys[d]
            waiting[1]["parent_conv_id"] = [int(least[a]) if k else None for a, k in zip(above, known)]
            waiting[1]["parent_key"] = [None if k else key(a) for a, k in zip(above, known)]
            yield waiting[1]
        done = ~open_
        leaf = done & (kids == 0)
        own = np.where(done, (count - 1) * size, 0)
        leaves, kept = leaves + leaf, kept + own
        kids_at[:] = 0
        kids_at[rows[done]] = 1
        leaves_at[rows] += leaf
        saved_at[rows] += own
        waiting = None
        if done.any():
            i = np.flatnonzero(done)
            hashes = [hashlib.sha256(ends[x]).hexdigest() if x in ends and length[x] == d else EMPTY for x in rows[i].tolist()] if conversations else [None] * len(i)
            keys = [None] * len(i) if conversations else [key_of(x)[d] for x in rows[i].tolist()]
            waiting = rows[i], {"kind": ["node"] * len(i), "conv_id": least[i].tolist(), "depth": [d] * len(i), "key": keys, "n_convs": count[i].tolist(), "n_children": kids[i].tolist(), "n_leaves": leaves[i].tolist(), "saved_tokens": kept[i].tolist(), "ends_sha256": hashes}
        for j in {0, len(st) - 1} if open_.any() else ():
            if not open_[j]:
                continue
            on_first = j == 0 and d <= length[0]
            share = [x[j] for x in (count, least, kids, leaves, kept, size)]
            if conversations and length[rows[j]] == d:
                yield {"kind": ["ends"], "key": [first_keys[d] if on_first else last_keys[d]], "shard": [shard], "ids": [ends[int(rows[j])]]}
            for k, v in enumerate(share):
                mine[0 if on_first else n - 1][k].append(int(v))
    if waiting is not None:  # the root
        waiting[1]["parent_conv_id"] = waiting[1]["parent_key"] = [None] * len(waiting[0])
        yield waiting[1]
    if not whole:
        for side, i in enumerate((0, n - 1) if shared < length[n - 1] else (0,)):
            values = [x[::-1] for x in mine[i]]
            if side:  # what both share is in the first row
                values = [[NOBODY if s == "least" else 0] * (shared + 1) + x for s, x in zip(STATS, values)]
            yield {"kind": ["row"], "path": [path(i).astype(">u8").tobytes()], "at": [2 * shard + side], **{s: [x] for s, x in zip(STATS, values)}}


def _ends(conv: np.ndarray, length: np.ndarray, fresh: np.ndarray) -> dict[int, bytes]:
    """For the first row of each run of equal ones, the ids of the run."""
    starts = np.flatnonzero(fresh <= length)
    text = list(map(str, conv.tolist()))
    return {a: ",".join(text[a:b]).encode() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(conv)])}


def _batch(values: dict[str, list]) -> pa.RecordBatch:
    count = len(values["kind"])
    columns = [("kind", "string"), *NODE, *PASSED, *ENDS]
    return pa.RecordBatch.from_arrays([pa.array(values.get(n, [None] * count), ARROW[t]) for n, t in columns], names=[n for n, _ in columns])


def _step(whole: bool, conversations: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    read = conversation_rows if conversations else passed_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from map(_batch, fold(read(held), TaskContext.get().partitionId(), whole, conversations))

    return tidy(run)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): the head of the conversation's family (its id less the remainder by FAMILY), then its own rest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    conv = F.col("conv_id").cast("long")
    rows = conversations.select(conv.alias("conv_id"), (conv - conv % FAMILY).alias("base"), F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    # One exchange by family serves the grouping and the window.
    own = rows.where("conv_id is not null").repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    head = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, MOST_HEAD)), ignorenulls=True).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string")) % MOST_HEAD).cast("int")
    kept = lambda c: F.slice(c, F.lit(1), h)
    turns = F.concat(F.coalesce(kept(head), kept(F.slice("own", 1, 0))), F.slice("own", h + 1, F.size("own")))
    out = own.select("conv_id", turns.alias("turns"))
    return out.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def _ended(texts: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes whose ids lie in several shards: one pass over a key's texts in the order of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256(ids)
                else:
                    h.update(b"," + ids)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([x for _, x in done])], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], names=["key", "ends_sha256"])

    ordered = texts.select("key", "shard", "ids").repartition("key").sortWithinPartitions("key", "shard")
    return ordered.mapInArrow(run, "key binary, ends_sha256 string")


def trie(paths: DataFrame) -> DataFrame:
    """The nodes of a saved table of conversations (conv_id, path, sizes)."""
    spark = paths.sparkSession
    turns = paths.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, turns // SHARD_TURNS + 1)
    step = saved(paths.repartitionByRange(shards, "path", "conv_id").select("conv_id", "path", "sizes").mapInArrow(_step(False, True), SCHEMA), "trie-shards")
    texts = step.where("kind = 'ends'").select("key", "shard", "ids")
    names = [n for n, _ in NODE]
    low, high = step.where("kind = 'node'").select(names), []
    while True:
        rows = step.where("kind = 'row'").select([n for n, _ in PASSED])
        held = rows.agg(F.count("*").alias("n"), F.sum(F.size("n")).alias("turns")).first()
        # Eight rows of a shard or more become two.
        shards = min((held["turns"] or 0) // SHARD_TURNS + 1, max(1, held["n"] // 8))
        whole = shards == 1
        dealt = rows.coalesce(1) if whole else rows.repartitionByRange(shards, "path", "at")
        step = saved(dealt.mapInArrow(_step(whole, False), SCHEMA), "trie-boundaries")
        high.append(step.where("kind = 'node'").select(names))
        if whole:
            break
    upper = high[0]
    for more in high[1:]:
        upper = upper.unionByName(more)
    ended = _ended(texts).withColumnRenamed("ends_sha256", "_ends")
    upper = saved(upper.join(ended, "key", "left").withColumn("ends_sha256", F.coalesce("_ends", F.lit(EMPTY))).select(names), "trie-upper")
    parents = saved(upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent")), "trie-parents")
    nodes = low.unionByName(upper)
    below, small = nodes.where("parent_key is not null"), sized(parents)
    found = below.join(small, "parent_key") if small is not parents else spread_join(below, parents, ["parent_key"], "inner", hot_keys(below, ["parent_key"], "trie"), "trie")
    nodes = nodes.where("parent_key is null").withColumn("_parent", F.lit(None).cast("long")).unionByName(found)
    return nodes.select("conv_id", "depth", F.coalesce("parent_conv_id", "_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return trie(saved(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-paths"))


_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda i: 0::BIGINT)), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT)"""

ORACLE = f"""
WITH t AS (SELECT conv_id, turn, strlen(coalesce(text, '')) AS size,
        sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))[1:32] AS k FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT conv_id, list({{'k': k, 'size': size}} ORDER BY turn NULLS FIRST, k, size) AS ts, {_CRC} % 9 AS h FROM t GROUP BY conv_id),
    r AS (SELECT o.conv_id, list_concat(coalesce(b.ts[1:o.h], []), o.ts[o.h + 1:]) AS ts FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 5),
    p AS (SELECT conv_id, d, list_transform(ts[1:d], lambda x: x.k) AS path, len(ts) = d AS last, CASE WHEN d > 0 THEN ts[d].size ELSE 0 END AS size
        FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM r)),
    nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM p GROUP BY path, d),
    kids AS (SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
    sums AS (SELECT top AS path, count(*) FILTER (n_children = 0) AS leaves, sum((n - 1) * size)::BIGINT AS saved
        FROM (SELECT v.*, coalesce(k.n, 0) AS n_children, unnest(list_transform(range(0, v.d + 1), lambda i: v.path[1:i])) AS top FROM nodes v LEFT JOIN kids k ON k.path = v.path) GROUP BY top)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, v.ends AS ends_sha256
FROM nodes v JOIN sums s ON s.path = v.path LEFT JOIN kids k ON k.path = v.path LEFT JOIN nodes u ON v.d > 0 AND u.path = v.path[1:v.d - 1] AND u.d = v.d - 1
"""
