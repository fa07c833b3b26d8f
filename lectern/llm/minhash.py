"""Near-duplicate documents: MinHash with tensored banding, every link confirmed on full shingle sets.

Two collections of SIDE half-keys, each of PER_HALF minimum hashes, are combined in pairs: SIDE * SIDE tables from only
2 * SIDE * PER_HALF minimum hashes (square root of what separate tables need). Documents with equal shingle sets are one
class first. In each table a bucket links its members to its smallest id (a star, never all pairs). Members of a bucket
that are then still in different components are compared in blocks by an exact bound (parity sketches: the sets differ in at
least as many shingles as the sketches in bits); what passes is confirmed on the full sets too, so that no candidate of a
table is lost. Components are found by rounds of joins.

Null and empty texts, and texts without words, have an empty set and stay alone; fewer than five words are one shingle. Rows
that share a doc_id are one node; rows with a null doc_id are kept, alone, with a null component. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import HOT_KEYS, HOT_ROWS, Ids, bounded_batches, components, mixed, saved, sized, text_bytes, tidy

WORDS, PERCENT = 5, 85
SIDE, PER_HALF = 8, 2
SKETCH_BITS = 512
#: Members of a bucket that meet in one block of the comparison by sketches.
BLOCK = 1024
_RNG = np.random.default_rng(20)
SALTS = _RNG.integers(1, 1 << 63, 2 * SIDE * PER_HALF, dtype=np.uint64)
ODD = _RNG.integers(1, 1 << 63, 2 * SIDE * PER_HALF, dtype=np.uint64) | np.uint64(1)
PLACE = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes], ids: Ids) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    split = [t.lower().split() for t in texts]
    numbers = ids.of([w for ws in split for w in ws])
    table = np.array(ids.rows, np.uint64).reshape(-1)
    h, out, at = table[numbers], [], 0
    for ws in split:
        own = h[at : at + len(ws)]
        at += len(ws)
        n = len(ws) - WORDS + 1
        if n > 0:
            s = sum((own[j : j + n] * PLACE[j] for j in range(1, WORDS)), own[:n] * PLACE[0])
        else:
            s = np.array([sum(int(x) * int(p) for x, p in zip(own, PLACE, strict=False)) + len(ws) & (1 << 64) - 1], np.uint64)[: len(ws)]
        out.append(np.unique(mixed(s)))
    ids.trim()
    return out


def word_hash(w: bytes) -> tuple[int]:
    return (xxhash.xxh3_64_intdigest(w),)


def signatures(sets: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Of non-empty sets: both collections of half-keys, a 128-bit fingerprint of the set and its parity sketch."""
    h = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    at = np.cumsum(sizes) - sizes
    low = np.empty((len(sets), len(SALTS)), np.uint64)
    for k, (salt, odd) in enumerate(zip(SALTS, ODD, strict=True)):
        x = (h ^ salt) * odd
        x ^= x >> np.uint64(32)
        low[:, k] = np.minimum.reduceat(x, at)
    half = mixed(low[:, 0::2] * np.uint64(31) + low[:, 1::2])
    bits = np.zeros((len(sets), SKETCH_BITS), np.uint8)
    owner = np.repeat(np.arange(len(sets)), sizes)
    np.add.at(bits, (owner, (h >> np.uint64(55)).astype(np.int64)), 1)
    return {"u": half[:, :SIDE], "v": half[:, SIDE:], "f1": np.add.reduceat(mixed(h ^ np.uint64(1)), at), "f2": np.add.reduceat(mixed(h ^ np.uint64(2)), at), "sketch": np.packbits(bits & 1, axis=1)}


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, n, f1, f2, u, v, sketch) of every row; the last five null for an empty set."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "n", "f1", "f2", "u", "v", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(word_hash)
        for b in batches:
            doc_ids, sets = b.column(0), []
            for some in slices(b.column(1).to_pylist()):
                sets += shingle_sets(some, ids)
            full = [k for k, s in enumerate(sets) if len(s)]
            sig = signatures([sets[k] for k in full]) if full else None
            column = lambda f, t: pa.array([None] * len(sets), t) if not full else pa.array(_spread(f(), full, len(sets)), t)
            longs = lambda k: lambda: sig[k].view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array([len(s) for s in sets], pa.int64()), column(longs("f1"), pa.int64()), column(longs("f2"), pa.int64()), column(longs("u"), pa.list_(pa.int64())), column(longs("v"), pa.list_(pa.int64())), column(lambda: [x.tobytes() for x in sig["sketch"]], pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(tidy(run), "doc_id long, n long, f1 long, f2 long, u array<long>, v array<long>, sketch binary")


def _spread(values: list, at: list[int], n: int) -> list:
    out = [None] * n
    for k, v in zip(at, values, strict=True):
        out[k] = v
    return out


def confirmed(docs: DataFrame, pairs: DataFrame, name: str, percent: int = PERCENT) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets have a Jaccard similarity of `percent` or more. Only documents of a pair are read into sets."""
    bounded_batches(docs.sparkSession)
    pairs = saved(pairs.select("a", "b").distinct(), f"{name}-pairs")
    wanted = saved(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"{name}-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(word_hash)
        for b in batches:
            rows = shingle_sets(b.column(1).to_pylist(), ids)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in rows], pa.list_(pa.int64()))], names=["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).join(sized(wanted), "doc_id").select("doc_id", "text")
    sets = saved(texts.mapInArrow(tidy(run), "id long, shingles array<long>"), f"{name}-sets")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("total"))
    return saved(both.where(f"100L * common >= {percent}L * (total - common)").select("a", "b").distinct(), f"{name}-links")


def near_in_blocks(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of members (key, id, n, sketch, root, g) of a key with different roots, but for those that a bound excludes.

    A key with g members is dealt over blocks of BLOCK; a pair of blocks is one group of at most about 2 * BLOCK rows.
    """
    cells = F.ceil(F.col("g") / BLOCK).cast("int")
    dealt = members.withColumn("cells", cells).withColumn("own", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "sketch", "root")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        held: list[np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 4, 5, 7)]
            cols.append(np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint64).reshape(b.num_rows, -1))
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            change = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            cuts = [0, *change.tolist()]
            for a, z in zip(cuts, cuts[1:]):
                yield tuple(x[a:z] for x in cols)
            held = [x[cuts[-1] :] for x in cols]
        if held is not None:
            yield tuple(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for _, i, j, own, ids, n, root, sketch in blocks(batches):
            rows = np.arange(len(ids))
            first, second = (rows, rows) if i[0] == j[0] else (rows[own == i[0]], rows[own == j[0]])
            for at in range(0, len(first), 64):
                f = first[at : at + 64]
                differ = np.bitwise_count(sketch[f][:, None] ^ sketch[second][None]).sum(axis=2, dtype=np.int64)
                total = n[f][:, None] + n[second][None]
                near = ((100 + percent) * differ <= (100 - percent) * total) & (root[f][:, None] != root[second][None])
                if i[0] == j[0]:
                    near &= ids[f][:, None] < ids[second][None]
                x, y = np.nonzero(near)
                if len(x):
                    found.append((ids[f[x]], ids[second[y]]))
            if sum(len(x) for x, _ in found) > 50_000:
                yield _pairs(found)
                found = []
        if found:
            yield _pairs(found)

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(tidy(run), "a long, b long")


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    x, y = (np.concatenate(z) for z in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; sets are linked from a Jaccard similarity of `percent`."""
    rows = saved(sketched(docs.select("doc_id", "text")), "minhash-rows")
    usable = rows.where("n > 0 and doc_id is not null")
    # One representative of each distinct set: the smallest id (what goes with it is equal for equal sets).
    least = usable.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    classes = saved(least, "minhash-classes")
    reps = usable.join(classes.select("f1", "f2", F.col("id").alias("doc_id")), ["f1", "f2", "doc_id"], "left_semi").dropDuplicates(["f1", "f2"])
    reps = saved(reps.select(F.col("doc_id").alias("id"), "n", "u", "v", "sketch"), "minhash-reps")
    tables = F.expr("flatten(transform(u, (x, i) -> transform(v, (y, j) -> xxhash64(x, y, i, j))))")
    buckets = reps.select("id", "n", F.explode(tables).alias("key"))
    head = F.min(F.struct("id", "n"))
    shared = buckets.groupBy("key").agg(head["id"].alias("a"), head["n"].alias("m"), F.count("*").alias("g")).where("g > 1")
    shared = saved(shared, "minhash-buckets")
    # Buckets of a share of all rows are few (at most HOT_KEYS) and meet their members by broadcast, not in one task each.
    bar = max(HOT_ROWS, SIDE * SIDE * reps.count() // HOT_KEYS)
    large = F.broadcast(saved(shared.where(F.col("g") > bar), "minhash-large"))
    small = buckets.join(large.select("key"), "key", "left_anti").join(shared.where(F.col("g") <= bar), "key")
    inside = saved(buckets.join(large, "key").unionByName(small), "minhash-members")
    stars = inside.where("id <> a").select("a", F.col("id").alias("b"), "n", "m").distinct()
    links = confirmed(docs, stars.where(f"100L * least(n, m) >= {percent}L * greatest(n, m)"), "minhash-star", percent)
    roots = components(links, "minhash-star")
    placed = inside.where("g > 2 and id <> a").select("key", "id", "g").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed_keys = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("g").alias("g")).where("x <> y")
    mixed_keys = saved(mixed_keys.select("key", "g"), "minhash-mixed")
    in_large = placed.where(F.col("g") > bar).join(F.broadcast(mixed_keys.where(F.col("g") > bar).select("key")), "key", "left_semi")
    in_small = placed.where(F.col("g") <= bar).join(mixed_keys.where(F.col("g") <= bar).select("key"), "key", "left_semi")
    rest = in_large.unionByName(in_small).join(reps.select("id", "n", "sketch"), "id")
    more = saved(near_in_blocks(rest.select("key", "id", "n", "sketch", "root", "g"), percent).distinct(), "minhash-rest")
    if not more.isEmpty():
        roots = components(links.unionByName(confirmed(docs, more, "minhash-rest", percent)), "minhash-all")
    place = classes.join(roots, "id", "left").select("f1", "f2", F.coalesce("root", "id").alias("component_id"))
    lone = rows.where("f1 is null or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    linked = usable.select("doc_id", "n", "f1", "f2").join(place, ["f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(lone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
