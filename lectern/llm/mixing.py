"""Mixing sources to target weights: how often each document is taken so that each source yields its share of words.

Sizes are words. The sources' targets are a share of all sizes by weight; a target stops at REPEATS times its source's size, and
the excess goes to the others by weight until none is above. A source takes whole passes over its documents as long as they
fit (one of at most two, as REPEATS is 2); the budget that is left is fitted on the source's histogram, the number of documents of each exact size:
each size gives its part of the budget, rounded down, then larger sizes first one more where it fits, and what remains is
fitted by a bounded knapsack over what the sizes have left (dynamic programming over the sums that can be reached), so that the
sum is as near the budget as documents of the source can make it there. Which documents of a size are taken is drawn by a
seeded hash of doc_id.

A task of the fit holds the histogram of one source, whose rows are distinct sizes, not documents. Drawing k of the n documents
of a size sorts hashes in about sqrt(n) bins of about sqrt(n) documents, so that a source or size with a third of all rows is
not sorted by one task. Reruns agree, whatever the partitioning.

Null texts and texts without words have size 0 and are taken as 0 words. A null source is a source, the last. Rows that share a
doc_id are documents of their own; equal ones are told apart by their size only, so the result is the same in any order. Very
long texts are counted whole where they are read, and only sizes travel. Further columns play no part. An empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, saved, sized, spread_join
from .places import placed

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in their order, repeating; the mix's size as a share of all sizes; how often a document may be taken.
WEIGHTS, SHARE, REPEATS = (5.0, 2.0, 1.0), 1.5, 2
SEED = 20
#: Sizes of which a document that was already given may be given back, so that small sums can be reached, and the words up to
#: which that goes on; with the largest size they bound what the knapsack holds.
GIVEN_BACK, BACK_WORDS = 64, 1 << 20


def targets(sources: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """A saved table of sources (_s, place, source_size) with `target`. Each round is one aggregate; a source stays capped."""
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.col("place") % len(weights))
    rows = sources.withColumn("w", weight)
    cap = REPEATS * F.col("source_size").cast("double")
    first = rows.agg(F.sum("source_size").alias("all"), F.sum("w").alias("w")).first()
    rate, capped = share * (first["all"] or 0) / (first["w"] or 1.0), 0
    while True:
        above = cap < F.col("w") * rate
        now = rows.agg(F.count_if(above).alias("n"), F.sum(F.when(above, cap)).alias("fixed"), F.sum(F.when(~above, F.col("w"))).alias("w")).first()
        if not now["w"] or now["n"] == capped:
            break
        rate, capped = (share * first["all"] - (now["fixed"] or 0.0)) / now["w"], now["n"]
    return rows.withColumn("target", F.least(cap, F.col("w") * F.lit(float(rate)))).drop("w")


def fitted(size: np.ndarray, count: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each size (distinct, positive) to take, at most `count`, so that their words come near `budget`."""
    total = int((size * count).sum())
    want = min(max(int(round(budget)), 0), total)
    if not total or want == total:
        return count.copy() if want else np.zeros_like(count)
    take = np.array([int(c) * want // total for c in count], np.int64)
    rest = want - int((size * take).sum())
    for i in np.argsort(-size):
        if 0 < size[i] <= rest and take[i] < count[i]:
            take[i] += 1
            rest -= int(size[i])
    for i in np.argsort(size)[:GIVEN_BACK]:
        if take[i] and rest + size[i] <= BACK_WORDS:
            take[i] -= 1
            rest += int(size[i])
    return take + knapsack(size, count - take, rest)


def knapsack(size: np.ndarray, left: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size, at most `left`, have the sum nearest to `budget` (the lower one of two).

    Counts are cut into parts of 1, 2, 4 .. documents. For each sum the first part that reaches it is kept; the sum without
    that part was reached by earlier parts only, so that the way back uses each part once. It ends when the budget is reached.
    """
    out = np.zeros_like(left)
    most = min(2 * budget, budget + int(size[left > 0].max(initial=0)))  # beyond, 0 or a sum without one document is as near
    reached, by = np.zeros(most + 1, bool), np.full(most + 1, -1, np.int32)
    reached[0] = True
    parts: list[tuple[int, int]] = []
    for i in np.argsort(-size):
        n, k = int(min(left[i], most // size[i])), 1
        while n > 0 and not reached[budget]:
            k = min(k, n)
            w = k * int(size[i])
            new = np.flatnonzero(reached[: most + 1 - w] & ~reached[w:]) + w
            reached[new], by[new] = True, len(parts)
            parts.append((int(i), k))
            n, k = n - k, 2 * k
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, k = parts[by[at]]
        out[i] += k
        at -= k * int(size[i])
    return out


PLAN = "_s string, size long, n long, source_size long, target double, passes long, extra long"


def _plan(hist: pd.DataFrame) -> pd.DataFrame:
    """The histogram of one source (size, n, and its target) with whole passes and the documents of each size to take once more."""
    hist = hist.sort_values("size").reset_index(drop=True)
    all_, target = int(hist.source_size.iloc[0]), float(hist.target.iloc[0])
    passes = min(int(target // all_), REPEATS) if all_ else 0
    extra = np.zeros(len(hist), np.int64)
    if all_ and passes < REPEATS:
        there = hist["size"].to_numpy() > 0
        extra[there] = fitted(hist["size"].to_numpy()[there], hist["n"].to_numpy()[there], target - passes * all_)
    return hist.assign(passes=passes, extra=extra)[[x.split()[0] for x in PLAN.split(", ")]]


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str, name: str) -> DataFrame:
    """`right`, saved, has each key once: broadcast if few, else by a shuffle around hot keys."""
    small = sized(right)
    return left.join(small, keys, how) if small is not right else spread_join(left, right, keys, how, hot_keys(left, keys, name), name)


def mixed_documents(docs: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED, size: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of (doc_id, source, text)."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long") if size is None else size
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    rows = saved(docs.select("doc_id", F.col("source").cast("string").alias("source"), key.alias("_s"), words.alias("size")), "mix-sizes")
    hist = saved(rows.groupBy("source", "_s", "size").agg(F.count("*").alias("n")), "mix-histogram")
    sources = saved(hist.groupBy("source", "_s").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "mix-sources")
    sources = placed(sources, [F.col("source").asc_nulls_last()], "place", "mix-sources")
    sources = saved(targets(sources, share, weights).select("_s", "source_size", "target"), "mix-targets")
    plan = saved(_join(hist.select("_s", "size", "n"), sources, ["_s"], "inner", "mix-goals").groupBy("_s").applyInPandas(_plan, PLAN), "mix-plan")
    number = F.xxhash64(F.lit(seed), F.col("doc_id")).bitwiseAND(F.lit((1 << 52) - 1))
    bins = F.ceil(F.sqrt("n"))
    dealt = _join(rows.drop("source"), plan, ["_s", "size"], "inner", "mix-dealt").withColumn("_h", number)
    dealt = saved(dealt.withColumn("_bin", F.floor(F.col("_h") / F.lit(float(1 << 52)) * bins).cast("long")), "mix-dealt")
    # The bin in which the documents of a size run out, and how many of it are taken.
    partly = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    held = dealt.where(partly).groupBy("_s", "size", "extra", "_bin").agg(F.count("*").alias("here"))
    w = Window.partitionBy("_s", "size").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("upto", F.sum("here").over(w)).where((F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("here") < F.col("extra")))
    cuts = saved(held.select("_s", "size", F.col("_bin").alias("_cut"), (F.col("extra") - F.col("upto") + F.col("here")).alias("_need")), "mix-cuts")
    drawn = _join(dealt, cuts, ["_s", "size"], "left", "mix-cut")
    on_cut = F.coalesce(F.col("_bin") == F.col("_cut"), F.lit(False))
    place = F.row_number().over(Window.partitionBy("_s", "size").orderBy("_h", "doc_id"))
    at_cut = drawn.where(on_cut).withColumn("_more", (place <= F.col("_need")).cast("long"))
    apart = drawn.where(~on_cut).withColumn("_more", F.when(F.col("_cut").isNull(), (F.col("extra") >= F.col("n")).cast("long")).otherwise((F.col("_bin") < F.col("_cut")).cast("long")))
    return apart.unionByName(at_cut).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("_more"))).alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    return mixed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
