"""Toxicity: a linear-chain conditional random field with two states tags offending words.

Tokens of a bounded sample of labelled documents get weak labels: in a toxic document, a word or word beginning whose distinct
contexts lie nearly all in toxic documents. The field (hashed features of word, beginnings and ending; a 2x2 transition table)
is fitted by gradient ascent on its likelihood. `score` maps whole texts: forward-backward marginals give the offending spans
(code point offsets) and, calibrated on documents the field has not seen, the document score. No shuffle. Null and empty texts
get the score of a text without words; rows keep their multiplicity; further columns are kept.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Ids, append_columns, labelled_sample, platt, remainder, tidy_fit

#: Hash buckets of the features, and the most labelled rows of either class that the fit uses.
BUCKETS, PER_CLASS = 1 << 17, 2000
THRESHOLD = 0.3
#: A weak label needs this many distinct contexts (or this share of the toxic documents), and this ratio of rates.
LEAST_CONTEXTS, CONTEXT_SHARE, LEAST_RATIO = 3, 0.015, 25
BLOCK = 64
EDGE = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType())]))


def parts(word: bytes) -> list[bytes]:
    """A word's features: itself without edge punctuation, its beginnings and its ending."""
    core = word.strip(EDGE).decode("utf-8", "replace").lower()
    return [x.encode() for x in ("=" + core, *[f"{k}<{core[:k]}" for k in (4, 5) if len(core) > k], ">" + core[-3:])]


def hashed(word: bytes) -> list[int]:
    return [xxhash.xxh3_64_intdigest(x) % BUCKETS for x in parts(word)]


def marginals(e: np.ndarray, sizes: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward odds, backward odds and marginal probability of state 1 at each token of the concatenated texts.

    e: emission odds; a: transition weights. A step maps odds by a Moebius transformation; these compose as 2x2 matrices, so
    blocks of tokens are composed side by side, then linked along each text, then replayed: no loop over a long text's tokens.
    """
    keep = sizes > 0
    sizes = sizes[keep]
    if not len(sizes):
        return np.ones(0), np.ones(0), np.zeros(0)
    order = np.argsort(-sizes, kind="stable")
    blocks = -(-sizes // BLOCK)
    first_block = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    first_token = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    nb = int(blocks.sum())
    doc = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(e)) - first_token[doc]
    slot = (first_block[doc] + inside // BLOCK) * BLOCK + inside % BLOCK
    grid = np.ones((BLOCK, nb))
    real = np.zeros((BLOCK, nb), bool)
    grid[slot % BLOCK, slot // BLOCK] = e
    real[slot % BLOCK, slot // BLOCK] = True
    head = np.zeros(nb, bool)
    head[first_block] = True
    (a00, a01), (a10, a11) = a

    def composed(steps, coefficients):
        m = np.zeros((4, nb))
        m[0] = m[3] = 1
        for t in steps:
            p, q, r, s = coefficients(t)  # odds -> (p odds + q) / (r odds + s)
            n = np.stack([p * m[0] + q * m[2], p * m[1] + q * m[3], r * m[0] + s * m[2], r * m[1] + s * m[3]])
            n /= n.max(axis=0)
            m = np.where(real[t], n, m)
        return m

    def linked(m, at_block, begin):
        """Odds that enter each block."""
        enter = np.ones(nb)
        last = None
        for k in range(int(blocks.max())):
            now = order[: np.searchsorted(-blocks[order], -k, side="left")]  # texts with more than k blocks
            b = at_block(now, k)
            enter[b] = begin if k == 0 else last[: len(now)]
            last = (m[0][b] * enter[b] + m[1][b]) / (m[2][b] * enter[b] + m[3][b])
        return enter

    fwd = lambda t: (grid[t] * a11, grid[t] * a01, a10, a00)
    # Before the first token the odds are those that leave both states alike: the chain starts from state 0.
    enter = linked(composed(range(BLOCK), fwd), lambda d, k: first_block[d] + k, 0.0)
    o = np.empty((BLOCK, nb))
    now = enter
    for t in range(BLOCK):
        now = np.where(real[t], grid[t] * (a01 + a11 * now) / (a00 + a10 * now), now)
        o[t] = now
    # Backward over "what comes after token t", with the emission of the token itself folded in on the way.
    back = lambda t: (a11 * grid[t], a10, a01 * grid[t], a00)
    leave = linked(composed(range(BLOCK - 1, -1, -1), back), lambda d, k: first_block[d] + blocks[d] - 1 - k, 1.0)
    b = np.empty((BLOCK, nb))
    now = leave
    for t in range(BLOCK - 1, -1, -1):
        b[t] = now
        now = np.where(real[t], (a10 + a11 * grid[t] * now) / (a00 + a01 * grid[t] * now), now)
    fo, bo = o[slot % BLOCK, slot // BLOCK], b[slot % BLOCK, slot // BLOCK]
    return fo, bo, fo * bo / (1 + fo * bo)


def summaries(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text: the highest log odds of a token, and the log of the expected number of offending tokens."""
    out = np.tile([-12.0, -9.0], (len(sizes), 1))
    if len(p):
        some = np.flatnonzero(sizes)
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])[some]
        top = np.clip(np.maximum.reduceat(p, at), 1e-5, 1 - 1e-5)
        out[some, 0] = np.maximum(np.log(top / (1 - top)), -12)
        out[some, 1] = np.log(np.add.reduceat(np.where(p > 0.05, p, 0), at) + np.exp(-9))
    return out


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    transitions: np.ndarray
    calibration: np.ndarray

    def potential(self) -> Callable[[bytes], tuple[float]]:
        """The log odds that a word's features give it, as a function of the word."""
        weights = self.weights.tolist()
        return lambda word: (sum([weights[h] for h in hashed(word)]),)

    def probabilities(self, s: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(s @ self.calibration[:-1] + self.calibration[-1], -30, 30)))


def shared_words(texts: Iterable[pa.BinaryScalar]) -> list[list[bytes]]:
    """The words of each text; equal words are one object, so that memory grows with the distinct ones."""
    met: dict[bytes, bytes] = {}
    return [[met.setdefault(w, w) for w in t.as_py().split()] for t in texts]


def vocabulary(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each token's word; of each word's features: hash, word number, and whether a weak label may rest on it."""
    numbers: dict[bytes, int] = {}
    tokens = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in texts for w in ws), np.int32)
    flat, owner, firm = array("Q"), array("i"), array("b")
    for word, n in numbers.items():
        for x in parts(word):
            flat.append(xxhash.xxh3_64_intdigest(x))
            owner.append(n)
            firm.append(x[:1] != b">" and len(x) > 3)
    return tokens, np.array(flat, np.uint64), np.array(owner, np.int32), np.array(firm, bool)


def weak_labels(tokens: np.ndarray, flat: np.ndarray, owner: np.ndarray, firm: np.ndarray, toxic: np.ndarray, texts: int) -> np.ndarray:
    """1 at the tokens of toxic texts that mark toxicity. Contexts, not occurrences, are counted, so copies count once."""
    words = int(owner.max(initial=-1)) + 1
    names, feature = np.unique(flat[firm], return_inverse=True)
    holder = owner[firm]
    before = np.concatenate([[-1], tokens[:-1]]).astype(np.int64)
    contexts, totals = [], []
    for own in (~toxic, toxic):
        pairs = np.unique(tokens[own].astype(np.int64) * (words + 1) + before[own] + 1) // (words + 1)
        contexts.append(np.bincount(feature, np.bincount(pairs, minlength=words)[holder], len(names)))
        totals.append(max(1, int(own.sum())))
    bad = (contexts[1] >= max(LEAST_CONTEXTS, CONTEXT_SHARE * texts)) & (contexts[1] / totals[1] >= LEAST_RATIO * (contexts[0] + 0.25) / totals[0])
    return (np.bincount(holder, bad[feature], words) > 0)[tokens] & toxic


def train_field(tokens: np.ndarray, flat: np.ndarray, owner: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int = 40, part: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and of the transitions, by Adam on the likelihood of the tags; gradients add up over parts."""
    words = int(owner.max(initial=-1)) + 1
    bucket = (flat % np.uint64(BUCKETS)).astype(np.int32)
    ends = np.cumsum(sizes)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(part, len(tokens), part)) + 1, [len(sizes)]]))
    theta = np.concatenate([np.zeros(BUCKETS), [0.0, -2.0, 0.0, 0.0]])
    support = np.maximum(np.bincount(bucket, np.bincount(tokens, minlength=words)[owner], BUCKETS), 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        a = np.exp(theta[BUCKETS:]).reshape(2, 2)
        odds = np.exp(np.clip(np.bincount(owner, theta[bucket], words), -30, 30))
        by_word, moves = np.zeros(words), np.zeros(4)
        for c, d in zip(cuts, cuts[1:]):
            at = slice(ends[c - 1] if c else 0, ends[d - 1])
            own, tags, n = tokens[at], y[at].astype(float), sizes[c:d]
            heads = np.zeros(len(own), bool)
            heads[(np.cumsum(n) - n)[n > 0]] = True
            before = np.concatenate([[0.0], tags[:-1]]) * ~heads
            e = odds[own]
            o, b, p = marginals(e, n, a)
            prior = np.where(heads, 0.0, np.concatenate([[0.0], o[:-1]]))
            joint = np.stack([a[0, 0] + 0 * e, a[0, 1] * e * b, prior * a[1, 0], prior * a[1, 1] * e * b])
            joint /= joint.sum(axis=0)
            moves += (np.stack([(1 - before) * (1 - tags), (1 - before) * tags, before * (1 - tags), before * tags]) - joint).sum(axis=1)
            by_word += np.bincount(own, tags - p, words)
        g = np.concatenate([np.bincount(bucket, by_word[owner], BUCKETS) / np.sqrt(support), moves / np.sqrt(max(1, len(y)))]) - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.35 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-3)
    return theta[:BUCKETS], np.exp(theta[BUCKETS:]).reshape(2, 2)


@tidy_fit
def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Fit on at most `per_class` labelled documents of either class. Without labels of both classes every score is the prior."""
    sample = labelled_sample(docs, labels, "toxic", per_class).toArrow().sort_by("doc_id")
    y = sample["y"].to_numpy().astype(float)
    rates = labels.where(F.col("toxic").isNotNull() & (remainder(F.col("doc_id"), 4) != 2)).agg(F.coalesce(F.avg("toxic"), F.lit(0.0)).alias("p")).first()["p"]
    prior = np.log(np.clip(rates, 1e-4, 1 - 1e-4) / (1 - np.clip(rates, 1e-4, 1 - 1e-4)))
    texts = shared_words(sample["text"])
    del sample
    if len(set(y)) < 2 or not any(texts):
        return ToxicityModel(np.zeros(BUCKETS), np.ones((2, 2)), np.array([0.0, 0.0, prior]))
    learn = np.arange(len(y)) % 3 > 0
    inner = [t for t, l in zip(texts, learn, strict=True) if l]
    sizes = np.array([len(t) for t in inner], int)
    tokens, flat, owner, firm = vocabulary(inner)
    tags = weak_labels(tokens, flat, owner, firm, np.repeat(y[learn] > 0, sizes), int(y[learn].sum()))
    weights, transitions = train_field(tokens, flat, owner, sizes, tags)
    del inner, tokens, flat, owner, firm, tags
    model = ToxicityModel(weights, transitions, np.zeros(3))
    outer = [t for t, l in zip(texts, learn, strict=True) if not l]
    s = tagged(outer, model, Ids(model.potential(), 100_000))[1]
    calibration = platt(s, y[~learn])
    rate = y[~learn].mean()
    calibration[-1] += prior - np.log(max(rate, 1e-3) / max(1 - rate, 1e-3))
    return ToxicityModel(weights.astype(np.float32), transitions, calibration)


def tagged(texts: list[list[bytes]], model: ToxicityModel, ids: Ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(ws) for ws in texts], int)
    tokens = ids.of([w for ws in texts for w in ws])
    e = np.exp(np.clip(np.array(ids.rows, float).reshape(-1), -30, 30))[tokens]
    p = marginals(e, sizes, model.transitions)[2]
    ids.trim()
    return p, summaries(p, sizes), sizes


def spans_of(text: bytes, words: list[bytes], p: np.ndarray) -> list[tuple[int, int, float]]:
    """Maximal runs of words that are likelier offending than not, as code point offsets."""
    out: list[tuple[int, int, float]] = []
    at = chars = upto = 0
    last = -2
    for i, w in enumerate(words):
        at = text.index(w, at)
        if p[i] >= 0.5:
            chars += len(text[upto:at].decode("utf-8", "replace"))
            end = chars + len(w.decode("utf-8", "replace"))
            out.append((out.pop()[0], end, max(out_p, float(p[i]))) if last == i - 1 else (chars, end, float(p[i])))
            out_p, last, upto, chars = out[-1][2], i, at + len(w), end
        at += len(w)
    return out


def score(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Every row with `score`, `predicted` (1 from THRESHOLD on) and `spans`."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS numbers
    state: dict = {}

    def kernel(texts: list[bytes]) -> list[pa.Array]:
        model = shared.value
        words = [t.split() for t in texts]
        if "ids" not in state:
            state["ids"] = Ids(model.potential())
        p, s, sizes = tagged(words, model, state["ids"])
        out = model.probabilities(s)
        ends = np.cumsum(sizes)
        spans = [[dict(zip(("start", "end", "probability"), x, strict=True)) for x in spans_of(t, ws, p[b - n : b])] if top > 0 else [] for t, ws, n, b, top in zip(texts, words, sizes, ends, s[:, 0], strict=True)]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
        return [pa.array(out, pa.float64()), pa.array((out >= THRESHOLD).astype(np.int32)), pa.array(spans, kind)]

    return append_columns(df, text, [("score", T.DoubleType()), ("predicted", T.IntegerType()), ("spans", SPANS)], kernel)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (F.coalesce(remainder(F.col("doc_id"), 4), F.lit(0)) == 2).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))
