"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by naive Bayes log-count ratios.

Indicators are hashed uni- and bigrams of words, bi- and trigrams of word shapes (with a mark for a word equal to the one
before it), and one mark each for a repeated line and for the order of magnitude of the length. `fit` learns on a bounded
sample of labelled rows (PER_CLASS of either class), held-out rows excluded; `score` is one map over whole texts, with no
shuffle. Null and empty texts get the score of an empty text; rows keep their multiplicity; any further columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Ids, append_columns, bounded_batches, labelled_sample, mixed, platt, remainder, tidy, tidy_fit

#: Hash buckets of the indicators, and the most labelled rows of either class that the fit uses.
BUCKETS, PER_CLASS = 1 << 18, 6000
THRESHOLD = 0.7
LOWER = bytes.maketrans(b"abcdefghijklmnopqrstuvwxyz", b"a" * 26)
SHAPE = LOWER.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", b"A" * 26 + b"0" * 10)).translate(bytes.maketrans(bytes(range(128, 256)), b"a" * 128))


def describe(word: bytes) -> tuple[int, int]:
    """Hashes of a word in lower case, and of its shape: classes of characters, runs shortened to two."""
    s = word.translate(SHAPE)
    out = bytearray(s[:2])
    for c in s[2:]:
        if not out[-1] == out[-2] == c:
            out.append(c)
    return xxhash.xxh3_64_intdigest(word.lower()), xxhash.xxh3_64_intdigest(bytes(out), 7)


def indicators(texts: list[bytes], ids: Ids) -> list[np.ndarray]:
    """The distinct buckets of each text's n-grams."""
    split = [t.split() for t in texts]
    all_ids = ids.of([w for ws in split for w in ws])
    table = np.array(ids.rows, np.uint64).reshape(-1, 2)
    out, at = [], 0
    for text, ws in zip(texts, split, strict=True):
        n = len(ws)
        own = all_ids[at : at + n]
        at += n
        w, s = table[own, 0], table[own, 1].copy()
        s[1:][own[1:] == own[:-1]] += np.uint64(1)
        lines = [x for x in text.split(b"\n") if x.strip()]
        grams = [w, w[:-1] * np.uint64(3) + w[1:], s, s[:-1] * np.uint64(5) + s[1:], s[:-2] * np.uint64(7) + s[1:-1] * np.uint64(11) + s[2:]]
        marks = np.array([1000 + n.bit_length(), 2000 + (len(set(lines)) < len(lines)), 3000 + (n < 10)], np.uint64)
        out.append(np.unique(mixed(np.concatenate([*grams, marks])) & np.uint64(BUCKETS - 1)).astype(np.int32))
    ids.trim()
    return out


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    calibration: np.ndarray

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() / np.sqrt(len(r)) for r in rows])

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        s = self.margins(rows)
        return 1 / (1 + np.exp(-np.clip(s * self.calibration[0] + self.calibration[1], -30, 30)))


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 5) -> np.ndarray:
    """Weights of a linear model with hinge loss: one dual variable for each row, updated in random order."""
    x = [scale[r] / max(np.linalg.norm(scale[r]), 1e-9) for r in rows]
    w, alpha, rng = np.zeros(len(scale)), np.zeros(len(rows)), np.random.default_rng(seed)
    upper = np.where(y > 0, c * (y < 0).sum() / max(1, (y > 0).sum()), c) if (y > 0).sum() > (y < 0).sum() else np.where(y > 0, c, c * (y > 0).sum() / max(1, (y < 0).sum()))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ x[i]) - 1
            new = min(max(alpha[i] - g, 0.0), upper[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


@tidy_fit
def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """Fit on at most `per_class` labelled documents of either class. Without labels of both classes every score is the prior."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        ids = Ids(describe)
        for b in batches:
            rows = indicators(b.column("text").to_pylist(), ids)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "y", "grams"])

    sample = labelled_sample(docs, labels, "quality", per_class).select("doc_id", "y", "text").mapInArrow(tidy(run), "doc_id long, y int, grams array<int>").toArrow().sort_by("doc_id")
    y = np.array(sample["y"].to_numpy(), float)
    if len(set(y)) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(np.zeros(BUCKETS), np.array([0.0, np.log(p / (1 - p))]))
    flat = sample["grams"].combine_chunks()
    ends = flat.offsets.to_numpy()
    values = flat.values.to_numpy()
    rows = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    good = np.repeat(y > 0, np.diff(ends))
    counts = [np.bincount(values[ends[0] : ends[-1]][m], minlength=BUCKETS) + 1.0 for m in (good, ~good)]
    ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    # The calibration comes from rows that its weights have not seen, the final weights from all.
    part = np.arange(len(rows)) % 3 == 0
    seen, unseen = np.flatnonzero(~part), np.flatnonzero(part)
    scaled = lambda w: w * ratio
    first = QualityModel(scaled(dual_coordinate_descent([rows[i] for i in seen], ratio, 2 * y[seen] - 1)), np.zeros(2))
    norm = lambda m, some: np.array([m.weights[r].sum() / np.sqrt(len(r)) for r in some])
    calibration = platt(norm(first, [rows[i] for i in unseen]), y[unseen])
    return QualityModel(scaled(dual_coordinate_descent(rows, ratio, 2 * y - 1)).astype(np.float32), calibration)


def score(df: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Every row with `score` (probability of good quality) and `predicted` (1 from THRESHOLD on)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS numbers
    state: dict = {}

    def kernel(texts: list[bytes]) -> list[pa.Array]:
        ids = state.setdefault("ids", Ids(describe))
        p = shared.value.probabilities(indicators(texts, ids))
        return [pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))]

    return append_columns(df, text, [("score", T.DoubleType()), ("predicted", T.IntegerType())], kernel)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (F.coalesce(remainder(F.col("doc_id"), 4), F.lit(0)) == 2).alias("held_out"), "score", "predicted")
