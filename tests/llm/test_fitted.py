"""Quality and toxicity: held-out accuracy on the smallest tables, odd rows, and the recursions against plain ones."""

import zlib

import numpy as np
import pyarrow as pa

from lectern.llm import common, quality, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a word", None), (4, "w " * 30000, "z")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, score string")


def accuracy(df, label):
    rows = df.join(df.sparkSession.read.parquet(f"{SF}/labels.parquet").where(f"{label} is not null"), "doc_id").where("held_out").collect()
    return np.mean([r[label] == r["predicted"] for r in rows])


def test_quality_on_held_out_rows(spark):
    out = quality.query(spark, SF)
    assert out.count() == 1000 and out.where("score < 0 or score > 1 or score is null").count() == 0
    assert accuracy(out, "quality") >= 0.97


def test_toxicity_on_held_out_rows(spark):
    out = toxicity.query(spark, SF)
    assert out.count() == 1000 and out.where("score < 0 or score > 1 or score is null").count() == 0
    assert accuracy(out, "toxic") >= 0.9


def test_odd_rows_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for m in (quality, toxicity):
        model = m.fit(odd(spark), labels)
        out = m.score(odd(spark), model)
        assert out.count() == 5 and out.where("score is null").count() == 0
        assert m.score(odd(spark).limit(0), model).count() == 0


def test_fits_give_the_drivers_memory_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    for k, m in enumerate((quality, toxicity), 1):
        m.fit(odd(spark), labels)
        assert len(calls) == k


def test_equal_words_of_the_sample_are_one_object():
    texts = [b" ab  cd\tab", b"", b"cd \xff ab"]
    words = toxicity.shared_words(pa.array(texts))
    assert words == [t.split() for t in texts]
    assert len({id(w) for ws in words for w in ws}) == 3


def test_marginals_equal_the_plain_recursion():
    rng = np.random.default_rng(0)
    sizes = np.array([3, 0, 130, 64, 1, 65])
    e, a, at = np.exp(rng.normal(size=sizes.sum())), np.exp(rng.normal(size=(2, 2))), 0
    p = toxicity.marginals(e, sizes, a)[2]
    for n in sizes:
        forward, v = [], np.array([1.0, 0.0])
        for x in e[at : at + n]:
            v = (v @ a) * [1, x]
            forward.append(v := v / v.sum())
        back = [np.ones(2)]
        for x in e[at : at + n][:0:-1]:
            w = a @ (np.array([1, x]) * back[-1])
            back.append(w / w.sum())
        for k in range(n):
            g = forward[k] * back[n - 1 - k]
            assert np.isclose(g[1] / g.sum(), p[at + k])
        at += n


def test_spans_are_code_point_offsets():
    text = "a é idiot moron, x stupid".encode()
    got = toxicity.spans_of(text, text.split(), np.array([0, 0, 0.9, 0.8, 0, 0.7]))
    assert got == [(4, 16, 0.9), (19, 25, 0.7)]


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.concatenate([rng.integers(0, 50, 6), [60 + (k % 2)]])).astype(np.int32) for k in range(200)]
    y = np.where(np.arange(200) % 2, 1.0, -1.0)
    w = quality.dual_coordinate_descent(rows, np.ones(64), y)
    assert np.mean([np.sign(w[r].sum()) == t for r, t in zip(rows, y)]) > 0.98


def test_dual_coordinate_descent_nears_the_optimum():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 12, 5)).astype(np.int32) for _ in range(60)]
    y, scale = np.where(rng.random(60) < 0.5, 1.0, -1.0), rng.normal(size=12)
    x = np.zeros((60, 12))
    for k, r in enumerate(rows):
        x[k, r] = scale[r] / np.linalg.norm(scale[r])
    good, bad = (y > 0).sum(), (y < 0).sum()
    upper = np.where(y > 0, min(1, bad / good), min(1, good / bad))  # both classes weigh the same
    signed = x * y[:, None]
    alpha, rate = np.zeros(60), 1 / np.linalg.norm(signed @ signed.T, 2)
    for _ in range(20000):  # projected gradient of the dual
        alpha = np.clip(alpha - rate * (signed @ (signed.T @ alpha) - 1), 0, upper)
    primal = lambda w: w @ w / 2 + upper @ np.maximum(0, 1 - signed @ w)
    best = primal(signed.T @ alpha)
    assert np.isclose(best, alpha.sum() - np.sum((signed.T @ alpha) ** 2) / 2, rtol=1e-4)
    assert primal(quality.dual_coordinate_descent(rows, scale, y, epochs=400)) <= best * 1.001 + 1e-9


def test_indicators_are_scaled_by_log_count_ratios(spark):
    texts = [(k, f"good plain words number {k % 7} here" if k % 2 else f"BUY!!! {k % 5} now NOW now") for k in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in texts], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    used = [(k, t) for k, t in texts if zlib.crc32(str(k).encode()) % 4 != 2]
    rows = quality.indicators([t.encode() for _, t in used], common.Ids(quality.describe))
    counts = np.ones((2, quality.BUCKETS))
    for (k, _), r in zip(used, rows):
        for g in r.tolist():
            counts[k % 2, g] += 1
    p = counts / counts.sum(axis=1, keepdims=True)
    ratio = np.log(p[1] / p[0])
    w = quality.dual_coordinate_descent(rows, ratio, np.array([1.0 if k % 2 else -1.0 for k, _ in used]))
    assert np.allclose(model.weights, w * ratio, atol=1e-5) and np.abs(model.weights).max() > 0.01
    out = quality.score(docs, model).collect()
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in out)
