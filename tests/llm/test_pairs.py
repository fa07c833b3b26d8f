"""Near duplicates, substrings, packing, WARC, rules, language model and audio against brute force on small fixtures."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import chroma, common, hmm_lm, minhash, packing, rules, substring, warc

WORDS = [f"w{k}" for k in range(400)]


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    rows, base = [], [" ".join(rng.choices(WORDS, k=rng.randrange(30, 200))) for _ in range(25)]
    for k in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((k, " ".join(w)))
    shared = " ".join(rng.choices(WORDS, k=150))
    rows += [(n + k, f"{rng.choice(WORDS)} é {k} {shared} {rng.choice(WORDS)}") for k in range(6)]
    return rows + [(1000, None), (1001, ""), (1002, "Three short words"), (1003, "three SHORT words"), (1004, "ab" * 900), (1005, "x" * 1200), (1006, "\n \t"), (None, "no id at all"), (7, rows[7][1])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in corpus()], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("hot", [1000, 2])
def test_near_duplicates_equal_brute_force(docs, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(minhash, "HOT_ROWS", hot)
    sets, parent = {}, {}
    for i, t in corpus():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        parent[i] = i

    def root(x):
        return x if parent[x] == x else root(parent[x])

    ids = [i for i in sets if i is not None and sets[i]]
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in sets}
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_comparison_in_blocks_finds_all_near_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 300 - k % 17], rng.integers(0, 1 << 60, k % 17).astype(np.uint64)])) for k in range(60)]
    sketch = minhash.signatures(sets)["sketch"]
    rows = [(1, k, len(s), bytearray(x.tobytes()), k, 60) for k, (s, x) in enumerate(zip(sets, sketch))]
    df = spark.createDataFrame(rows, "key long, id long, n long, sketch binary, root long, g long")
    found = {(r.a, r.b) for r in minhash.near_in_blocks(df).collect()}
    near = {(a, b) for a in range(60) for b in range(a + 1, 60) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert near and near <= found


def brute_substrings(texts):
    seen = collections.Counter(b[i : i + 400] for b in texts for i in range(len(b) - 399))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("together", [2000, 1])
def test_substrings_equal_brute_force(docs, monkeypatch, together):
    monkeypatch.setattr(common, "HOT_ROWS", min(together, 1000))
    monkeypatch.setattr(substring, "TOGETHER", together)
    out = substring.deduplicated(docs.withColumn("n_spans", F.lit("clash")))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in out.collect())
    rows = corpus()
    assert got == sorted((i if i is not None else -1, *x) for (i, _), x in zip(rows, brute_substrings([(t or "").encode() for _, t in rows])))
    assert substring.deduplicated(docs.limit(0)).count() == 0


def test_suffix_arrays_are_in_byte_order_and_find_all_repeats():
    rng = random.Random(3)
    base = bytes(rng.choices(b"ab\0\xff", k=3000))
    for t in range(12):
        contents = [bytearray(base[a : a + rng.randrange(400, 700)]) for a in (rng.randrange(2200) for _ in range(t + 1))]
        for c in contents[::2]:
            c[rng.randrange(len(c))] ^= 1
        contents = [*map(bytes, contents), b"x" * 500, b"\0" * 400]
        buffer = b"".join(contents)
        order, equal = substring.suffix_array(buffer, np.arange(len(buffer) - 399))
        strings = [buffer[i : i + 400] for i in order.tolist()]
        assert strings == sorted(strings) and equal.tolist() == [False] + [a == b for a, b in zip(strings, strings[1:])]
        seen = collections.Counter(c[i : i + 400] for c in contents for i in range(len(c) - 399))
        runs = zip(*(x.tolist() for x in substring.repeated_strings(contents)))
        assert {(k, i) for k, lo, hi in runs for i in range(lo, hi + 1)} == {(k, i) for k, c in enumerate(contents) for i in range(len(c) - 399) if seen[c[i : i + 400]] > 1}


def test_packing_is_gapless_and_right(docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    long = docs.sparkSession.createDataFrame([(2000, " ".join(WORDS * 12), "en", "s", 1)], docs.schema)
    rows = packing.pack(docs.union(long)).toPandas()
    t = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = []
    for i, text in [*corpus(), (2000, " ".join(WORDS * 12))]:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(-1 if i is None else i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    got = [(-1 if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples()]
    assert sorted(got) == sorted(want)
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 2048) + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_plan_uses_every_length_once():
    rng = np.random.default_rng(2)
    h = np.zeros(2049, int)
    for a in np.clip(rng.lognormal(6, 1, 5000), 1, 2048).astype(int):
        h[a] += 1
    used = np.zeros_like(h)
    for pattern, n in packing.plan(h):
        assert sum(pattern) <= 2048
        for a in pattern:
            used[a] += n
    assert (used == h).all()


def test_warc_round_trip_revisits_and_predicates(spark, tmp_path):
    big = "<p>" + "é" * 80
    pages = spark.createDataFrame([(3, "u\r\nx: y", big, 1), (1, "http://a", big, 1), (2, None, "tiny", 1), (4, "b", "tiny", 1), (5, "c", None, 1), (None, "d", big, 1), (6, "e", "", 1)], "page_id long, url string, html string, payload int")
    warc.archived(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert len(got) == 7 and {k: r.record_type for k, r in got.items()} == {3: "revisit", 1: "response", 2: "response", 4: "response", 5: "response", None: "response", 6: "response"}
    assert got[3].refers_to == 1 and got[3].payload_digest == hashlib.sha256(big.encode()).hexdigest() and got[3].target_uri == "u\r\nx: y"
    assert bytes(got[1].payload) == big.encode() and bytes(got[5].payload) == b"" and got[2].target_uri is None
    some = warc.read(spark, str(tmp_path / "w"), "page_id long, record_type string").where("record_type = 'response' and page_id > 1")
    assert sorted(r.page_id for r in some.collect()) == [2, 4, 5, 6]
    warc.archived(pages.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_rules_statistics_equal_plain_counts(spark, docs):
    def plain(t):
        w, lines = t.encode().split(), [x for x in t.split("\n") if x.encode().split()]
        seen, inside = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
        for i in range(len(w) - 4):
            if seen[tuple(w[i : i + 5])] > 1:
                inside.update(range(i, i + 5))
        return len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)

    texts = ["", "a b c d e f a b c d e", "x\nx\n \n x\ny#*", " lead  and trail\v\f", "a b  c", "one " * 50, "\n\n"] + [t or "" for _, t in corpus()]
    df = spark.createDataFrame([(k, t, None, None, "clash") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.statistics(df).collect()}
    assert got == {k: plain(t) for k, t in enumerate(texts)}
    verdict = rules.judged(df)
    assert verdict.count() == len(texts) and verdict.where("kept and base_failed").count() == 0
    assert rules.judged(df.limit(0)).count() == 0


def test_rules_reject_outliers_and_keep_the_rest(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(WORDS, k=rng.randrange(40, 400))), "en", "a") for k in range(300)]
    rows += [(1000 + k, " ".join(w + "***" for w in rng.choices(WORDS, k=120)), "en", "a") for k in range(20)]
    out = {r.doc_id: r.kept for r in rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[k] for k in range(300)) and not any(out[1000 + k] for k in range(20))


def least_determinant(x, starts, seed):
    """The least log-determinant that plain concentration steps reach from random starts, with the same floors."""
    rng, best, h = np.random.default_rng(seed), math.inf, math.ceil(rules.KEPT_SHARE * len(x))
    floors = np.diag(np.square(rules.FLOORS))
    for _ in range(starts):
        chosen, last = rng.choice(len(x), 30, replace=False), None
        while True:
            mean, scatter = x[chosen].mean(axis=0), np.cov(x[chosen].T, bias=True) + floors
            det = np.linalg.slogdet(scatter)[1] if last is not None else math.inf  # that of the 30 rows is no candidate
            if last is not None and det > last - 1e-9:
                break
            last = det
            d = np.einsum("ij,ij->i", (x - mean) @ np.linalg.inv(scatter), x - mean)
            chosen = np.argsort(d, kind="stable")[:h]
        best = min(best, last)
    return best


def test_determinants_are_as_low_as_those_of_many_plain_starts(spark):
    rng = np.random.default_rng(8)
    groups = {"a": np.vstack([rng.normal(0, 1, (400, 5)), rng.normal(6, 0.4, (60, 5))]), "b": rng.standard_t(3, (300, 5)), "c": np.vstack([rng.normal(0, 2, (150, 5)), rng.normal(-4, 0.2, (35, 5))])}
    rows = [(g, *map(float, x), k) for g, xs in groups.items() for k, x in enumerate(xs)]
    points = spark.createDataFrame(rows, "stratum string, x0 double, x1 double, x2 double, x3 double, x4 double, draw long")
    got = {r.stratum: r.det for r in rules.least_determinants(points).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        assert got[g] <= least_determinant(xs, 60, 1) + 0.02


def test_small_groups_lean_on_their_language(spark):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choices(WORDS, k=rng.randrange(40, 400)))
    rows = [(k, text(), "en", "large") for k in range(200)] + [(500 + k, text(), "en", f"small {k % 7}") for k in range(12)] + [(600, text(), None, None)]
    rows += [(700, " ".join(w + "***" for w in rng.choices(WORDS, k=120)), "en", "small 1"), (701, None, "xx", "alone"), (701, None, "xx", "alone")]
    out = rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert sorted(r.doc_id for r in out.where("not kept").collect()) == [700, 701, 701]


def test_language_model_base_and_likelihood(docs):
    out = {r.doc_id: r for r in hmm_lm.scored(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7, F.lit(0)) == 2).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*(t or "").encode().lower().split(), b""]) for i, t in corpus()]
    c = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens:
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0


def test_forward_recursion_and_expected_counts_equal_enumeration():
    rng = np.random.default_rng(5)
    k, m = hmm_lm.STATES, 6
    model = hmm_lm.HiddenMarkov((s := rng.random(k)) / s.sum(), (a := rng.random((k, k))) / a.sum(axis=1, keepdims=True), (e := rng.random((m, k))) / e.sum(axis=0))
    texts = [rng.integers(0, m, n).astype(np.int32) for n in (3, 1, 300)]
    for t, got in zip(texts, model.likelihoods(texts)):
        alpha, log = model.start * model.emit[t[0]], 0.0
        for x in t[1:]:
            log += math.log10(alpha.sum())
            alpha = (alpha / alpha.sum()) @ model.step * model.emit[x]
        assert math.isclose(got, log + math.log10(alpha.sum()), rel_tol=1e-9)
    start, moves, emit = model.expected(texts[:2])
    assert math.isclose(start.sum(), 2) and math.isclose(moves.sum(), 2) and np.allclose(emit.sum(axis=1), np.bincount(np.concatenate(texts[:2]), minlength=m))


def test_fingerprints_align_shifted_audio(spark):
    rng = np.random.default_rng(6)
    song = chroma.melody(rng.normal(0, 0.2, 200).tolist())
    other = chroma.melody(rng.normal(0, 0.2, 200).tolist())
    pcm = lambda x: (x * 30000).astype("<i2").tobytes()
    rows = [(100, pcm(song[20 * chroma.HOP : 150 * chroma.HOP])), (1, pcm(song)), (2, pcm(other)), (3, pcm(song)), (4, None), (5, b"\0\0"), (None, pcm(other))]
    prints = chroma.fingerprints(spark.createDataFrame(rows, "id long, audio binary"), "id", "audio")
    out = chroma.aligned(prints, F.col("rec_id") % 100 == 0).collect()
    assert {r.rec_id: r.class_id for r in out if r.kind == "member" and r.rec_id} == {100: 100, 1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    assert [(r.rec_id, r.class_id, r.offset) for r in out if r.kind == "match"] == [(100, 1, 20)]


def test_integral_image_equals_plain_sums():
    c = chroma.chroma(chroma.melody(np.linspace(-0.4, 0.4, 64).tolist()))
    kind, y, h, w = chroma.FILTERS[0]
    wide = np.concatenate([c, c], axis=1)
    a, b = wide[: w // 2, y : y + h].sum(), wide[w // 2 : w, y : y + h].sum()
    bits = chroma.GRAY[np.searchsorted(chroma.BORDERS, np.log((1 + a) / (1 + b)))]
    assert kind == 0 and chroma.fingerprint(chroma.melody(np.linspace(-0.4, 0.4, 64).tolist()))[0] >> 30 == bits


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_at_other_similarities(spark, percent):
    rng = random.Random(9)
    base = [rng.choices(WORDS, k=100) for _ in range(12)]
    # A changed word in the middle takes five shingles of 96 with it: 91/101, 86/106 and 81/111 for one, two and three words.
    rows = [(3 * k + j, " ".join("new" if i in (10, 40, 70)[:n] else w for i, w in enumerate(ws))) for k, ws in enumerate(base) for j, n in enumerate((0, 1 + k % 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: i - 1 if i % 3 == 1 and {0: 91 / 101, 1: 86 / 106, 2: 81 / 111}[i // 3 % 3] >= percent / 100 else i for i, _ in rows}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, percent).collect()} == want


def brute_alignments(asked, others):
    """The least share of differing bits, with its offset, over all offsets that leave LEAST_OVERLAP integers."""
    out = {}
    for q, x in asked.items():
        for c, y in others.items():
            found = []
            for o in range(1 - len(x), len(y)):
                a, b = x[max(0, -o) :], y[max(0, o) :]
                n = min(len(a), len(b))
                if n >= chroma.LEAST_OVERLAP and q != c:
                    found.append((float(np.bitwise_count(a[:n] ^ b[:n]).sum()) / (32 * n), abs(o), -o, int((a[:n] == b[:n]).sum())))
            if found and min(found)[0] <= chroma.LARGEST_ERROR:
                e, _, o, votes = min(found)
                out[q, c] = (-o, votes, e)
    return out


def noisy_songs(decibels, n=40):
    rng = np.random.default_rng(8)
    songs = {k: chroma.melody(rng.normal(0, 0.2, 64 if k % 3 else 90).tolist()) for k in range(1, n)}
    for k in list(songs):
        part = songs[k][5 * chroma.HOP * (k % 4) :]
        songs[100 * k] = part + rng.normal(size=len(part)) * np.sqrt(np.mean(part**2) / 10 ** (decibels / 10))
    return {k: (np.clip(x / 6, -1, 1) * 30000).astype("<i2").tobytes() for k, x in songs.items()}


@pytest.mark.parametrize("decibels", [5, 0, -3])
def test_noisy_recordings_equal_brute_force(spark, decibels):
    songs = noisy_songs(decibels)
    prints = {k: chroma.fingerprint(chroma.pcm16(x)) for k, x in songs.items()}
    want = brute_alignments({k: p for k, p in prints.items() if k % 100 == 0}, prints)
    rows = spark.createDataFrame([(k, x) for k, x in songs.items()], "id long, audio binary")
    out = chroma.aligned(chroma.fingerprints(rows, "id", "audio"), F.col("rec_id") % 100 == 0).where("kind = 'match'").collect()
    got = {(r.rec_id, r.class_id): (r.offset, r.votes, r.bit_error) for r in out}
    assert {k: v for k, v in got.items() if k in want} == want  # others have short overlaps, found by votes
    assert sum(got.get((100 * k, k), (None,))[0] == 5 * (k % 4) for k in range(1, 40)) >= (39 if decibels >= 0 else 35)


def test_comparison_at_all_offsets_in_small_pieces(monkeypatch):
    prints = {k: chroma.fingerprint(chroma.pcm16(x)) for k, x in noisy_songs(0, 12).items()}
    prints[5000] = np.concatenate([prints[1], prints[2]] * 60)  # one beyond single precision
    prints[5001] = prints[1][:15]
    ids = list(prints)
    for held in (1 << 22, 1 << 14, 1):
        monkeypatch.setattr(chroma, "HELD", held)
        found = {(ids[i], ids[j]): rest for i, j, *rest in chroma.closest(list(prints.values()), list(prints.values())) if i != j}
        assert {k: tuple(v) for k, v in found.items()} == brute_alignments(prints, prints)


def test_expected_counts_cross_windows(monkeypatch):
    rng = np.random.default_rng(5)
    k, m = hmm_lm.STATES, 6
    model = hmm_lm.HiddenMarkov((s := rng.random(k)) / s.sum(), (a := rng.random((k, k))) / a.sum(axis=1, keepdims=True), (e := rng.random((m, k))) / e.sum(axis=0))
    texts = [rng.integers(0, m, n).astype(np.int32) for n in (3, 1, 300, 64, 129)]
    start, moves, emit, log = np.zeros(k), np.zeros((k, k)), np.zeros((m, k)), 0.0
    for t in texts:
        alpha, beta = [model.start * model.emit[t[0]]], [np.ones(k)]
        for x in t[1:]:
            alpha.append(alpha[-1] @ model.step * model.emit[x])
        for x in t[:0:-1]:
            beta.append(model.step @ (model.emit[x] * beta[-1]))
        beta.reverse()
        p = alpha[-1].sum()
        log += math.log(p)
        start += alpha[0] * beta[0] / p
        for i, x in enumerate(t):
            emit[x] += alpha[i] * beta[i] / p
            if i:
                moves += alpha[i - 1][:, None] * model.step * (model.emit[x] * beta[i])[None] / p
    for window in (4096, 64):
        monkeypatch.setattr(hmm_lm, "WINDOW", window)
        for got, want in zip(model.counts(texts), (start, moves, emit, log)):
            assert np.allclose(got, want)


def test_training_goes_over_all_rows_until_it_settles(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(WORDS[:30] if k % 2 else WORDS[30:60], k=12)), False) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").withColumn("text", F.col("text").cast("binary"))
    words = hmm_lm.lexicon(hmm_lm.counted(docs.select("text")))
    encoded = hmm_lm.encoded(docs, words).cache()
    model = hmm_lm.trained(encoded, words)
    texts = [np.frombuffer(r.symbols, "<i4") for r in encoded.collect()]
    start, moves, emit, log = model.counts(texts)
    again = hmm_lm.updated(start, moves, emit, words.share, 200.0).counts(texts)[3]
    assert again - log <= hmm_lm.SETTLED * abs(log)
    other = hmm_lm.trained(encoded.orderBy(F.xxhash64("doc_id")).repartition(7), words)
    assert np.allclose(other.emit, model.emit) and np.allclose(other.step, model.step)
