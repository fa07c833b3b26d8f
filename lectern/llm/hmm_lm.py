"""Language-model scores by a hidden Markov model, beside a smoothed unigram base.

Tokens are counted over all training documents. Every token with at least 1/HOT of all occurrences is a symbol of its own
(there are at most HOT of them), all others share CLASSES symbols by ending and length, and have their counts, smoothed,
inside the class: the model gives every text a proper probability. Baum-Welch starts from the unigram shares and settles on about
WARM tokens of short texts first, picked by a hash of the text (a start only, the same for every partitioning); then every pass
sums expected counts over the partitions of all training documents, each a whole chain, until a pass gains less than SETTLED of
the log-likelihood (blocks of WINDOW tokens bound the memory and let long texts run abreast, their borders are exact); scores come from the scaled forward recursion over each whole text. Counts of rare tokens never leave the executors: their
share of a text's score is a join by token, in which no key has more than 1/HOT of the rows.

Null and empty texts consist of the end token. Rows with a null doc_id are trained on; repeated rows count and are scored each.
Rare tokens are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mixed, numbered_words, remainder, runs_of, saved, text_bytes, tidy

HOT, CLASSES, STATES = 50_000, 1024, 8
WINDOW, SETTLED = 512, 1e-4
#: Tokens of blocks that are worked on together.
HELD = 400_000
#: Tokens, and those of a text at most, on which the parameters settle before they see all rows, and how far.
WARM, WARM_TEXT, WARM_SETTLED = 800_000, 1024, 2e-6
#: The end token; no word is empty.
END = b""
_EXPECTED = "symbol int, " + ", ".join(f"s{k} double" for k in range(STATES))


_MARKS = np.isin(np.arange(256), list(b".,;:!?\"')"))


def described(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of words, and the class that each has if it is not frequent: by its last letters, closing marks and length."""
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) ^ np.uint64(1 << 63)
    raw = np.frombuffer(b"\0\0\0" + b"".join(words) + b"\0\0", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(sizes) + 3
    begin = end - sizes
    core = np.maximum(begin, np.maximum.accumulate(np.where(_MARKS[raw], 0, np.arange(1, len(raw) + 1)))[end - 1])  # after the last that is no mark
    code = np.minimum(3, (core - begin) // 4).astype(np.uint64)
    for k in (1, 2, 3):
        code = code << np.uint64(8) | np.where(core - begin >= k, raw[core - k], 0).astype(np.uint64)
    for k in (0, 1):
        code = code << np.uint64(8) | np.where(end - core > k, raw[core + k], 0).astype(np.uint64)
    return keys.view(np.int64), (mixed(code) % np.uint64(CLASSES)).astype(np.int32)


def counted(docs: DataFrame) -> DataFrame:
    """(key, class, c) of every distinct token of the rows of (text as bytes); the end token once for each row."""

    def merged(parts: list[tuple]) -> tuple:
        keys, classes, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, first, place = np.unique(keys, return_index=True, return_inverse=True)
        return keys, classes[first], np.bincount(place, c, len(keys)).astype(np.int64)

    def batch(keys: np.ndarray, classes: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(classes), pa.array(c)], names=["key", "class", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for b in batches:
            for some in runs_of(b.column(0)):
                words, number, _ = numbered_words(some)
                c = np.bincount(number, minlength=len(words))
                parts.append(tuple(x[c > 0] for x in (*described(words), c)))
            parts.append((*described([END]), np.array([b.num_rows])))
            if sum(len(p[0]) for p in parts) > 600_000:
                parts = [merged(parts)]
                if len(parts[0][0]) > 300_000:
                    yield batch(*parts.pop())
        if parts:
            yield batch(*merged(parts))

    return docs.select("text").mapInArrow(tidy(run), "key long, class int, c long").groupBy("key").agg(F.first("class").alias("class"), F.sum("c").alias("c"))


@dataclass(frozen=True)
class Lexicon:
    hot: np.ndarray  # keys in order; the place is the symbol
    hot_logs: np.ndarray  # log10(c + 1) by symbol, 0 for classes
    class_logs: np.ndarray  # log10 of the denominator inside a class by symbol, 0 for hot ones
    share: np.ndarray  # smoothed unigram probability of each symbol
    total: int
    distinct: int

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and keys of words."""
        keys, classes = described(words)
        spot = np.searchsorted(self.hot, keys)
        there = np.append(self.hot, 0)[spot] == keys
        there &= spot < len(self.hot)
        return np.where(there, spot, len(self.hot) + classes).astype("<i4"), keys


def lexicon(counts: DataFrame) -> Lexicon:
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = max(2, -(-n // HOT))
    hot = sorted((r["key"], r["c"]) for r in counts.where(F.col("c") >= least).select("key", "c").collect())  # at most HOT rows
    rare = {r["class"]: (r["n"], r["v"]) for r in counts.where(F.col("c") < least).groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}  # CLASSES rows
    sizes = np.array([rare.get(k, (0, 0)) for k in range(CLASSES)], float)
    occurrences = np.concatenate([[c for _, c in hot], sizes[:, 0]]) + 0.5
    zeros = np.zeros(len(hot))
    return Lexicon(np.array([k for k, _ in hot], np.int64), np.concatenate([np.log10(np.array([c for _, c in hot], float) + 1), np.zeros(CLASSES)]), np.concatenate([zeros, np.log10(sizes.sum(axis=1) + 1)]), occurrences / occurrences.sum(), int(n), int(v))


def encoded(docs: DataFrame, words: Lexicon) -> DataFrame:
    """(doc_id, held_out, symbols, n_tokens, hot_known, hot_log, class_log, rare) of every row: what further passes need of a text."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(words)  # at most HOT + CLASSES entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in batches:
            parts = []
            for some in runs_of(b.column(2)):
                words, number, offsets = numbered_words(some)
                of_word, keys = lex.symbols([*words, END])
                tokens = np.insert(number, offsets[1:], len(words))  # the end token after each text
                at = offsets.astype(np.int64) + np.arange(len(offsets))
                symbols = of_word[tokens]
                cold = symbols >= len(lex.hot)
                n_cold = np.add.reduceat(cold, at[:-1], dtype=np.int64)
                n = np.diff(at)
                parts.append([
                    pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(symbols)]),
                    pa.array(n),
                    pa.array(n - n_cold),
                    pa.array(np.add.reduceat(lex.hot_logs[symbols], at[:-1])),
                    pa.array(np.add.reduceat(lex.class_logs[symbols], at[:-1])),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n_cold]), pa.int32()), pa.array(keys[tokens[cold]])),
                ])
            if parts:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.concat_arrays(x) for x in zip(*parts, strict=True)]], names=["doc_id", "held_out", "symbols", "n_tokens", "hot_known", "hot_log", "class_log", "rare"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, symbols binary, n_tokens long, hot_known long, hot_log double, class_log double, rare array<long>")


class Blocks:
    """Stretches of a token array laid out by step: the k-th tokens of all blocks that have one are neighbours."""

    def __init__(self, flat: np.ndarray, base: np.ndarray, sizes: np.ndarray):
        """`sizes` are at least 1 and descend."""
        longest = int(sizes[0]) if len(sizes) else 0
        self.live = np.searchsorted(-sizes, -np.arange(longest), side="left").tolist()  # blocks with more than k tokens
        self.at = np.cumsum([0, *self.live]).tolist()
        self.symbols = flat[np.concatenate([np.zeros(0, np.int64), *[base[:n] + k for k, n in enumerate(self.live)]])]
        self.last = np.array(self.at, np.int64)[sizes - 1] + np.arange(len(sizes))

    def steps(self, down: bool = False) -> Iterator[tuple[int, int, slice]]:
        order = range(len(self.live) - 1, -1, -1) if down else range(len(self.live))
        return ((k, self.live[k], slice(self.at[k], self.at[k + 1])) for k in order)


@dataclass(frozen=True)
class HiddenMarkov:
    """All arrays below have a row for each state and a column for each token or block.

    Texts are cut into blocks of WINDOW tokens, the first of a text taking what is over. A block maps the distribution of states
    before it to that after it, linearly; these maps, composed along each text, give exact forward and backward values at all
    borders, between which the recursions run over many blocks at once, however long a text is.
    """

    start: np.ndarray  # by state
    step: np.ndarray  # by state and next state
    emit: np.ndarray  # by symbol and state

    def expected(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts (start, step, emit) of whole texts."""
        return self.counts(texts)[:3]

    def _emitted(self, symbols: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.emit[symbols].T)

    def _forward(self, blocks: Blocks, emitted: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distributions after each token, and its probability given those before it; `entry`: before the first tokens."""
        alpha, scale, back = np.empty_like(emitted), np.empty(emitted.shape[1]), np.ascontiguousarray(self.step.T)
        a = entry
        for k, n, here in blocks.steps():
            a = (back @ a[:, :n] if k else a) * emitted[:, here]
            scale[here] = c = a.sum(axis=0)
            a /= c
            alpha[:, here] = a
        return alpha, scale

    def _maps(self, blocks: Blocks, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The map of each block (all are of one length), from the state of its first token to the last one's, and its log scale."""
        n, back = blocks.live[0], np.ascontiguousarray(self.step.T)
        m, log = np.eye(STATES)[:, :, None] * emitted[:, None, :n], np.zeros(n)
        for k, _, here in blocks.steps():
            if k:
                m = (back @ m.reshape(STATES, -1)).reshape(STATES, STATES, n)
                m *= emitted[:, None, here]
            if k % 4 == 3 or k == len(blocks.live) - 1:
                c = m.max(axis=(0, 1))
                m /= c
                log += np.log(c)
        return m, log

    def _backward(self, blocks: Blocks, emitted: np.ndarray, alpha: np.ndarray, scale: np.ndarray, before: np.ndarray | None, beta: np.ndarray, sums: tuple) -> None:
        """Add expected counts; `before`: distributions at the ends of the blocks before (none for first ones), `beta`: values at the ends."""
        start, moves, emit = sums
        for k, n, here in blocks.steps(down=True):
            b = beta[:, :n]
            back = emitted[:, here] * b
            back /= scale[here]
            alpha[:, here] *= b  # now the marginals
            last = alpha[:, blocks.at[k - 1] : blocks.at[k - 1] + n] if k else before
            if last is not None:
                moves += self.step * (last @ back.T)
                beta[:, :n] = self.step @ back
            else:
                start += alpha[:, here].sum(axis=1)
        for j in range(STATES):
            emit[:, j] += np.bincount(blocks.symbols, alpha[j], len(emit))

    def _run(self, texts: list[np.ndarray], sums: tuple | None) -> np.ndarray:
        """Log-likelihood of each text; expected counts are added to `sums`."""
        sizes = np.array([len(t) for t in texts], np.int64)
        whole = -(-sizes // WINDOW) - 1  # blocks after the first
        order = np.lexsort([-(sizes - whole * WINDOW), -whole]) if len(texts) else np.zeros(0, np.int64)
        order = order[sizes[order] > 0]
        log = np.zeros(len(texts))
        if not len(order):
            return log
        flat, base = np.concatenate(texts), np.cumsum(sizes) - sizes
        short, base, rest = (sizes - whole * WINDOW)[order], base[order], whole[order]
        rank = np.argsort(-short, kind="stable")  # of the first blocks, which descend in length
        first = Blocks(flat, base[rank], short[rank])
        emitted = self._emitted(first.symbols)
        alpha, scale = self._forward(first, emitted, np.repeat(self.start[:, None], len(rank), axis=1))
        for k, n, here in first.steps():
            log[order[rank[:n]]] += np.log(scale[here])
        end = np.empty((STATES, len(rank)))
        end[:, rank] = alpha[:, first.last]

        at = np.cumsum(rest) - rest  # number of each text's second block
        starts = np.repeat(base + short - at * WINDOW, rest) + np.arange(rest.sum()) * WINDOW
        most = max(1, HELD // WINDOW)
        slabs = [slice(lo, lo + most) for lo in range(0, len(starts), most)]
        made = [Blocks(flat, starts[s], np.full(len(starts[s]), WINDOW)) for s in slabs] if len(slabs) == 1 else [None] * len(slabs)
        maps, logs = np.empty((STATES, STATES, len(starts))), np.empty(len(starts))
        for s, blocks in zip(slabs, made, strict=True):
            blocks = blocks or Blocks(flat, starts[s], np.full(len(starts[s]), WINDOW))
            maps[:, :, s], logs[s] = self._maps(blocks, self._emitted(blocks.symbols))
        entry, before, after = (np.empty((STATES, len(starts))) for _ in range(3))
        live = [int(np.searchsorted(-rest, -j, side="left")) for j in range(int(rest[0]))]  # texts with more than j later blocks
        a = end
        for j, n in enumerate(live):
            own = at[:n] + j
            before[:, own] = a = a[:, :n]
            entry[:, own] = p = self.step.T @ a
            a = np.einsum("sin,in->sn", maps[:, :, own], p)
            a /= (c := a.sum(axis=0))
            log[order[:n]] += np.log(c) + logs[own]
        if sums is None:
            return log
        beta = np.ones((STATES, len(order)))
        for j in range(len(live) - 1, -1, -1):
            own = at[: live[j]] + j
            after[:, own] = beta[:, : live[j]]
            b = self.step @ np.einsum("sin,sn->in", maps[:, :, own], beta[:, : live[j]])
            beta[:, : live[j]] = b / (before[:, own] * b).sum(axis=0)
        self._backward(first, emitted, alpha, scale, None, beta[:, rank], sums)
        for s, blocks in zip(slabs, made, strict=True):
            blocks = blocks or Blocks(flat, starts[s], np.full(len(starts[s]), WINDOW))
            emitted = self._emitted(blocks.symbols)
            alpha, scale = self._forward(blocks, emitted, entry[:, s])
            self._backward(blocks, emitted, alpha, scale, before[:, s], after[:, s], sums)
        return log

    def counts(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The expected counts and the log-likelihood."""
        sums = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((len(self.emit), STATES))
        return *sums, float(self._run(texts, sums).sum())

    def likelihoods(self, texts: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of the symbols of each whole text, by the scaled forward recursion."""
        return self._run(texts, None) / np.log(10)


def updated(start: np.ndarray, moves: np.ndarray, emit: np.ndarray, share: np.ndarray, weight: float) -> HiddenMarkov:
    """Parameters from expected counts; emissions lean on the unigram shares with the given weight."""
    moves = moves + 1.0
    emit = emit + weight * share[:, None]
    return HiddenMarkov((start + 1) / (start + 1).sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _symbols(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<i4") for x in column.to_pylist()]


def settled(model: HiddenMarkov, share: np.ndarray, expected: Callable[[HiddenMarkov], tuple], least: float = SETTLED) -> HiddenMarkov:
    """Baum-Welch from `model` on, by the sums that `expected` gives, until a pass gains less than the share `least` of the log-likelihood."""
    was = -np.inf
    while True:
        start, moves, emit, log = expected(model)
        model = updated(start, moves, emit, share, 200.0)
        if log - was <= least * abs(log):
            return model
        was = log


def first_texts(train: DataFrame, tokens: int) -> list[np.ndarray]:
    """Distinct short texts with the least hashes, about WARM tokens of `tokens`: the same for every partitioning."""
    odds = min(1.0, WARM / max(1, tokens))
    hashed = F.xxhash64("symbols")
    some = train.where((F.octet_length("symbols") <= 4 * WARM_TEXT) & (F.pmod(hashed, F.lit(1 << 20)) < int(np.ceil(odds * (1 << 20)))))
    out, left = [], 2 * WARM
    for t in _symbols(some.distinct().orderBy(F.xxhash64("symbols"), "symbols").limit(2 * WARM).toArrow()["symbols"].combine_chunks()):
        left -= len(t)
        if left < 0:
            break
        out.append(t)
    return out


def trained(rows: DataFrame, words: Lexicon) -> HiddenMarkov:
    """Baum-Welch over all training rows of `encoded`, until the likelihood settles, from a start that settled on `first_texts`."""
    spark, share = rows.sparkSession, words.share
    train = rows.where("not held_out").select("symbols")
    noise = np.random.default_rng(4).gamma(1.0, size=(len(share), STATES))
    model = HiddenMarkov(np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES), (e := share[:, None] * noise) / e.sum(axis=0))
    if texts := first_texts(train, words.total):
        model = settled(model, share, lambda m: m.counts(texts), WARM_SETTLED)

    def over_all(model: HiddenMarkov) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        shared = spark.sparkContext.broadcast(model)  # HOT + CLASSES rows of STATES numbers at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            sums, held, size = None, [], 0
            for b in batches:
                for t in _symbols(b.column(0)):
                    held.append(t)
                    size += len(t)
                    if size > HELD:
                        sums, held, size = _added(sums, m.counts(held)), [], 0
            if held:
                sums = _added(sums, m.counts(held))
            if sums is not None:
                start, moves, emit, log = sums
                numbers = np.concatenate([[-2 - STATES, -1], np.arange(-1 - STATES, -1), np.flatnonzero(emit.sum(axis=1))]).astype(np.int32)
                values = np.concatenate([np.full((1, STATES), log), start[None], moves, emit[numbers[2 + STATES :]]])
                yield pa.RecordBatch.from_arrays([pa.array(numbers), *[pa.array(values[:, k]) for k in range(STATES)]], names=["symbol", *[f"s{k}" for k in range(STATES)]])

        sums = train.mapInArrow(tidy(run), _EXPECTED).groupBy("symbol").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES)]).toArrow()
        shared.destroy()
        numbers = sums["symbol"].to_numpy()
        values = np.column_stack([sums[f"s{k}"].to_numpy() for k in range(STATES)])
        start, moves, emit, log = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((len(share), STATES)), 0.0
        emit[numbers[numbers >= 0]] = values[numbers >= 0]
        for n, v in zip(numbers[numbers < 0], values[numbers < 0], strict=True):
            if n == -1:
                start = v
            elif n == -2 - STATES:
                log = float(v[0])
            else:
                moves[n + 1 + STATES] = v
        return start, moves, emit, log

    return settled(model, share, over_all)


def _added(a, b):
    return b if a is None else tuple(x + y for x, y in zip(a, b, strict=True))


def scored(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; `held_out` is a boolean column."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select("doc_id", held_out.alias("held_out"), text_bytes().alias("text"))
    counts = saved(counted(texts.where("not held_out")), "lm-counts")
    words = lexicon(counts)
    rows = saved(encoded(texts, words).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    model = spark.sparkContext.broadcast(trained(rows, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            texts = [t for b in held for t in _symbols(b.column(1))]
            rows = pa.concat_arrays([b.column(0) for b in held])
            held.clear()
            return pa.RecordBatch.from_arrays([rows, pa.array(model.value.likelihoods(texts))], names=["row", "log"])

        for b in batches:
            held.append(b)
            if sum(x.column(1).nbytes for x in held) > 4 * HELD:
                yield flush()
        if held:
            yield flush()

    likely = rows.select("row", "symbols").mapInArrow(tidy(run), "row long, log double")
    known = rows.select("row", F.explode("rare").alias("key")).join(counts.where(F.col("c") < max(2, -(-words.total // HOT))).select("key", "c"), "key")
    known = known.groupBy("row").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("rare_log"))
    base = F.col("hot_log") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(words.total + words.distinct + 1))
    score = F.col("log") + F.coalesce("rare_log", F.lit(0.0)) - F.col("class_log")
    out = rows.select("row", "doc_id", "held_out", "n_tokens", "hot_known", "hot_log", "class_log").join(likely, "row").join(known, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, F.coalesce(remainder(F.col("doc_id"), 7), F.lit(0)) == 2)
