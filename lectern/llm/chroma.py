"""Audio fingerprints: integral-image filters over pitch-class frames, packed into 32-bit integers; search by offset histograms.

Samples become frames of energy by pitch class; sums over any rectangle of (frame, class) come from an integral image in four
look-ups; FILTERS differences of such sums, two bits each, make one integer for each frame. Recordings with equal
fingerprints are one class. Every query is compared with every class at every offset where LEAST_OVERLAP integers or more
meet, and matches at the offset with the least share of differing bits. Noise spares few whole integers, and parts of them short
enough to be spared are common to all recordings, so that no index leaves out what need not be compared. The comparison is
exact (a correlation of bits, by Fourier transform) and goes by blocks of queries and of classes. Shorter overlaps could meet
by chance: there equal integers have to vote for the offset. Only class representatives are compared.

A null or too short recording has an empty fingerprint, is in no class with others and matches nothing. Rows that share
an id are aligned each; a null id is kept without a class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, saved

RATE, FRAME, HOP = 4000, 1024, 256
LOWEST, HIGHEST = 110.0, 1760.0
#: Frames that the widest filter covers, and the filters by rule: (kind, first class, classes, frames).
SPAN = 16
FILTERS = [(k % 4, 5 * k % 12, 2 + k % 5 if k % 5 != 4 else 12, (4, 8, 12, 16)[k // 4]) for k in range(16)]
#: Two bits each by three fixed borders, in Gray code.
BORDERS, GRAY = np.array([-0.25, 0.0, 0.25]), np.array([0, 1, 3, 2], np.uint32)
LEAST_VOTES, LARGEST_ERROR = 3, 0.25
#: Integers of an overlap that is compared without votes. Those SPAN apart share no frame.
LEAST_OVERLAP = SPAN
#: Queries and classes that meet in a group of the comparison, and numbers that it holds at once.
QUERIES_TOGETHER, CLASSES_TOGETHER, HELD = 256, 4096, 1 << 22
#: Notes of the recordings that the query derives from vectors: length in samples, lowest note, and range in semitones.
NOTE, ROOT, RANGE = 256, 220.0, 24


def _classes() -> np.ndarray:
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(f), 12), np.float32)
    heard = np.flatnonzero((f >= LOWEST) & (f <= HIGHEST))
    out[heard, np.round(12 * np.log2(f[heard] / 440.0)).astype(int) % 12] = 1
    return out


CLASS_OF_BIN, TAPER = _classes(), np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frames, 12) energies by pitch class, each frame of unit length; silent frames are zero."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    framed = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP][:n] * TAPER
    power = np.abs(np.fft.rfft(framed)).astype(np.float32) ** 2 @ CLASS_OF_BIN
    size = np.linalg.norm(power, axis=1, keepdims=True)
    return np.where(size > 1e-6, power / np.maximum(size, 1e-6), 0.0).astype(float)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for each frame that has SPAN frames from it."""
    c = chroma(samples)
    n = len(c) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    wide = np.concatenate([c, c], axis=1)  # pitch classes go round
    integral = np.zeros((len(c) + 1, 25))
    integral[1:, 1:] = wide.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)
    area = lambda x, w, y, h: integral[at + x + w, y + h] - integral[at + x, y + h] - integral[at + x + w, y] + integral[at + x, y]
    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        half, mid = w // 2, max(1, h // 2)
        if kind == 0:  # earlier against later
            a, b = area(0, half, y, h), area(half, w - half, y, h)
        elif kind == 1:  # lower against higher
            a, b = area(0, w, y, mid), area(0, w, y + mid, h - mid)
        elif kind == 2:  # the diagonals of a chequer
            a = area(0, half, y, mid) + area(half, w - half, y + mid, h - mid)
            b = area(half, w - half, y, mid) + area(0, half, y + mid, h - mid)
        else:  # the middle against the edges
            third = w // 4
            b = area(third, w - 2 * third, y, h)
            a = area(0, w, y, h) - b
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(BORDERS, np.log((1 + a) / (1 + b)))]
    return out


def pcm16(cell: bytes | None) -> np.ndarray:
    """Samples of little-endian 16-bit mono PCM at RATE."""
    return np.frombuffer(cell or b"", "<i2") / 32768.0


def melody(vector: list[float] | None) -> np.ndarray:
    """A recording whose notes are the numbers of a vector; null numbers are rests."""
    v = np.array([np.nan if x is None else x for x in vector or []], float)
    rest = ~np.isfinite(v)
    pitch = ROOT * 2 ** (np.clip(np.round(RANGE / 2 + RANGE * np.where(rest, 0, v)), 0, RANGE) / 12)
    phase = np.cumsum(np.repeat(2 * np.pi * pitch / RATE, NOTE))
    return np.sin(phase) * np.repeat(~rest, NOTE)


def fingerprints(recordings: DataFrame, rec_id: str, audio: str, decode: Callable[[object], np.ndarray] = pcm16) -> DataFrame:
    """(rec_id, prints) of every row; prints are the integers as longs."""
    recordings.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(decode(x)).astype(np.int64) for x in b.column(1).to_pylist()], pa.list_(pa.int64()))], names=["rec_id", "prints"])

    return recordings.select(F.col(rec_id).cast("long").alias("rec_id"), F.col(audio)).mapInArrow(run, "rec_id long, prints array<long>")


def _spectra(prints: list[np.ndarray], size: int) -> np.ndarray:
    """(frequencies, prints, 32): transforms of the bits as +1 and -1, nothing beyond the end; sums of them are whole numbers."""
    bits = np.zeros((len(prints), 32, size), np.float32 if size <= 4096 else np.float64)
    for k, p in enumerate(prints):
        bits[k, :, : len(p)] = 1.0 - 2.0 * ((p >> np.arange(32)[:, None]) & 1)
    return np.ascontiguousarray(np.fft.rfft(bits).transpose(2, 0, 1))


def closest(asked: list[np.ndarray], others: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, float]]:
    """(place in asked, place in others, offset, equal integers, share of differing bits) of the pairs within LARGEST_ERROR.

    The offset is the one with the least share of all that leave LEAST_OVERLAP integers, then the one next to zero.
    """

    def by_size(prints):  # recordings of one power of two are transformed together
        out = {}
        for k, p in enumerate(prints):
            if len(p) >= LEAST_OVERLAP:
                out.setdefault(1 << (len(p) - 1).bit_length(), []).append(k)
        return out.items()

    def lengths(prints, some):
        n = np.array([len(prints[k]) for k in some])
        return n[:1] if (n == n[0]).all() else n

    for wide, qs in by_size(asked):
        for high, cs in by_size(others):
            size = wide + high
            most = max(1, HELD // (32 * size))
            for q in (qs[k : k + most] for k in range(0, len(qs), most)):
                left, few = _spectra([asked[k] for k in q], size).conj(), max(1, min(most, HELD // (size * len(q))))
                for c in (cs[k : k + few] for k in range(0, len(cs), few)):
                    same = np.fft.irfft(left @ _spectra([others[k] for k in c], size).transpose(0, 2, 1), size, axis=0)
                    offset = np.arange(size)
                    offset[high:] -= size
                    o, a, b = offset[:, None, None], lengths(asked, q)[None, :, None], lengths(others, c)[None, None]
                    n = np.minimum(a, b - o) - np.maximum(0, -o)
                    need = np.where(n >= LEAST_OVERLAP, 32 * n * (1 - 2 * LARGEST_ERROR) - 0.5, np.inf).astype(same.dtype)
                    at, i, j = np.nonzero(same >= need)
                    overlap = np.broadcast_to(n, same.shape)[at, i, j]
                    error = (32 * overlap - np.rint(same[at, i, j].astype(float))) / (64.0 * overlap)
                    order = np.lexsort((-offset[at], np.abs(offset[at]), error, j, i))
                    first = np.ones(len(order), bool)
                    first[1:] = (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)
                    for k in order[first]:
                        x, y, d = asked[q[i[k]]], others[c[j[k]]], int(offset[at[k]])
                        m = int(overlap[k])
                        votes = int((x[max(0, -d) :][:m] == y[max(0, d) :][:m]).sum())
                        yield q[i[k]], c[j[k]], d, votes, float(error[k])


def compared(reps: DataFrame) -> DataFrame:
    """(q, class_id, offset, votes, bit_error) of classes (class_id, prints, asked): every asked one against all others."""
    bounded_batches(reps.sparkSession)
    n, n_asked = reps.agg(F.count("*"), F.coalesce(F.sum("asked"), F.lit(0))).first()
    blocks, cells = -(-n_asked // QUERIES_TOGETHER), max(1, -(-n // CLASSES_TOGETHER))
    if not blocks:
        return reps.sparkSession.createDataFrame([], "q long, class_id long, offset int, votes long, bit_error double")
    place, upto = F.xxhash64("class_id"), lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    asked = reps.where("asked = 1").select(F.pmod(place, F.lit(blocks)).cast("int").alias("block"), upto(cells).alias("cell"), F.lit(0).alias("side"), "class_id", "prints")
    others = reps.select(upto(blocks).alias("block"), F.pmod(place, F.lit(cells)).cast("int").alias("cell"), F.lit(1).alias("side"), "class_id", "prints")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, held = None, [], []
        for b in batches:
            keys = np.stack([b.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), b.num_rows]
            for at, end in zip(cuts, cuts[1:]):
                if at == end:
                    continue
                block, cell, side = keys[at].tolist()
                if group != (block, cell):
                    group, ids, held = (block, cell), [], []
                own = b.column(3)[at:end].to_pylist()
                prints = [x.values.to_numpy() for x in b.column(4)[at:end]]
                if side == 0:
                    ids += own
                    held += [x.copy() for x in prints]
                    continue
                found = [(ids[i], own[j], *rest) for i, j, *rest in closest(held, prints) if ids[i] != own[j]]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["q", "class_id", "offset", "votes", "bit_error"])

    dealt = asked.unionByName(others).repartition(blocks * cells, "block", "cell").sortWithinPartitions("block", "cell", "side")
    return dealt.mapInArrow(run, "q long, class_id long, offset int, votes long, bit_error double")


def aligned(prints: DataFrame, queries) -> DataFrame:
    """Classes and alignments, as rows (kind, rec_id, class_id, offset, votes, bit_error).

    kind 'member': a recording and its class, the smallest id with the same fingerprint. kind 'match': the class of a query
    (`queries`: a condition on rec_id) and another class, with the offset in frames of the query in the match.
    """
    rows = saved(prints, "chroma-prints")
    key = F.sha2(F.array_join("prints", ","), 256)
    usable = rows.where("size(prints) > 0 and rec_id is not null").withColumn("key", key)
    classes = saved(usable.groupBy("key").agg(F.min("rec_id").alias("class_id"), F.max(queries.cast("int")).alias("asked")), "chroma-classes")
    members = usable.select("rec_id", "key").join(classes.select("key", "class_id"), "key").select("rec_id", "class_id")
    alone = rows.where("size(prints) = 0 or rec_id is null").select("rec_id", F.col("rec_id").alias("class_id"))
    reps = usable.withColumnRenamed("rec_id", "class_id").join(classes, ["key", "class_id"]).dropDuplicates(["key"])
    reps = saved(reps.select("class_id", "prints", "asked"), "chroma-reps")
    near = saved(compared(reps), "chroma-near")
    places = reps.select("class_id", F.size("prints").alias("c_n"), F.posexplode("prints").alias("at", "code"))
    asked = reps.where("asked = 1").select(F.col("class_id").alias("q"), F.size("prints").alias("q_n"), F.posexplode("prints").alias("q_at", "code"))
    lead, lag = F.greatest("offset", F.lit(0)), F.greatest(-F.col("offset"), F.lit(0))
    votes = asked.join(places, "code").where("q <> class_id").withColumn("offset", F.col("at") - F.col("q_at")).withColumn("n", F.least(F.col("q_n") - lag, F.col("c_n") - lead))
    votes = votes.where(f"n < {LEAST_OVERLAP}").groupBy("q", "class_id", "offset", "n").agg(F.count("*").alias("votes")).where(f"votes >= {LEAST_VOTES}").join(near.select("q", "class_id"), ["q", "class_id"], "left_anti")
    both = votes.join(reps.select(F.col("class_id").alias("q"), F.col("prints").alias("x")), "q").join(reps.select("class_id", F.col("prints").alias("y")), "class_id")
    both = both.withColumn("x", F.slice("x", lag + 1, F.col("n"))).withColumn("y", F.slice("y", lead + 1, F.col("n")))
    errors = F.expr("aggregate(zip_with(x, y, (a, b) -> bit_count(a ^ b)), 0L, (s, z) -> s + z) / (32.0D * n)")
    short = both.withColumn("bit_error", errors).where(F.col("bit_error") <= LARGEST_ERROR)
    short = short.groupBy("q", "class_id").agg(F.max(F.struct((-F.col("bit_error")).alias("e"), "votes", (-F.abs("offset")).alias("near"), "offset", "bit_error")).alias("b"))
    matches = near.unionByName(short.select("q", "class_id", F.col("b.offset").cast("int").alias("offset"), "b.votes", "b.bit_error"))
    nothing = [F.lit(None).cast("int").alias("offset"), F.lit(None).cast("long").alias("votes"), F.lit(None).cast("double").alias("bit_error")]
    own = members.unionByName(alone).select(F.lit("member").alias("kind"), "rec_id", "class_id", *nothing)
    return own.unionByName(matches.select(F.lit("match").alias("kind"), F.col("q").alias("rec_id"), "class_id", F.col("offset").cast("int").alias("offset"), "votes", "bit_error"))


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return aligned(fingerprints(vectors, "vec_id", "embedding", melody), F.col("rec_id") % 100 == 0)
