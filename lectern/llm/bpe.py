"""Byte-level BPE by a table of ranks, encoding and decoding whole texts.

Pre-tokens are found without a regular expression: each code point has a class, each class is a function on the states of a
small automaton, and the functions of a block of characters are composed side by side for all blocks (composition is
associative), so that the states of all characters follow without a loop over a text. The slices between token starts go to
pair merging with a cache. Null texts count as empty (no ids), bytes that are not UTF-8 as symbols; rows keep their multiplicity. One map, no shuffle;
long texts are scanned whole, and an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

SEP, SPACE, WS, LETTER, SINGLE, R, V, L, E, NUMBER, APOS, OTHER = range(12)
START, S_SPACE, S_WS, S_LETTER, S_NUMBER, S_PUNCT, S_APOS, S_AR, S_AV, S_AL, S_DONE = range(11)
LETTERS = (LETTER, SINGLE, R, V, L, E)
BLOCK = 128
#: White space of the pattern, beside the ASCII controls.
WHITE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token starts, by state and class. A contraction's letters are settled afterwards."""
    step, starts = np.zeros((11, 12), np.uint8), np.zeros((11, 12), bool)
    for s in range(11):
        white = s in (S_SPACE, S_WS)
        step[s, [SEP, SPACE, WS, NUMBER, OTHER]] = START, S_SPACE, S_WS, S_NUMBER, S_PUNCT
        step[s, APOS] = S_PUNCT if s in (S_PUNCT, S_APOS, S_SPACE) else S_APOS
        step[s, list(LETTERS)] = S_LETTER
        starts[s, [SPACE, WS]] = not white
        starts[s, NUMBER] = s not in (S_NUMBER, S_SPACE)
        starts[s, [OTHER, APOS]] = s not in (S_PUNCT, S_APOS, S_SPACE)
        starts[s, list(LETTERS)] = s not in (S_LETTER, S_AR, S_AV, S_AL, S_SPACE)
    step[S_APOS, [SINGLE, R, V, L]] = S_DONE, S_AR, S_AV, S_AL
    starts[S_APOS, SINGLE] = False
    step[S_AR, E] = step[S_AV, E] = step[S_AL, L] = S_DONE
    return step, starts


STEP, STARTS = _automaton()


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = WS
    for chars, kind in ((" ", SPACE), ("'", APOS), ("stmd", SINGLE), ("r", R), ("v", V), ("l", L), ("e", E)):
        out[[ord(c) for c in chars]] = kind
    return out


def token_starts(kinds: np.ndarray) -> np.ndarray:
    """Where tokens start, for the classes of texts that each end with SEP."""
    n = len(kinds)
    nb = -(-n // BLOCK)
    grid = np.full((BLOCK, nb), SEP, np.uint8)
    padded = np.zeros(nb * BLOCK, np.uint8)
    padded[:n] = kinds
    grid[:] = padded.reshape(nb, BLOCK).T
    flat = STEP.reshape(-1)
    composed = np.repeat(np.arange(11, dtype=np.uint8)[:, None], nb, axis=1)
    for t in range(BLOCK):
        composed = flat[composed * np.uint8(12) + grid[t]]
    enter, now = np.zeros(nb, np.uint8), START
    for b, f in enumerate(composed.T.tolist()):
        enter[b] = now
        now = f[now]
    before = np.empty((BLOCK, nb), np.uint8)
    state = enter
    for t in range(BLOCK):
        before[t] = state
        state = flat[state * np.uint8(12) + grid[t]]
    before = before.T.reshape(-1)[:n]
    out = STARTS[before, kinds]
    after = np.concatenate([before[1:], [START]])
    # A pair of letters completed a contraction: neither starts a token.
    two = np.flatnonzero((after == S_DONE) & (before >= S_AR))
    out[two] = out[two - 1] = False
    # The last of a run of white space before anything else stands alone or leads what follows.
    white = (kinds == SPACE) | (kinds == WS)
    following = np.concatenate([kinds[1:], [SEP]])
    out |= white & ~((following == SPACE) | (following == WS) | (following == SEP))
    return out & (kinds != SEP)


class Encoder:
    """A rank table with a bounded cache of merged slices."""

    def __init__(self, path: str, limit: int = 250_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.limit = limit

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a slice: the adjacent pair of lowest rank, leftmost first, is merged until no pair has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 80:
            return self._merged_long(parts)
        pairs = [ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == 1 << 40:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 40)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 40)
        return tuple(ranks[p] for p in parts)

    def _merged_long(self, parts: list[bytes]) -> tuple[int, ...]:
        ranks, n = self.ranks, len(parts)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] + parts[j] != both:
                continue
            parts[i], alive[j], after[i] = both, False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := ranks.get(x := parts[k] + parts[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, x))
        return tuple(ranks[p] for p, a in zip(parts, alive, strict=True) if a)

    def encode(self, texts: list[bytes]) -> list[tuple[list[int], np.ndarray]]:
        """Ids of each text, and the byte offset at which each of its slices starts."""
        buffer = b"\0".join([*texts, b""])
        points = np.frombuffer(buffer.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = classes()[points]
        width = (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int64)
        width[(points >= 0xDC80) & (points <= 0xDCFF)] = 1  # a byte that is not UTF-8 stands for itself
        at = np.cumsum(width) - width
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        kinds[np.searchsorted(at, ends)] = SEP
        begin = at[token_starts(kinds)]
        cache, out = self.cache, []
        cuts = np.searchsorted(begin, np.concatenate([[0], ends + 1]))
        for k, end in enumerate(ends.tolist()):
            own = begin[cuts[k] : cuts[k + 1]]
            edges = own.tolist()
            ids: list[int] = []
            for a, b in zip(edges, [*edges[1:], end], strict=True) if edges else ():
                piece = buffer[a:b]
                got = cache.get(piece)
                if got is None:
                    got = self.merged(piece)
                    if len(piece) < 64:
                        cache[piece] = got
                ids += got
            out.append((ids, own - (end - len(texts[k]))))
            if len(cache) > self.limit:
                cache.clear()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slices(texts: list[bytes], most: int = 1 << 20) -> list[list[bytes]]:
    """Texts in groups of about a megabyte, which keeps the arrays of a scan in cache."""
    out: list[list[bytes]] = [[]]
    size = 0
    for t in texts:
        if size > most:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t)
    return out


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every row with `ids` and `slice_offsets` (bytes)."""

    def kernel(texts: list[bytes]) -> list[pa.Array]:
        got = [x for some in slices(texts) for x in encoder(path).encode(some)]
        return [pa.array([x[0] for x in got], pa.list_(pa.int32())), pa.array([x[1] for x in got], pa.list_(pa.int32()))]

    return append_columns(df, text, [("ids", T.ArrayType(T.IntegerType())), ("slice_offsets", T.ArrayType(T.IntegerType()))], kernel)


def decode(df: DataFrame, path: str) -> DataFrame:
    """Every row with `decoded`, the bytes of its `ids`; a column of that name is replaced."""
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != "decoded"])
    out = T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        for b in batches:
            yield b.append_column("decoded", pa.array([encoder(path).decode(x or []) for x in b.column("ids").to_pylist()], pa.binary()))

    return df.mapInArrow(run, out)


def digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every row with its number of tokens and the digests of its ids and of the text that they decode to."""

    def kernel(texts: list[bytes]) -> list[pa.Array]:
        e = encoder(path)
        names = e.__dict__.setdefault("names", [b"%d" % i for i in range(len(e.tokens))])
        n, ids_sha, text_sha = [], [], []
        for some in slices(texts):
            for ids, _ in e.encode(some):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(b" ".join(map(names.__getitem__, ids))).hexdigest())
                text_sha.append(hashlib.sha256(e.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

    return append_columns(df, text, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], kernel)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
