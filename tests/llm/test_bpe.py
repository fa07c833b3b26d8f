import base64
import hashlib
import random

import public_tokenizers
import tiktoken

from lectern.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library_on_random_texts():
    rng, ref, enc = random.Random(3), reference(), bpe.Encoder(PATH)
    pieces = ["'s", "'", "re", "'ve", "'ll", "l", "v", "e", "r", "d", " ", "  ", "\n", "\t", " ", "　", "é", "汉", "1", "²", "٣", "!", "...", "\0", "😀", "a", "The", "́", "''", "'S", "\r\n", "\x1c", "\x85"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(0, 40))) for _ in range(4000)] + ["", " ", "a" * 5000, "ab" * 300 + "'re" * 100, " " * 700]
    for text, (ids, offsets) in zip(texts, enc.encode([t.encode() for t in texts]), strict=True):
        assert ids == ref.encode_ordinary(text), repr(text)
        assert enc.decode(ids) == text.encode()
        assert len(offsets) == 0 or offsets[0] == 0


def test_query_columns_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "Hello there's", None)], "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, PATH).collect())
    ref, empty = reference(), hashlib.sha256(b"").hexdigest()
    ids = ref.encode_ordinary("Hello there's")
    assert got == sorted([(1, 0, empty, empty), (2, 0, empty, empty), (2, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"Hello there's").hexdigest())])


def test_encode_then_decode_round_trip_and_empty_table(spark):
    df = spark.createDataFrame([(1, "naïve  test\n\n ok"), (2, None)], "doc_id long, text string")
    out = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted((r.doc_id, bytes(r.decoded)) for r in out) == [(1, "naïve  test\n\n ok".encode()), (2, b"")]
    assert bpe.digests(df.limit(0), PATH).count() == 0
