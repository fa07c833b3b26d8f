"""Prefix trie, source mixing and Merkle manifest against plain Python, and their SQL."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from lectern.llm import common, merkle, mixing, places, trie
from lectern.llm.common import saved

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_trie(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own.setdefault(c, []).append(((t is not None, t or 0), sha(f"{len(r.encode())}:{r}{x}")[:32], (r, x)))
    own = {c: [z[2] for z in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members, kids = {}, collections.Counter()
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, kept = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            kept[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = {p: sha(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))) for p, m in members.items()}
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], kept[p], ends[p]) for p, m in members.items()), key=repr)


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, "mine") for r in rows], "conv_id long, turn long, role string, text string, path string")
    return sorted((tuple(r) for r in trie.trie(saved(trie.rebuilt(df), "test")).collect()), key=repr)


def odd_conversations(seed):
    rng, rows = random.Random(seed), []
    for c in range(40):
        for t in range(rng.choice([1, 3, 9, 30])):
            for _ in range(rng.choice([1, 1, 1, 2])):  # ties and repeated rows
                rows.append((rng.choice([c, c, c, None]), rng.choice([t, t, t, None]), rng.choice(["u", "a", None, ""]), rng.choice(["x", "x", "é", None, "", "y" * 9000])))
    return rows


@pytest.mark.parametrize("shard", [300_000, 40])
@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_plain_python(spark, monkeypatch, shard, seed):
    monkeypatch.setattr(trie, "SHARD_TURNS", shard)
    monkeypatch.setattr(trie, "WIDTH", 4)
    rows = odd_conversations(seed)
    assert trie_of(spark, rows) == plain_trie(rows)


@pytest.mark.parametrize("hot", [False, True])
def test_trie_of_one_conversation_copied(spark, monkeypatch, hot):
    monkeypatch.setattr(trie, "SHARD_TURNS", 40)
    if hot:  # the ways for many parents
        monkeypatch.setattr(trie, "sized", lambda df: df)
        monkeypatch.setattr(common, "HOT_ROWS", 2)
    rows = [(c, t, "u", "same") for c in range(90) for t in range(3)] + [(100 + c, 0, "u", f"own {c}") for c in range(60)]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_trie_of_one_row_and_of_none(spark):
    assert trie_of(spark, [(7, None, None, None)]) == plain_trie([(7, None, None, None)])
    assert trie_of(spark, [(None, 1, "u", "x")]) == []


def test_shards_sort_as_strings_do():
    rng = random.Random(3)
    paths = [bytes(b"".join(bytes([rng.randrange(3)] * 16) for _ in range(rng.choice([0, 1, 5, 40])))) for _ in range(300)]
    r = trie.Rows(np.frombuffer(b"".join(paths), ">u8").reshape(-1, 2).astype(np.uint64), np.array([len(p) // 16 for p in paths]), np.arange(300)[::-1].copy(), {})
    order, fresh = trie.sorted_rows(r)
    assert order.tolist() == sorted(range(300), key=lambda i: (paths[i], 300 - i))
    for k, (a, b) in enumerate(zip(order, order[1:])):
        same = next((d for d in range(len(paths[b]) // 16) if paths[a][16 * d : 16 * d + 16] != paths[b][16 * d : 16 * d + 16]), len(paths[b]) // 16)
        assert fresh[k + 1] == same + 1


def plain_merkle(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(one, [*r[:4], t])))

    def built(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(paths):
                a = at[i] // 16 * 16
                p.append(("".join(nodes[a : at[i]]), "".join(nodes[at[i] + 1 : a + 16])))
                at[i] //= 16
            nodes = [sha("".join(nodes[a : a + 16])) for a in range(0, len(nodes), 16)]
        return nodes[0], paths

    by, out, tops = {}, [], []
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for s in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        tops.append((own, *built([leaf(r, r[4]) for r in own])))
    root, above = built([t[1] for t in tops]) if tops else ("", [])
    for (own, top, paths), up in zip(tops, above):
        for r, p in zip(own, paths):
            now = leaf(r, r[4].translate(low)) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r, r[4])
            for a, b in p + up:
                now = sha(a + now + b)
            out.append((r[0], leaf(r, r[4]), top, root, sha("".join(a + b for a, b in p + up)), now, now == root))
    return sorted(out, key=repr)


def odd_documents():
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(300)] + [(None, "s1", None, None, None)] * 40 + [(5, "lone É", "de", 3, ""), (6, None, "en", None, None), (6, None, "en", 0, "x" * 200_000), (6, None, "en", 0, "Y")]
    return rows + [(1000 + k, f"many {k}", "en", 1, "A") for k in range(20)]


def merkle_docs(spark, rows):
    return spark.createDataFrame([(*r, "mine", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, digest string, rank int")


@pytest.mark.parametrize("hot", [False, True])
def test_manifest_equals_plain_python(spark, monkeypatch, hot):
    from pyspark.sql import functions as F

    if hot:
        monkeypatch.setattr(common, "HOT_ROWS", 2)
        monkeypatch.setattr(merkle, "sized", lambda df: df)
        monkeypatch.setattr(places, "RANGE_ROWS", 50)
    altered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    for rows in (odd_documents(), [(3, "s", "en", 1, "A")], [(k, "s", "en", 1, "A") for k in range(17)]):
        found = merkle.verified(merkle.proofs(merkle.manifest(merkle_docs(spark, rows), altered)))
        assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_merkle(rows)


def test_asking_for_some_leaves(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(200)]
    of = merkle.manifest(merkle_docs(spark, rows))
    wanted = of.places.where("doc_id % 40 = 7")
    found = merkle.verified(merkle.proofs(of, wanted))
    expected = [r for r in plain_merkle(rows) if r[0] % 40 == 7]
    assert sorted((tuple(r)[:5] for r in found.collect()), key=repr) == sorted((r[:5] for r in expected), key=repr)
    assert found.where("not verified").count() == 0
    empty = merkle.manifest(merkle_docs(spark, rows).limit(0))
    assert merkle.proofs(empty).count() == 0


@pytest.mark.parametrize("name, table, module, plain, columns", [
    ("op11_prefix_trie", "conversations", trie, plain_trie, "conv_id, turn, role, text"),
    ("op13_merkle_manifest", "documents", merkle, plain_merkle, "doc_id, source, lang, n_chars, text"),
])
def test_sql_gives_the_same(spark, name, table, module, plain, columns):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    out = module.query(spark, SF)
    rows = c.sql(module.ORACLE)
    assert rows.columns == out.columns
    expected = plain(c.sql(f"SELECT {columns} FROM {table}").fetchall())
    assert sorted(rows.fetchall(), key=repr) == sorted((tuple(r) for r in out.collect()), key=repr) == expected


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rate = (total - sum(2 * sizes[s] for s in capped)) / (sum(weight[s] for s in free) or 1)
        more = {s for s in free if 2 * sizes[s] < rate * weight[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in capped else rate * weight[s] for s in order}
        capped |= more


@pytest.mark.parametrize("hot", [False, True])
def test_mix_reaches_its_targets(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(common, "HOT_ROWS", 2)
        monkeypatch.setattr(mixing, "sized", lambda df: df)
    rng = random.Random(4)
    rows = [(k + 10, rng.choice(["a", "b", "É", "z", "", None]), "w " * rng.choice([1, 3, 3, 3, 10, rng.randrange(60)])) for k in range(900)]
    rows += [(None, "b", None), (1, "b", " \t"), (1, "b", "x"), (1, "b", "x"), (2, "a", "v " * 900), (3, "blank", ""), (4, "blank", None)]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, source string, text string, size string")
    out = mixing.mixed_documents(docs)
    got = collections.Counter(tuple(r) for r in out.collect())
    assert got == collections.Counter(tuple(r) for r in mixing.mixed_documents(docs.repartition(7, "text")).collect())
    sizes, count = collections.Counter(), collections.Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    goal = plain_targets(sizes)
    source = {i: s for i, s, _ in rows}  # rows that share an id share their source
    for (i, size, whole, target, taken), n in got.items():
        assert taken in (0, size, 2 * size) and whole == sizes[source[i]] and abs(target - goal[source[i]]) < 1e-6
        count[source[i]] += n * taken
    assert all(abs(count[s] - goal[s]) <= 1 for s in sizes), (count, goal)
    assert sum(got.values()) == len(rows) and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_knapsack_finds_the_nearest_sum():
    rng = random.Random(5)
    for _ in range(60):
        size = np.array(sorted(rng.sample(range(1, 40), rng.randrange(1, 6))))
        left = np.array([rng.randrange(0, 4) for _ in size])
        budget = rng.randrange(0, 120)
        sums = {0}
        for s, n in zip(size.tolist(), left.tolist()):
            sums = {x + k * s for x in sums for k in range(n + 1)}
        out = mixing.knapsack(size, left, budget)
        assert (out <= left).all() and (out >= 0).all()
        got = int((out * size).sum())
        assert abs(got - budget) == min(abs(x - budget) for x in sums), (size, left, budget, got)
