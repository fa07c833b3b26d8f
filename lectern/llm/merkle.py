"""Merkle manifest of a data set: one digest for all documents, and for each document the proof that it is among them.

A document's leaf is the digest of its fields. Inside a source, leaves stand in the order of doc_id; each run of FANOUT
consecutive nodes becomes a node, level by level, until one is left, the source's subroot. The subroots, in the order of the
sources, become the root in the same way. What is stored is a content-addressed graph: a record for each distinct digest with
its children. A request for a leaf descends from the root by the digits of its rank, base FANOUT: it looks up the digest that
it has reached, takes the child that the digit names and keeps the other children as a segment of the proof; at the leaf the
segments are reversed. Requests that share the beginning of their ranks descend together, so each node of the graph is looked
up once, however many leaves below it are asked for, and no key of these joins grows with the table.

Rows that share a doc_id in a source are ordered by leaf; equal rows are leaves of their own. Null fields are `-`, a null source
is a source, which comes first, a null doc_id comes first in its source, an empty text differs from a null one. Very long texts
are digested whole where they are read; only digests travel. Further columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, saved, sized, spread_join
from .places import placed

FANOUT, DIGIT_BITS = 16, 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a document whose text is `text`."""
    return F.sha2(F.concat(*[field(F.col(c)) for c in FIELDS[:-1]], field(text)), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


@dataclass
class Manifest:
    """The records (digest, children) of both tiers by level, the root (digest, height), and the leaves' ranks.

    `places` has (source_no, rank, doc_id, height): the ranks by which leaves are asked for. A child of the lowest level of
    the upper tier is a subroot and tells its height; a leaf tells its doc_id and, if it was tampered with, what it is now.
    """

    lower: list[DataFrame]
    upper: list[DataFrame]
    root: DataFrame
    places: DataFrame


def _height(n: Column) -> Column:
    """Levels above n nodes."""
    steps = F.sequence(F.lit(1), F.lit(63 // DIGIT_BITS))
    return F.when(n <= 1, 0).otherwise(F.size(F.filter(steps, lambda k: F.power(F.lit(float(FANOUT)), k) < n)) + 1)


def _tier(nodes: DataFrame, told: list[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """(records by level, tops) of `nodes` (tree, place, height, digest, told): each tree is built up to its height."""
    levels, tops = [], nodes.where("height = 0").select("tree", "digest", F.lit(0).alias("height"), *told)
    level, rest = 0, nodes.where("height > 0")
    while not rest.isEmpty():
        level += 1
        own = told if level == 1 else []
        kids = F.sort_array(F.collect_list(F.struct("place", "digest", *own)))
        runs = rest.groupBy("tree", F.shiftright("place", DIGIT_BITS).alias("place"), "height").agg(kids.alias("kids"))
        runs = runs.withColumn("kids", F.transform("kids", lambda k: F.struct(k["digest"].alias("digest"), *[k[t].alias(t) for t in own])))
        runs = saved(runs.withColumn("digest", F.sha2(F.array_join(F.transform("kids", lambda k: k["digest"]), ""), 256)), f"{name}-{level}")
        levels.append(saved(runs.groupBy("digest").agg(F.first("kids").alias("kids")), f"{name}-records-{level}"))
        done = runs.where(f"height = {level}").select("tree", "digest", "height", *[F.lit(None).cast(nodes.schema[t].dataType).alias(t) for t in told])
        tops = tops.unionByName(done)
        rest = runs.where(f"height > {level}").select("tree", "place", "height", "digest")
    return levels, saved(tops, f"{name}-tops")


def manifest(docs: DataFrame, altered: Column | None = None) -> Manifest:
    """The manifest of `docs`; `altered`, if given, says of which documents a tampered leaf (A-Z of the text lowered) is kept."""
    text = F.col("text").cast("string")
    now = F.when(altered, leaf(lowered(text))) if altered is not None else F.lit(None).cast("string")
    leaves = saved(docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf(text).alias("digest"), now.alias("altered")), "merkle-leaves")
    order = [F.col("source").asc_nulls_first()]
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("_s")
    sources = placed(saved(leaves.groupBy("source").agg(F.count("*").alias("n")), "merkle-sources"), order, "tree", "merkle-sources")
    keyed = placed(leaves, [*order, F.col("doc_id").asc_nulls_first(), F.col("digest").asc()], "g", "merkle-leaves").withColumn("_s", key)
    starts = keyed.groupBy("_s").agg(F.min("g").alias("start"))
    sources = saved(sources.select(key, "tree", _height(F.col("n")).alias("height")).join(starts, "_s"), "merkle-trees")
    small = sized(sources)
    nodes = keyed.join(small, "_s") if small is not sources else spread_join(keyed, sources, ["_s"], "inner", hot_keys(keyed, ["_s"], "merkle"), "merkle")
    nodes = saved(nodes.select("tree", (F.col("g") - F.col("start")).alias("place"), "height", "digest", "doc_id", "altered"), "merkle-nodes")
    lower, tops = _tier(nodes, ["doc_id", "altered"], "merkle-lower")
    count = tops.count()
    subroots = tops.select(F.lit(0).alias("tree"), F.col("tree").alias("place"), _height(F.lit(count)).alias("height"), "digest", F.col("height").alias("below"), "doc_id", "altered")
    upper, root = _tier(subroots, ["below", "doc_id", "altered"], "merkle-upper")
    return Manifest(lower, upper, root, nodes.select(F.col("tree").alias("source_no"), F.col("place").alias("rank"), "doc_id", "height"))


def _descend(frontier: DataFrame, records: DataFrame, told: list[str], name: str) -> DataFrame:
    """The children of all nodes of `frontier` (place, digest, path, ..) with their places and longer paths."""
    frontier = saved(frontier, f"{name}-frontier")
    met = spread_join(frontier, records, ["digest"], "inner", hot_keys(frontier, ["digest"], name), name)
    kept = [c for c in frontier.columns if c not in ("place", "digest", "path", *told)]
    out = met.select(*kept, "place", "path", "kids", F.posexplode("kids").alias("digit", "kid"))
    side = lambda part: F.array_join(F.transform(part, lambda k: k["digest"]), "")
    segment = F.struct(side(F.slice("kids", F.lit(1), F.col("digit"))).alias("left"), side(F.slice("kids", F.col("digit") + 2, F.lit(FANOUT))).alias("right"))
    return out.select(*kept, (F.shiftleft("place", DIGIT_BITS) + F.col("digit")).alias("place"), F.concat("path", F.array(segment)).alias("path"), "kid.digest", *[f"kid.{t}" for t in told])


def proofs(of: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """(source_no, rank, doc_id, leaf, altered, subroot, root, path) of all leaves, or of those `wanted` (source_no, rank).

    `path` has a segment (left and right siblings, joined) for each level from the root down.
    """
    trees = None if wanted is None else wanted.select("source_no", "rank").distinct()
    segments = F.lit(None).cast("array<struct<left:string,right:string>>")
    at = of.root.select(F.col("digest").alias("root"), F.lit(0).cast("long").alias("place"), F.coalesce(segments, F.array()).alias("path"), "digest", "below", "doc_id", "altered")
    for level in range(len(of.upper), 0, -1):
        told = ["below", "doc_id", "altered"] if level == 1 else []
        at = _descend(at.select("root", "place", "path", "digest"), of.upper[level - 1], told, f"merkle-up-{level}")
        if trees is not None:
            asked = trees.select(F.shiftright("source_no", DIGIT_BITS * (level - 1)).alias("place")).distinct()
            at = at.join(asked, "place", "left_semi").select(at.columns)
    subroots = saved(at.select(F.col("place").alias("source_no"), F.lit(0).cast("long").alias("place"), "root", F.col("digest").alias("subroot"), "path", "digest", "below", "doc_id", "altered"), "merkle-subroots")
    kept = ["source_no", "place", "root", "subroot", "path", "digest"]
    at = None
    for level in range(len(of.lower), 0, -1):
        begun = subroots.where(f"below = {level}").select(kept)
        at = _descend(begun if at is None else at.unionByName(begun), of.lower[level - 1], ["doc_id", "altered"] if level == 1 else [], f"merkle-down-{level}")
        if trees is not None:
            asked = trees.select("source_no", F.shiftright("rank", DIGIT_BITS * (level - 1)).alias("place")).distinct()
            at = at.join(asked, ["source_no", "place"], "left_semi").select(at.columns)
    lone = subroots.where("below = 0").select(*kept, "doc_id", "altered")
    out = lone if at is None else at.select(*kept, "doc_id", "altered").unionByName(lone)
    return out.select("source_no", F.col("place").alias("rank"), "doc_id", F.col("digest").alias("leaf"), "altered", "subroot", "root", "path")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the segments of its proof (from the root down) give."""
    return F.aggregate(F.reverse(path), start, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))


def verified(found: DataFrame) -> DataFrame:
    """The rows of `proofs` with the proof's digest and what the leaf, tampered with or not, gives with it."""
    proof = F.sha2(F.array_join(F.transform(F.reverse("path"), lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return verified(proofs(manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)))


def _tier_sql(name: str, base: str, levels: int) -> str:
    """`name`_0 .. with a node a row (g, p, n, digest) and, as long as a tree has several (n > 1), its siblings."""
    out = [f"{name}_0 AS ({base})"]
    for k in range(levels):
        run = f"OVER (PARTITION BY g, p // {FANOUT} ORDER BY p ROWS BETWEEN"
        out.append(f"""{name}_s{k} AS (SELECT g, p, n > 1 AS more, CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS a,
            CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS b FROM {name}_{k})""")
        out.append(f"""{name}_{k + 1} AS (SELECT g, p // {FANOUT} AS p, any_value(n + {FANOUT - 1}) // {FANOUT} AS n,
            CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY p)) ELSE any_value(digest) END AS digest FROM {name}_{k} GROUP BY g, p // {FANOUT})""")
    return ",\n".join(out)


def _oracle(lower: int = 5, upper: int = 3) -> str:
    """SQL for sources of up to FANOUT ** lower documents and up to FANOUT ** upper sources."""
    value = lambda v: f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')"
    h = lambda text: "sha256(concat(" + ", ".join([*map(value, FIELDS[:-1]), value(text)]) + "))"
    crc = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda i: 0::BIGINT)), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT)"""
    steps, joins, last = [], [], "start"
    for k in range(lower + upper):
        t, j, at = ("l", k, "d.g") if k < lower else ("u", k - lower, "0")
        p = f"d.p // {FANOUT**j}" if t == "l" else f"d.g // {FANOUT**j}"
        joins.append(f"JOIN {t}_s{j} AS x{k} ON x{k}.g = {at} AND x{k}.p = {p}")
        steps.append(f"f{k} AS (SELECT *, CASE WHEN m{k} THEN sha256(concat(a{k}, now, b{k})) ELSE now END AS was FROM {last})")
        steps.append(f"g{k} AS (SELECT * EXCLUDE (now, was), was AS now FROM f{k})")
        last = f"g{k}"
    sides = ", ".join(f"x{k}.more AS m{k}, x{k}.a AS a{k}, x{k}.b AS b{k}" for k in range(lower + upper))
    proof = ", ".join(f"a{k}, b{k}" for k in range(lower + upper))
    return f"""
WITH docs AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {h("text")} AS leaf,
        CASE WHEN {crc} % 5 = 0 THEN {h("translate(text, '" + ascii_uppercase + "', '" + ascii_lowercase + "')")} END AS altered FROM documents),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM docs),
    {_tier_sql("l", "SELECT g, p, n, leaf AS digest FROM ranked", lower)},
    {_tier_sql("u", f"SELECT 0 AS g, g AS p, count(*) OVER () AS n, digest FROM l_{lower}", upper)},
    start AS (SELECT d.doc_id, d.leaf, coalesce(d.altered, d.leaf) AS now, s.digest AS subroot, r.digest AS root, {sides}
        FROM ranked d JOIN l_{lower} s ON s.g = d.g JOIN u_{upper} r ON true {" ".join(joins)}),
    {", ".join(steps)}
SELECT doc_id, leaf, subroot, root, sha256(concat({proof})) AS proof_sha256, now AS folded_root, now = root AS verified FROM {last}
"""


ORACLE = _oracle()
