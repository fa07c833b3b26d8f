"""Corpus pipeline: five stages from raw documents to packed sequences.

Each stage works on all rows that its predecessor kept. The first four return the columns of their input; rows that a stage
rejects are gone afterwards, and substring deduplication replaces `text` (and `n_chars`). Rows that share a doc_id are one
document and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import minhash, packing, quality, substring, toxicity
from lectern.llm.common import fresh, saved, sized


#: Near duplicates are linked from this similarity of word shingles on; the contract of 85 is that of the query op9 alone.
PERCENT = 80


def _set_aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with own columns of the given names renamed, and how to name them back."""
    back = {}
    for c in docs.columns:
        if c.lower() in names:
            new = fresh(docs, f"_own_{c}")
            back[new] = c
            docs = docs.withColumnRenamed(c, new)
    return docs, back


def _kept(scored: DataFrame, condition, columns: list[str], back: dict[str, str]) -> DataFrame:
    there = {c: n for n, c in back.items()}
    return scored.where(condition).select(*[F.col(f"`{there.get(c, c)}`").alias(c) for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, back = _set_aside(docs, ("score", "predicted"))
    return _kept(quality.score(plain, model), "predicted = 1", docs.columns, back)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, back = _set_aside(docs, ("score", "predicted", "spans"))
    return _kept(toxicity.score(plain, model), "predicted = 0", docs.columns, back)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = saved(minhash.near_duplicates(docs, PERCENT).where("not kept").select("doc_id").distinct(), "near-gone")
    return docs.join(sized(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, back = _set_aside(docs, ("n_bytes", "n_removed", "n_spans", "kept_text"))
    out = substring.deduplicated(plain, as_text=True)
    there = {c: n for n, c in back.items()}
    new = {"text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[new.get(c, F.col(f"`{there.get(c, c)}`")).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("suffix_dedup", suffix_dedup_stage), ("packing", packing_stage)]

#: SQL expresses neither the fitted models nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
