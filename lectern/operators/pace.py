"""Pace of voices, tempo, and the timeline of a narration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexicon import small

#: Limits of the tempo, and the words a minute aimed at.
MIN_TEMPO, MAX_TEMPO, TARGET_WPM = 0.75, 1.35, 160.0
#: Seconds of silence after a break of each kind, and after an announced title.
GAPS = {"clause": 0.25, "sentence": 0.3, "paragraph": 1.9}
TITLE_GAP = 2.6


def voice_wpm(rates: DataFrame) -> DataFrame:
    """Mean words a minute of each (engine, voice) over its runs with seconds > 0."""
    return rates.where("seconds > 0").groupBy("engine", "voice").agg(F.avg(F.col("words") / F.col("seconds") * 60).alias("wpm"))


def pooled_wpm(voices: DataFrame, deterministic: list[str]) -> DataFrame:
    """Natural pace: a voice's own for deterministic engines, else the mean over the engine's voices."""
    pool = voices.where("wpm > 0").groupBy("engine").agg(F.avg("wpm").alias("pool"))
    own = F.when(F.col("engine").isin(deterministic), F.col("wpm")).otherwise(F.coalesce("pool", "wpm"))
    return voices.join(small(pool), "engine", "left").select("engine", "voice", own.alias("natural_wpm"))


def tempo(natural: Column, target: Column | float = TARGET_WPM, speed: Column | None = None) -> Column:
    target = target if isinstance(target, Column) else F.lit(target)
    speed = F.coalesce(F.nullif(speed, F.lit(0.0)), F.lit(1.0)) if speed is not None else F.lit(1.0)
    known = (target > 0) & natural.isNotNull() & (natural > 0)
    return F.when(known, F.greatest(F.lit(MIN_TEMPO), F.least(F.lit(MAX_TEMPO), speed * target / natural))).otherwise(speed)


def gap_seconds(kind: Column) -> Column:
    gaps = F.create_map(*[x for k, v in GAPS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(gaps, kind), F.lit(GAPS["sentence"]))


def words_seconds(words: Column, wpm: Column) -> Column:
    return words / wpm * 60


def narration_plan(chunks: DataFrame, wpm: Column, speed: Column, title_first: Column | None = None, estimate: Callable[[Column, Column], Column] = words_seconds) -> DataFrame:
    """Milliseconds of speech and silence of each chunk; empty chunks contribute nothing. `estimate` is pluggable."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    first = title_first if title_first is not None else F.lit(False)
    gap = F.when(first & (F.col("chunk_index") == 0), F.lit(TITLE_GAP)).otherwise(gap_seconds(F.col("kind")))
    factor = F.when(F.abs(speed - 1) > 0.01, speed).otherwise(F.lit(1.0))
    ms = lambda seconds: F.when(words > 0, F.floor(F.round(seconds / factor * 1000, 3))).otherwise(F.lit(0)).cast("long")
    return chunks.withColumn("speech_ms", ms(estimate(words, wpm))).withColumn("gap_ms", ms(gap))


def timeline(chapters: DataFrame, book: str, order: list[str], ms: str) -> DataFrame:
    """start_ms and end_ms of each chapter by running sums of whole milliseconds; `order` must be unique inside a book."""
    w = Window.partitionBy(book).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return chapters.withColumn("end_ms", F.sum(ms).over(w)).withColumn("start_ms", F.col("end_ms") - F.col(ms))


def resolve_voice(roster: DataFrame, remembered: DataFrame) -> DataFrame:
    """(engine, voice): remembered if available, else the first that is no default, else any, else ''."""
    first = roster.groupBy("engine").agg(F.min_by("voice", F.struct("is_default", "seq")).alias("first"))
    there = remembered.join(roster.select("engine", "voice"), ["engine", "voice"], "left_semi").withColumnRenamed("voice", "own")
    engines = remembered.select("engine").union(roster.select("engine")).distinct()
    return engines.join(first, "engine", "left").join(there, "engine", "left").select("engine", F.coalesce("own", "first", F.lit("")).alias("voice"))
