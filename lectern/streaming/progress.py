"""Progress of jobs as a stream: throughput by window, interrupted sessions, resumable chapter sink, respelling."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.jobs import ORPHANED, TERMINAL, latest, reconciled, sessions
from ..operators.lexicon import apply_lexicon
from ..sources.tables import write_checkpoints


def progress_stream(spark: SparkSession, sf_dir: str, files: str = "events.parquet") -> DataFrame:
    """(job_id, stage, ts, event_id) as files with events arrive; ts as an instant, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/{files}").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(sf_dir)
    return rows.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def throughput(events: DataFrame, width: str = "1 hour", delay: str | None = None) -> DataFrame:
    """Events in each tumbling window; `delay` sets a watermark for streams."""
    events = events.withWatermark("ts", delay) if delay else events
    return events.groupBy(F.window("ts", width).alias("w"), "stage").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "stage", "n")


def interrupted(events: DataFrame, gap: str = "30 minutes", delay: str | None = None, terminal: tuple[str, ...] = ("purchase",)) -> DataFrame:
    events = events.withWatermark("ts", delay) if delay else events
    return sessions(events, "job_id", "ts", "stage", gap, list(terminal))


def latest_states(events: DataFrame) -> DataFrame:
    """The last stage of each job, for update mode: a job is sent again whenever its last event changes."""
    return latest(events, "job_id", ["ts", "event_id"], ["stage", "ts"])


def follow(events: DataFrame, emit: Callable[[DataFrame], None], checkpoint: str, terminal: tuple[str, ...] = tuple(TERMINAL), wait_s: float = 0.2) -> None:
    """Hand each batch of one job's events to `emit`, up to and with the first terminal one; then the stream is closed."""
    over = threading.Event()

    def batch(rows: DataFrame, _: int) -> None:
        if over.is_set():
            return
        end = rows.where(F.col("stage").isin(*terminal)).agg(F.min(F.struct("ts", "event_id")).alias("x")).first().x
        emit(rows if end is None else rows.where((F.col("ts") < end.ts) | ((F.col("ts") == end.ts) & (F.col("event_id") <= end.event_id))))
        if end is not None:
            over.set()

    query = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).start()
    while not over.wait(wait_s) and query.isActive:
        pass
    query.stop()
    if query.exception():
        raise query.exception()


class _Runs(StatefulProcessor):
    """The events of one job, run by run: up to the first terminal one, or closed after `gap` microseconds of silence."""

    def __init__(self, gap: int, terminal: tuple[str, ...]):
        self.gap, self.terminal = gap, terminal

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "last long, over boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        state = self.run.get() if self.run.exists() else None
        last, over = state if state is not None else (None, False)
        out = []
        at = events["ts"].astype("datetime64[us]").astype("int64")
        for stage, t, event in zip(events["stage"], at.tolist(), events["event_id"].tolist()):
            if last is not None and t >= last + self.gap:
                if not over:
                    out.append((INTERRUPTED, last + self.gap, None))
                over = False
            if not over:
                out.append((stage, t, event))
                over = stage in self.terminal
            last = t if last is None else max(last, t)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-(last + self.gap) // 1000))
        self.run.update((last, over))
        yield self.rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, over = self.run.get()
        self.run.clear()
        yield self.rows(key, [] if over else [(INTERRUPTED, last + self.gap, None)])

    def close(self) -> None:
        pass

    def rows(self, key, out: list[tuple]) -> pd.DataFrame:
        stage, at, event = zip(*out) if out else ((), (), ())
        return pd.DataFrame({"job_id": [key[0]] * len(out), "stage": pd.Series(stage, dtype=object), "ts": pd.Series(at, dtype="int64").astype("datetime64[us]"), "event_id": pd.Series(event, dtype="Int64")})


#: The stage that closes a run which fell silent.
INTERRUPTED = "interrupted"


def closed_runs(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", terminal: tuple[str, ...] = tuple(TERMINAL)) -> DataFrame:
    """The events of all jobs of a stream (job_id, stage, ts, event_id), each run of a job closed once.

    A run ends with its first terminal event; what the job sends after it, until it has been silent for `gap`, is left out. A run
    without one is closed by a row of its own, stage `interrupted`, when the watermark has passed `gap` after its last event; then
    the job's state is dropped. State is one number and one flag a job, kept by Spark: a restart goes on from the checkpoint. The
    session needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`), as all of Spark's timers do.
    """
    micros = events.sparkSession.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + INTERVAL {gap}) AS g").first().g
    schema = f"job_id {dict(events.dtypes)['job_id']}, stage string, ts timestamp, event_id long"
    rows = events.select("job_id", "stage", "ts", F.col("event_id").cast("long").alias("event_id")).withWatermark("ts", delay)
    return rows.groupBy("job_id").transformWithStateInPandas(_Runs(micros, terminal), schema, "Append", "EventTime")


def closed_runs_batch(events: DataFrame, gap: str = "30 minutes", terminal: tuple[str, ...] = tuple(TERMINAL)) -> DataFrame:
    """The same of a table, in which every run is over."""
    span = F.expr(f"INTERVAL {gap}")
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    begun = F.col("ts") >= F.lag("ts").over(w) + span
    rows = events.select("job_id", "stage", "ts", "event_id").withColumn("run", F.sum(F.coalesce(begun, F.lit(True)).cast("long")).over(w))
    ended = F.coalesce(F.col("stage").isin(*terminal), F.lit(False))
    in_run = Window.partitionBy("job_id", "run").orderBy("ts", "event_id")
    over = F.coalesce(F.max(ended).over(in_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    kept = rows.withColumn("over", over).where("not over").select("job_id", "stage", "ts", "event_id")
    silent = rows.groupBy("job_id", "run").agg(F.max("ts").alias("ts"), F.max(ended).alias("ended")).where("not ended")
    return kept.unionByName(silent.select("job_id", F.lit(INTERRUPTED).alias("stage"), (F.col("ts") + span).alias("ts"), F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id")))


def respelled(texts: DataFrame, lexicon: dict[str, str]) -> DataFrame:
    """A stream of texts with a static lexicon: the same expression as in batch."""
    return texts.withColumn("said", apply_lexicon(F.col("text"), lexicon))


def chapter_sink(chapters: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write finished chapters (job_id, chapter_index, ..) once, however often a batch or the whole job is run again: a batch is
    known by its query, which the checkpoint names, and its number there."""

    def batch(rows: DataFrame, number: int) -> None:
        query = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        write_checkpoints(rows, path, f"{query}-{number}")

    return chapters.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def reconciled_stream(running: DataFrame, beats: DataFrame, grace: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Running jobs (job_id, started) of which no beat (job_id, ts) came within `grace` of their start: as `reconciled` has them.

    A stream-stream left outer join: its state holds what lies within `grace` and `delay` of the watermark.
    """
    left = running.select("job_id", "started").withWatermark("started", delay)
    right = beats.select(F.col("job_id").alias("_job"), F.col("ts").alias("_ts")).withWatermark("_ts", delay)
    near = (F.col("job_id") == F.col("_job")) & (F.col("_ts") >= F.col("started")) & (F.col("_ts") <= F.col("started") + F.expr(f"INTERVAL {grace}"))
    silent = left.join(right, near, "left_outer").where("_job is null")
    return silent.select("job_id", "started", F.lit(INTERRUPTED).alias("status"), F.lit(ORPHANED).alias("error"), F.lit(True).alias("changed"))


def reconciled_batch(running: DataFrame, beats: DataFrame, grace: str = "30 minutes") -> DataFrame:
    """The same of tables, by `reconciled`: a job is live if it has a beat within `grace` of its start."""
    both = running.join(beats, "job_id").where((F.col("ts") >= F.col("started")) & (F.col("ts") <= F.col("started") + F.expr(f"INTERVAL {grace}")))
    jobs = running.select(F.struct("job_id", "started").alias("run"), F.lit("running").alias("status"), F.lit(None).cast("string").alias("error"))
    out = reconciled(jobs, both.select(F.struct("job_id", "started").alias("run")), "run")
    return out.where("changed").select("run.job_id", "run.started", "status", "error", "changed")
