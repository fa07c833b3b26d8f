"""State of narration jobs: progress, resume, change detection and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slugify
from .ranks import numbered

TERMINAL = ["done", "failed", "cancelled"]
#: The moves that a job's status may make.
MOVES = {"pending": ["running", "cancelled"], "running": ["done", "failed", "cancelled", "interrupted"], "interrupted": ["running"], "failed": ["running"], "cancelled": ["running"]}


def progress(chapters: DataFrame, job: str, done: Column) -> DataFrame:
    return chapters.groupBy(job).agg(F.count_if(done).alias("done"), F.count("*").alias("total"))


def pending(chapters: DataFrame, finished: DataFrame, artefacts: DataFrame, keys: list[str]) -> DataFrame:
    """Chapters still to do: finished means flagged and with an artefact."""
    return chapters.join(finished.select(keys).join(artefacts.select(keys), keys, "left_semi"), keys, "left_anti")


def changed_sources(old: DataFrame, new: DataFrame, path: str) -> DataFrame:
    """(path, sha_changed, chapters_changed) of sources whose hash or number of chapters differs; columns sha, n."""
    both = old.alias("o").join(new.alias("n"), path).select(path, (F.col("o.sha") != F.col("n.sha")).alias("sha_changed"), (F.col("o.n") != F.col("n.n")).alias("chapters_changed"))
    return both.where("sha_changed or chapters_changed")


def latest(events: DataFrame, job: str, order: list[str], columns: list[str]) -> DataFrame:
    last = F.max(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in columns]))
    return events.groupBy(job).agg(last.alias("x")).select(job, *[F.col(f"x._{c}").alias(c) for c in columns])


def transitions(events: DataFrame, job: str, status: str, order: list[str]) -> DataFrame:
    """Each status with the one before it and whether the move is allowed; a first status must be pending or running."""
    before = F.lag(status).over(Window.partitionBy(job).orderBy(*order))
    allowed = F.create_map(*[x for k, v in MOVES.items() for x in (F.lit(k), F.array(*[F.lit(m) for m in v]))])
    legal = F.when(F.col("before").isNull(), F.col(status).isin("pending", "running")).otherwise(F.coalesce(F.array_contains(F.element_at(allowed, F.col("before")), F.col(status)), F.lit(False)))
    return events.withColumn("before", before).withColumn("legal", legal)


def sessions(events: DataFrame, job: str, ts: str, stage: str, gap: str, terminal: list[str]) -> DataFrame:
    """Runs of events no further apart than `gap`; a run without a terminal event was interrupted."""
    s = events.groupBy(job, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n"), F.max(F.col(stage).isin(terminal)).alias("ended"))
    return s.select(job, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", F.when(F.col("ended"), "done").otherwise("interrupted").alias("status"))


#: Fixed value: why a job that nobody runs any more was interrupted.
ORPHANED = "Interrupted when the server stopped"


def reconciled(jobs: DataFrame, live: DataFrame, job: str = "job_id") -> DataFrame:
    """Jobs (job, status, error, ..) with those that are marked running but not live interrupted, and `changed` for these."""
    held = live.select(F.col(job)).distinct().withColumn("_live", F.lit(True))
    both = jobs.join(held, job, "left")
    orphan = (F.col("status") == "running") & F.col("_live").isNull()
    changed = F.coalesce(orphan, F.lit(False))
    return both.withColumns({"status": F.when(orphan, "interrupted").otherwise(F.col("status")), "error": F.when(orphan, ORPHANED).otherwise(F.col("error")), "changed": changed}).drop("_live")


def create_jobs(books: DataFrame, book: str, chapter: str, title: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, chapter rows) of books given as rows of chapters."""
    job = F.concat(slugify(F.col("book_title")), F.lit("-"), F.left(F.sha2(F.col("book_title"), 256), F.lit(6)))
    placed = numbered(books.select(F.col(book).alias("book_title"), F.col(chapter).alias("_chapter"), F.col(title).alias("title")), "book_title", "_chapter", "chapter_index")
    rows = placed.select(job.alias("job_id"), "book_title", "chapter_index", "title")
    jobs = rows.groupBy("job_id", "book_title").agg(F.count("*").alias("n_chapters")).withColumn("status", F.lit("pending"))
    return jobs, rows.select("job_id", "chapter_index", "title", F.lit(False).alias("done"))
