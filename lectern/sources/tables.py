"""Tables of a library of books, and the sinks of narration work."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that a sink spreads jobs over, however many jobs there are.
PARTS = 64
#: Rows that a task of a sink is given, whatever the size of a batch.
ROWS_A_TASK = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MANIFEST = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("book_title", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("created_at", T.DoubleType()), T.StructField("n_chapters", T.IntegerType()),
])


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Job manifests (one JSON document each): known fields only, unreadable ones dropped, missing ones null."""
    return spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)


def scan_manifests(spark: SparkSession, path: str, documents: bool = True) -> DataFrame:
    """Job manifests with the file that each came from, and `broken`: what could not be read, else null.

    `documents` says that a file is one JSON document, otherwise each line is.
    """
    schema = T.StructType([*MANIFEST.fields, T.StructField("broken", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").option("multiLine", documents).json(path)
    return rows.select(*MANIFEST.names, "broken", F.col("_metadata.file_path").alias("file"))


def listed_manifests(scanned: DataFrame) -> DataFrame:
    """Readable manifests, newest first, those of one moment by their files' names."""
    return scanned.where("broken is null").orderBy(F.desc("created_at"), "file", "job_id")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col("job_id").cast("string")), F.lit(parts)).cast("int")


def tasks(rows: int) -> int:
    return max(1, -(-rows // ROWS_A_TASK))


def _met(spark: SparkSession, rows: DataFrame, path: str, schema: T.StructType) -> tuple[DataFrame, int, int]:
    """What `path` holds in the folders (numbers, at most PARTS of them) that `rows` will be written to, the tasks for both, and
    the most rows that fall into one folder."""
    met = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    if not _exists(spark, path):
        return spark.createDataFrame([], schema), tasks(sum(met.values())), max(met.values(), default=0)
    held = spark.read.schema(schema).parquet(path).where(F.col("part").isin(list(met)) if met else F.lit(False))
    return held, tasks(sum(met.values()) + held.count()), max(met.values(), default=0)  # files know their numbers of rows


def _by_part(rows: DataFrame, keys: list[str], n: int, most: int, parts: int) -> DataFrame:
    """Rows by folders for `n` tasks: a folder with too many rows for one task is dealt out to several by a hash of the keys."""
    slices = max(-(-4 * n // parts), 4 * tasks(most)) if n > 1 else 1
    return rows.repartition(n, "part", F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys], F.lit("slice")), F.lit(slices)))


def write_manifests(jobs: DataFrame, path: str, order: list[str] | None = None, parts: int = PARTS) -> None:
    """Replace the rows of the jobs at hand; other jobs stay. Of several rows of a job the last by `order` counts.

    Jobs are spread over `parts` folders by a hash. Only folders that hold one of the jobs are read, merged and written anew; Spark stages
    their new files and then puts them in the place of the old ones, so a run that is lost before leaves the table as it was.
    Rows and folders of one writer at a time: two at once could each put back what the other replaced.
    """
    spark = jobs.sparkSession
    w = Window.partitionBy("job_id").orderBy(*[F.desc(c) for c in order or ["job_id"]])
    new = jobs.withColumn("part", _part(parts))
    held, n, most = _met(spark, new, path, new.schema)
    new = new.repartition(n, "job_id").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    merged = held.join(new.select("job_id"), "job_id", "left_anti").select(new.columns).unionByName(new)
    _by_part(merged, ["job_id"], n, most, parts).write.partitionBy("part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_checkpoints(chapters: DataFrame, path: str, batch: str | None = None, parts: int = PARTS) -> None:
    """Add chapters that the checkpoint does not hold yet, so that a repeated run adds nothing.

    Jobs are spread over `parts` folders by a hash, inside which each batch has a folder of its own. A batch that is run again
    under its name replaces what it wrote before, all or half of it, and leaves out what other batches hold; only folders that
    its jobs fall into are read. Without a name a batch gets a new one. Tasks are as many as the rows need, so that none grows with them.
    """
    spark, batch, keys = chapters.sparkSession, batch or uuid.uuid4().hex, ["job_id", "chapter_index"]
    rows = chapters.withColumns({"part": _part(parts), "batch": F.lit(batch)})
    held, n, most = _met(spark, rows, path, rows.schema)
    rows = rows.repartition(n, *keys).dropDuplicates(keys)
    new = rows.join(held.where(F.col("batch") != batch).select(keys), keys, "left_anti").select(rows.columns)
    _by_part(new, keys, n, most, parts).write.partitionBy("part", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part", "batch")


def write_markers(markers: DataFrame, path: str) -> None:
    """Marker lines as text, one folder for each book, lines in order."""
    ordered = markers.repartition("book").sortWithinPartitions("book", "line_no")
    ordered.select("book", F.col("line").alias("value")).write.partitionBy("book").mode("overwrite").text(path)
