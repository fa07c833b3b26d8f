"""Places inside groups of any size: a group with a third of all rows is still sorted by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled
from .lexicon import small


def numbered(df: DataFrame, group: str, order: str | list[str], name: str) -> DataFrame:
    """Rows with their place from 0 in the order of some columns inside their group.

    Rows are dealt by ranges of (group, order), whose borders Spark draws from a sample, so that ranges are even whatever the
    values: dense, sparse or hashed numbers, strings, arrays. The place is that inside the range, plus what earlier ranges hold of
    the group: one narrow row for each group and range. The rows are read
    twice (for the sample) and written once: pass narrow ones, settled if they cost much to find.
    """
    keys = [group, *([order] if isinstance(order, str) else order)]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = settled(dealt.withColumn("_range", F.shiftright("_at", 33)), "places")
    held = dealt.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_shift")
    before = held.select(F.col(group).alias("_group"), F.col("_range").alias("_in"), shift)
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_in"))
    return dealt.join(small(before), same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))


def first_or_last(df: DataFrame, group: str, order: str, name: str, place: int) -> DataFrame:
    """Of each group the row with the given place, or the last one if there are fewer. No task passes on more than the first
    place + 1 rows that it has of a group (Spark limits a ranked window before it shuffles)."""
    placed = df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).where(F.col(name) < place + 1)
    last = F.max(name).over(Window.partitionBy(group))
    return placed.withColumn("_last", last).where(F.col(name) == F.col("_last")).select(*df.columns, name)
