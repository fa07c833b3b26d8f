"""Places in a total order, given by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Rows that one range holds on average at most.
RANGE_ROWS = 500_000
_IN_PART = (1 << 33) - 1


def placed(df: DataFrame, order: list[Column], place: str, name: str) -> DataFrame:
    """A saved table's rows with their place from 0 in `order`. Saved again.

    The table is dealt by ranges of the order; rows that the order does not tell apart are dealt by where they were read, so
    that no range holds more than its part of the table, whatever repeats. What earlier ranges hold (a number for each range)
    is broadcast.
    """
    spark = df.sparkSession
    ranges = max(spark.sparkContext.defaultParallelism, df.count() // RANGE_ROWS + 1)
    keys = [*order, F.col("_read").asc()]
    dealt = df.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("_read")
    dealt = saved(dealt.withColumn("_at", F.monotonically_increasing_id()), f"{name}-ranges")
    sizes = dealt.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("_range", F.coalesce(earlier, F.lit(0)).alias("_before"))
    out = dealt.join(F.broadcast(before), F.shiftright("_at", 33) == F.col("_range"))
    return out.select(*df.columns, (F.col("_at").bitwiseAND(F.lit(_IN_PART)) + F.col("_before")).alias(place))
