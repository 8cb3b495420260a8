"""Positions within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.iterate import cut


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str = "index") -> DataFrame:
    """``rows`` with their position (0, 1, ...) by ``order`` within ``by``; columns of ``by`` must not be missing.

    A range sort deals a large group out to many tasks, and the counts of the ranges give each range its first position.
    """
    at = F.monotonically_increasing_id()  # of rows in order: the range in the high bits, the place in it below
    ranges = cut(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__at", at)).withColumn("__range", F.shiftright("__at", 33))
    counts = ranges.groupBy(*by, "__range").agg(F.min("__at").alias("__least"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    starts = counts.select(*by, "__range", (F.coalesce(before, F.lit(0)) - F.col("__least")).alias("__shift"))
    return ranges.join(starts, [*by, "__range"]).withColumn(name, F.col("__at") + F.col("__shift")).drop("__at", "__range", "__shift")
