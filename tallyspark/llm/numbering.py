"""Row numbers within large groups without one task per group (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm import common

#: Rows in a block that one task numbers, on average.
BLOCK_ROWS = 20_000


def numbered(df: DataFrame, part: list[str], coarse: str, fine: str, ties: list[str], count_from: DataFrame | None = None) -> DataFrame:
    """``df`` with ``__rank``: 0, 1, ... within ``part`` by (coarse, fine, ties).

    ``fine`` is a 60-bit number spread evenly within (part, coarse), such as ``common.order_hash``. A
    (part, coarse) cell with many rows is cut into blocks by ranges of ``fine``; blocks are numbered on
    their own and get the number of rows before them. ``count_from`` (default ``df``) is a narrower frame
    with the same rows and these columns. part, coarse and fine must not be null.
    """
    narrow = (count_from if count_from is not None else df).select(*part, coarse, fine)
    cells = common.stage(narrow.groupBy(*part, coarse).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("long").alias("__blocks")), "cells")
    block = F.shiftright(F.shiftright(fine, 28) * F.col("__blocks"), 32).alias("__block")
    keys = [*part, coarse, "__block"]

    def cut(x):
        return x.join(cells, [*part, coarse]).withColumn("__block", block)

    sizes = cut(narrow).groupBy(*keys).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*part).orderBy(coarse, "__block").rowsBetween(Window.unboundedPreceding, -1))
    starts = common.stage(sizes.select(*keys, F.coalesce(before, F.lit(0)).alias("__before")), "starts")
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(fine, *ties)) - 1
    return cut(df).withColumn("__own", own).join(starts, keys).withColumn("__rank", F.col("__before") + F.col("__own")).drop("__blocks", "__block", "__own", "__before")
