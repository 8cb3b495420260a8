"""Rows dealt out to tasks by a key, so that several groupings within the key share one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a task on average, and of one bucket at most; buckets of keys that are counted.
ROWS, BUCKETS = 125_000, 4096


def dealt(rows: DataFrame, key: str) -> list[DataFrame]:
    """``rows`` in one or two frames that share no key. In the first one all rows of a key are in one task, so that groups and
    windows that contain the key need no other shuffle. The second one has the keys of buckets with too many rows for a
    task, as they come: groups of it are made by aggregates with map-side combining. ``rows`` are evaluated twice or more.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    sizes = {r["bucket"]: r["count"] for r in rows.groupBy(bucket.alias("bucket")).count().collect()}  # BUCKETS rows at most
    total = sum(sizes.values())
    large = [b for b, n in sizes.items() if n > max(ROWS, 4 * total // BUCKETS)]
    tasks = max(1, -(-total // ROWS))
    if not large:
        return [rows.repartition(tasks, key)]
    return [rows.filter(~bucket.isin(large)).repartition(tasks, key), rows.filter(bucket.isin(large))]
