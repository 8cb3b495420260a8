"""Tables that grow by batches: a base and the deltas after it, as Parquet folders, folded together from time to time.

``root/d-<seq>-<name>`` holds what one batch adds, ``root/b-<seq>`` all batches up to ``seq``. A folder counts once it
is written in full, so a batch that runs again after a failure overwrites its own folder and changes nothing else.
One writer is assumed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Deltas:
    """``fold`` makes one table of many batches' rows, which have their batch's number in ``seq``; folding twice, or in
    parts, must give the same. ``limit`` is how many deltas a reader finds before they are folded into the base."""

    spark: SparkSession
    root: str
    schema: str
    fold: Callable[[DataFrame], DataFrame]
    limit: int = 16

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def folders(self) -> list[str]:
        """Names of complete folders that a reader needs: the newest base, and the deltas after it, in order."""
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        path_of = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [x.getPath().getName() for x in fs.listStatus(path)]
        done = sorted(n for n in names if n[:2] in ("b-", "d-") and fs.exists(path_of(f"{self.root}/{n}/_SUCCESS")))
        bases = [n for n in done if n.startswith("b-")]
        after = bases[-1][2:] if bases else ""
        return bases[-1:] + [n for n in done if n.startswith("d-") and n[2:14] > after]

    def applied(self) -> int:
        """The number that the next batch gets."""
        names = self.folders()
        return int(names[-1][2:14]) + 1 if names else 0

    def read(self, before: int | None = None) -> DataFrame:
        """Rows of all batches (before one of them) with ``seq``; a key may have several, see ``fold``."""
        names = [n for n in self.folders() if before is None or int(n[2:14]) < before]
        if not names:
            return self.spark.createDataFrame([], f"{self.schema}, seq long")
        return self.spark.read.schema(f"{self.schema}, seq long").parquet(*[f"{self.root}/{n}" for n in names])

    def batch(self, seq: int) -> DataFrame:
        """Rows of one batch that is not folded yet."""
        (name,) = [n for n in self.folders() if n.startswith(f"d-{seq:012d}-")]
        return self.spark.read.schema(f"{self.schema}, seq long").parquet(f"{self.root}/{name}")

    def current(self) -> DataFrame:
        return self.fold(self.read()).drop("seq")

    def add(self, rows: DataFrame, seq: int, name: str = "") -> None:
        """Write a batch's rows under its number."""
        rows.withColumn("seq", F.lit(seq).cast("long")).write.mode("overwrite").parquet(f"{self.root}/d-{seq:012d}-{name}")

    def compact(self) -> bool:
        """Fold the deltas into a new base if there are more than ``limit``; the folders it replaces go after it is complete."""
        names = self.folders()
        deltas = [n for n in names if n.startswith("d-")]
        if len(deltas) <= self.limit:
            return False
        last = int(deltas[-1][2:14])
        folded = self.fold(self.read())
        folded.select(*[c for c in folded.columns if c != "seq"], F.lit(last).cast("long").alias("seq")).write.mode("overwrite").parquet(f"{self.root}/b-{last:012d}")
        fs, _ = self._fs()
        for name in names:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)
        return True


def newest(*key: str) -> Callable[[DataFrame], DataFrame]:
    """A fold that keeps each key's row of the newest batch."""

    def fold(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in key]
        return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("row")).select(*key, "row.*")

    return fold
