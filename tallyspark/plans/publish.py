"""Restartable publication: retained raw, resolved state, snapshot, publication record, effect.

All state is Parquet under one root: ``raw/batch_id=…``, ``state`` (see ``operators.resolve_state``; each retained
batch is merged into it once), ``snapshots/snapshot_id=…/<relation>``, ``publications``, ``outbox``. A snapshot is the accepted state with its totals, the excluded keys and the
coverage; its id comes from the content of all four, so that a change in any of them is published. Every step first asks whether it has been done, so
running again after a failure at any point ends in the same state with one effect per snapshot. One writer
is assumed. A publication record is written last; readers go through it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.deltas import Deltas, newest
from tallyspark.operators import resolve as R
from tallyspark.operators.resolve_state import ResolverState

RAW = "event_id string, inspection_id string, version int, inspected_units int, defective_units int, batch_id string"
PUBLICATIONS = "seq long, snapshot_id string, status string"
OUTBOX = "snapshot_id string, effect string"


def content_id(rows: DataFrame, buckets: int = 256) -> DataFrame:
    """One row: a SHA-256 that depends on the rows but not on their order.

    Rows are hashed, the hashes sorted within buckets by their first digits, and the bucket digests hashed in
    order; buckets are folded by sums of hash words first, so no list grows with the table.
    """
    digest = F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256)
    words = [F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(5)]
    bucket = F.pmod(F.conv(F.substring(digest, 61, 4), 16, 10).cast("long"), F.lit(buckets)).alias("bucket")
    sums = rows.select(bucket, *[w.alias(f"w{i}") for i, w in enumerate(words)]).groupBy("bucket").agg(F.count("*").alias("n"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(5)])
    line = F.concat_ws(":", "bucket", "n", *[f"w{i}" for i in range(5)])
    return sums.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("content_id"))


def snapshot_of(found: R.Resolution) -> dict[str, DataFrame]:
    """The relations of a snapshot. Repeated arrivals change none of them."""
    return {"accepted": found.accepted(), "totals": found.totals(), "excluded": found.excluded(), "coverage": R.coverage(found)}


def snapshot_id(relations: dict[str, DataFrame]) -> DataFrame:
    """One row: the content id of all relations together."""
    parts = [content_id(rows).select(F.concat(F.lit(f"{name}:"), "content_id").alias("part")) for name, rows in sorted(relations.items())]
    return reduce(DataFrame.union, parts).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("part")), ","), 256).alias("content_id"))


@dataclass
class Pipeline:
    """``fail_after`` is a test hook: a step name after which ``ingest`` or ``recover`` raises."""

    spark: SparkSession
    root: str

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def raw(self) -> DataFrame:
        return self._read("raw", RAW)

    def publications(self) -> DataFrame:
        return self._read("publications", PUBLICATIONS)

    def outbox(self) -> DataFrame:
        return self._read("outbox", OUTBOX)

    def ingest(self, batch: DataFrame, batch_id: str, fail_after: str | None = None) -> str:
        """Retain a batch (again: no change), then recover."""
        rows = batch.select("event_id", "inspection_id", "version", "inspected_units", "defective_units")
        rows.write.mode("overwrite").parquet(f"{self.root}/raw/batch_id={batch_id}")
        if fail_after == "retained_raw":
            raise RuntimeError(fail_after)
        return self.recover(fail_after)

    def state(self) -> ResolverState:
        return ResolverState(self.spark, f"{self.root}/state")

    def merge_retained(self) -> None:
        """Bring the resolver's state in line with retained raw: batches that it does not have yet, in the order of their ids."""
        done = Deltas(self.spark, f"{self.root}/state/applied", "batch_id string", newest("batch_id"))
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/raw")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        retained = {x.getPath().getName().removeprefix("batch_id=") for x in fs.listStatus(path)} if fs.exists(path) else set()
        known = {r["batch_id"] for r in done.current().collect()}  # ids of batches, not rows of them
        for batch_id in sorted(x for x in retained - known if not x.startswith(("_", "."))):
            seq = done.applied()
            self.state().apply(self.spark.read.schema(RAW).parquet(f"{self.root}/raw/batch_id={batch_id}"), seq)
            done.add(self.spark.createDataFrame([(batch_id,)], "batch_id string"), seq)
            done.compact()

    def status(self) -> str:
        """Of the report as it stands, between retained raw and recovery: not_published or stale_previous."""
        return "not_published" if self.publications().isEmpty() else "stale_previous"

    def recover(self, fail_after: str | None = None) -> str:
        """Bring published state and effects in line with retained raw; the status of the report."""
        self.merge_retained()
        last = self.publications().orderBy(F.desc("seq")).first()
        judged = Deltas(self.spark, f"{self.root}/state/judged", "snapshot_id string, status string", newest("snapshot_id"))
        seq = self.state().applied()  # of the state that is judged: batches merged into it
        known = judged.read().filter(F.col("seq") == seq).first() if judged.applied() == seq + 1 else None
        if known and known["snapshot_id"] == (last["snapshot_id"] if last else None):
            status = known["status"]
        else:
            status = self._publish(last, fail_after)
            last = self.publications().orderBy(F.desc("seq")).first()
            judged.add(self.spark.createDataFrame([(last["snapshot_id"] if last else None, status)], "snapshot_id string, status string"), seq)
            judged.compact()
        # Every published snapshot gets its one effect, also those whose effect an earlier failure prevented.
        due = self.publications().select("snapshot_id").distinct().join(self.outbox(), "snapshot_id", "left_anti")
        due = due.withColumn("effect", F.lit("notify")).coalesce(1)
        due.write.mode("append").parquet(f"{self.root}/outbox")
        return status

    def _publish(self, last, fail_after: str | None) -> str:
        """Judge the state, and write its snapshot and record if it may be published and is not the ``last`` one."""
        found = self.state().resolution(staged=True)
        status = "stale_previous" if last else "blocked_no_snapshot"
        if found.gate().first()["publication_allowed"]:
            relations = snapshot_of(found)
            snapshot = snapshot_id(relations).first()["content_id"]
            for name, rows in relations.items():
                rows.write.mode("overwrite").parquet(f"{self.root}/snapshots/snapshot_id={snapshot}/{name}")
            if fail_after == "resolved_state":
                raise RuntimeError(fail_after)
            status = "current" if self.relation("excluded", snapshot).isEmpty() else "current_with_exclusions"
            if last is None or last["snapshot_id"] != snapshot:
                row = [(last["seq"] + 1 if last else 0, snapshot, status)]
                self.spark.createDataFrame(row, PUBLICATIONS).write.mode("append").parquet(f"{self.root}/publications")
            if fail_after == "published_snapshot":
                raise RuntimeError(fail_after)
        return status

    def relation(self, name: str, snapshot: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/snapshots/snapshot_id={snapshot}/{name}")

    def published(self, name: str = "accepted") -> DataFrame:
        """A relation of the newest publication, the accepted state if not said otherwise; readers go through the publication record."""
        last = self.publications().orderBy(F.desc("seq")).first()
        if last is None:
            return snapshot_of(R.resolve(self.raw().limit(0)))[name]
        return self.relation(name, last["snapshot_id"])
