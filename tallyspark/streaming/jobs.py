"""Streaming forms of three batch semantics. State is evidence and is never dropped by a watermark.

Keyed state lies in Spark's state store and is checkpointed with the query; what goes out is changes only. Changes are
kept by ``functions.deltas``: a folder for each micro-batch that changed something, folded together from time to time.
Running a batch again (after a failure between its steps) leaves the tables as they were. One writer is assumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.functions.deltas import Deltas, newest
from tallyspark.operators import resolve as R
from tallyspark.plans.publish import Pipeline
from tallyspark.streaming import state


def ingest_resolve(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Retain each micro-batch under its id, merge it into the resolver's state, gate, publish or stay stale."""
    pipeline = Pipeline(stream.sparkSession, root)

    def step(batch: DataFrame, epoch: int) -> None:
        pipeline.ingest(batch, f"{epoch:012d}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _append_changes(changes: DataFrame, table: Deltas, checkpoint: str, once: str | None = None) -> StreamingQuery:
    """``once`` names the column whose values are written by the first batch that has them, and never again."""

    def step(batch: DataFrame, epoch: int) -> None:
        new = batch if once is None else batch.join(table.read(before=epoch).select(once), once, "left_anti")
        rows = new.persist()
        try:
            if not rows.isEmpty():
                table.add(rows, epoch)
                table.compact()
        finally:
            rows.unpersist()

    with state.state_store(changes.sparkSession):
        return changes.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flags(spark: SparkSession, root: str, event_type: str = "string") -> Deltas:
    """Contradicted event ids, each written once."""
    return Deltas(spark, root, f"event_id {event_type}", newest("event_id"))


def event_conflicts(stream: DataFrame, root: str, checkpoint: str, policy: R.Policy = R.Policy()) -> StreamingQuery:
    """Event ids as they turn contradictory: a batch without a new contradiction writes nothing.

    The state of an event id is its least and its largest payload, an aggregate of Spark's own: no row and no key goes
    through Python. A missing event id is no event.
    """
    payload = F.to_json(F.struct(*policy.payload), {"ignoreNullFields": "false"})
    rows = stream.filter(F.col(policy.event).isNotNull()).select(F.col(policy.event).cast("string").alias("event_id"), payload.alias("payload"))
    seen = rows.groupBy("event_id").agg(F.min("payload").alias("least"), F.max("payload").alias("largest"))
    turned = seen.filter("least < largest").select("event_id")
    return _append_changes(turned, flags(stream.sparkSession, root), checkpoint, once="event_id")


def current_conflicts(spark: SparkSession, root: str) -> DataFrame:
    """Event ids that are contradictory after the last batch."""
    return flags(spark, root).current()


SCHEDULE = "learner_id long, card_id int, interval_days int, due_at timestamp, last_event_id long, updated_at timestamp"


def schedules(spark: SparkSession, root: str) -> Deltas:
    """Changed schedules by batch."""
    return Deltas(spark, root, SCHEDULE, newest("learner_id", "card_id"))


def current_schedules(spark: SparkSession, root: str) -> DataFrame:
    """Every card's schedule after the last batch."""
    return schedules(spark, root).current()


def due_cards(spark: SparkSession, root: str, at: Column | None = None) -> DataFrame:
    """Cards that are due at a time, now if not said otherwise."""
    return current_schedules(spark, root).filter(F.col("due_at") <= (F.current_timestamp() if at is None else at)).select("learner_id", "card_id", "due_at")


def review_schedule(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Running schedules: a batch reads and changes the state of its own cards only, and writes their schedules only.

    A card's state is its last reviews, as many as the interval rule remembers, so late reviews find their place by
    time and repeated ones change nothing.
    """
    spark = stream.sparkSession
    rows = stream.select("event_id", "learner_id", "card_id", "rating", F.unix_micros(F.col("at").cast("timestamp")).alias("at"))
    changed = rows.groupBy("learner_id", "card_id").transformWithState(state.Schedules(), SCHEDULE.replace("timestamp", "long"), "Update", "None")
    changed = changed.withColumns({c: F.timestamp_micros(c) for c in ("due_at", "updated_at")})
    return _append_changes(changed, schedules(spark, root), checkpoint)
