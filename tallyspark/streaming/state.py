"""Keyed state of the streaming jobs, kept in Spark's state store and checkpointed by Spark."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyspark.operators.learner import AGAIN_SECONDS, DAY_SECONDS, LONGEST, MEMORY

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep state in RocksDB, which keyed processors need; the session's setting is put back."""
    was = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, was)


def next_interval(days: int, rating: str) -> int:
    """The scheduling rule for one review, as ``learner.next_interval``."""
    if rating == "Again":
        return 0
    if rating == "Hard":
        return min(LONGEST, max(1, -(-days * 6 // 5)))
    return min(LONGEST, {"Good": days * 2 or 3, "Easy": days * 3 or 7}.get(rating, days))


class Schedules(StatefulProcessor):
    """Per card: its last MEMORY reviews, in order, as a list; times are microseconds. Reviews may come late or twice. Each change gives the schedule.

    There are no timers: a query with timers of processing time never ends by itself, so due cards are asked of the
    schedules (``jobs.due_cards``)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getListState("tail", "at long, event_id long, rating string")

    def handleInputRows(self, key, rows, timerValues):
        kept = [tuple(x) for x in self.tail.get()] if self.tail.exists() else []
        seen = {x[1] for x in kept}
        new = {row["event_id"]: (row["at"], row["event_id"], row["rating"]) for row in rows if row["event_id"] not in seen}
        tail = sorted(kept + list(new.values()))[-MEMORY:]
        if tail == kept:
            return
        self.tail.put(tail)
        days = 0
        for _, _, rating in tail:
            days = next_interval(days, rating)
        at, event_id, rating = tail[-1]
        wait = AGAIN_SECONDS if rating == "Again" else days * DAY_SECONDS
        yield Row(learner_id=key[0], card_id=key[1], interval_days=days, due_at=at + wait * 1_000_000, last_event_id=event_id, updated_at=at)
