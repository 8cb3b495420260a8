"""Streams: state kept by Spark, changes only, restarts, folding of deltas."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.deltas import Deltas, newest
from tallyspark.operators import learner as L
from tallyspark.streaming import jobs

DDL = "event_id long, learner_id long, card_id int, rating string, at timestamp"
DELIVERY = "event_id string, inspection_id string, version int, inspected_units int, defective_units int"


def at(i, year=2024):
    return datetime(year, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=i)


def folders(path):
    return sorted(p.name for p in path.iterdir() if not p.name.startswith("."))


def test_schedules_over_restarts(spark, tmp_path):
    r = random.Random(6)
    reviews = [(i, i % 3, i % 2, r.choice(["Again", "Hard", "Good", "Easy"]), at(r.randrange(400))) for i in range(60)]
    reviews += [(100 + i, 9, 1, "Hard", at(i, 2023)) for i in range(40)]  # longer than the memory
    future = (500, 7, 0, "Easy", datetime.now(timezone.utc).replace(microsecond=0))
    parts = [reviews[0::3], reviews[1::3] + reviews[0:5], reviews[2::3] + [future], reviews[:2]]
    r.shuffle(parts[1])
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(DDL).parquet(f"{tmp_path}/in")
        jobs.review_schedule(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        seen = {row[0]: row for part in parts[: k + 1] for row in part}
        got = sorted(map(tuple, jobs.current_schedules(spark, f"{tmp_path}/out").collect()))
        assert got == sorted(map(tuple, L.schedule_fold(spark.createDataFrame(list(seen.values()), DDL)).collect()))
    late = jobs.due_cards(spark, f"{tmp_path}/out").collect()
    assert (7, 0) not in {(x["learner_id"], x["card_id"]) for x in late} and len(late) > 0  # past due times, not the future one


def test_a_batch_writes_its_own_cards_only(spark, tmp_path):
    first = [(i, i, 0, "Good", datetime.now(timezone.utc).replace(microsecond=0)) for i in range(40)]
    later = [(100, 3, 0, "Easy", first[0][4] + timedelta(minutes=5)), (101, 3, 0, "Hard", at(1))]  # one of them late
    for rows in (first, later, later):  # the third batch brings nothing new
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(DDL).parquet(f"{tmp_path}/in")
        jobs.review_schedule(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    names = folders(tmp_path / "out")
    assert [spark.read.parquet(f"{tmp_path}/out/{n}").count() for n in names] == [40, 1]


def test_conflicts_are_written_once(spark, tmp_path):
    batches = [
        [("a", "k", 1, 5, 0), ("b", "k", 1, 5, 0), ("c", None, 2, 5, None), (None, "k", 1, 1, 1)],
        [("a", "k", 1, 5, 0), ("c", None, 2, 5, None)],  # repeats
        [("a", "k", 1, 6, 0), ("d", "k", 1, 1, 1), ("d", "k", 1, 1, None), (None, "k", 2, 2, 2)],  # a and d turn
        [("a", "k", 1, 7, 0), ("d", "k", 1, 1, 1)],  # contradicted already
        [("c", "", 2, 5, None)],  # another key
    ]
    want = [set(), set(), {"a", "d"}, {"a", "d"}, {"a", "c", "d"}]
    for rows, known in zip(batches, want):
        spark.createDataFrame(rows, DELIVERY).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(DELIVERY).parquet(f"{tmp_path}/in")
        jobs.event_conflicts(stream, f"{tmp_path}/flags", f"{tmp_path}/cp").awaitTermination()
        assert {r["event_id"] for r in jobs.current_conflicts(spark, f"{tmp_path}/flags").collect()} == known
    assert len(folders(tmp_path / "flags")) == 2


@pytest.mark.parametrize("limit", [0, 2, 16])
def test_deltas_fold_to_the_newest_row(spark, tmp_path, limit):
    table = Deltas(spark, f"{tmp_path}/t", "k int, v string", newest("k"), limit)
    assert table.applied() == 0 and table.current().count() == 0 and not table.compact()
    want = {}
    for seq in range(7):
        rows = [(k, f"{k}@{seq}") for k in range(seq, seq + 3)]
        for _ in range(2):  # a batch that runs again
            table.add(spark.createDataFrame(rows, "k int, v string"), seq)
        want.update(rows)
        table.compact()
        assert dict(map(tuple, table.current().collect())) == want and table.applied() == seq + 1
        assert len(folders(tmp_path / "t")) <= limit + 1
    (tmp_path / "t/d-000000000099-broken").mkdir()  # a batch that did not end
    assert dict(map(tuple, table.current().collect())) == want
    assert table.read(before=0).count() == 0
    if limit == 16:
        assert sorted(map(tuple, table.batch(3).collect())) == [(k, f"{k}@3", 3) for k in (3, 4, 5)]


def test_schedule_step_is_the_rule(spark):
    from tallyspark.streaming import state

    rows = [(days, rating) for days in range(366) for rating in L.RATINGS]
    df = spark.createDataFrame(rows, "days int, rating string")
    got = df.select("days", "rating", L.next_interval(F.col("days"), F.col("rating")).alias("n")).collect()
    assert all(state.next_interval(x["days"], x["rating"]) == x["n"] for x in got)
