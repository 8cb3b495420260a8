"""Groups that are shared by many tasks: positions, evidence in parts, features carried between ranges of a timeline."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.ranked import ranked
from tallyspark.operators import metrics as X
from tallyspark.operators import resolve as R


@pytest.fixture
def many_ranges(spark):
    names = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_positions(spark, many_ranges):
    r = random.Random(3)
    rows = [(r.choice("aaaaab"), r.randrange(500), i) for i in range(900)]
    got = ranked(spark.createDataFrame(rows, "g string, v int, i int"), ["g"], ["v", "i"]).collect()
    assert ranked(spark.createDataFrame([], "g string, v int, i int"), ["g"], ["v"]).count() == 0
    for g in "ab":
        want = sorted((v, i) for k, v, i in rows if k == g)
        assert {(x["v"], x["i"]): x["index"] for x in got if x["g"] == g} == {x: n for n, x in enumerate(want)}


def test_evidence_of_a_large_contradiction(spark, many_ranges):
    raw = spark.range(100_000).select(F.lit("e").alias("event_id"), F.col("id").cast("string").alias("inspection_id"), F.lit(1).alias("version"), F.lit(5).alias("inspected_units"), F.lit(1).alias("defective_units"), (99_999 - F.col("id")).alias("arrival_seq"))
    parts = sorted((x["part"], x["arrivals"]) for x in R.conflict_evidence(raw).filter("kind = 'event_id'").collect())
    assert [p for p, _ in parts] == list(range(100)) and all(len(a) == R.EVIDENCE for _, a in parts)
    assert [x for _, a in parts for x in a] == list(range(100_000))
    index = ranked(R.conflict_arrivals(raw), ["kind", "identity"], ["arrival_seq"])
    shared = index.groupBy(F.spark_partition_id()).count().collect()
    assert len(shared) > 3 and max(x["count"] for x in shared) < 50_000  # no task has them all


def test_quarantined_arrivals_keep_their_position(spark):
    ddl = "event_id string, inspection_id string, version int, inspected_units int, defective_units int, arrival_seq long, note string"
    rows = [("a", "k", 1, 5, 6, 1, "x"), ("a", "k", 1, 5, 6, 2, "x"), ("b", "k", 0, None, 1, 3, "x"), ("c", "k", 1, 5, 1, 4, "x"), (None, " ", 1, 5, -1, 5, "x")]
    got = {x["arrival_seq"]: x["reasons"] for x in R.quarantined_arrivals(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {1: ["defective_exceeds_inspected"], 2: ["defective_exceeds_inspected"], 3: ["invalid_version", "missing_inspected_units"], 5: ["missing_event_id", "missing_inspection_id", "invalid_defective_units"]}


def test_features_are_carried_between_ranges(spark, many_ranges):
    r = random.Random(8)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for i in range(700):
        entity = r.choice([1, 1, 1, 1, 2, 3, None])  # one entity has most rows
        rows.append((i, entity, start + timedelta(minutes=r.randrange(400)), r.choice(["view", "purchase", "error", "click"]), r.choice([None, *range(50)])))
    rows += [(1000 + i, 7, start + timedelta(minutes=i), "purchase", 1) for i in range(50)] + [(2000, 7, start, "view", 42), (2001, 7, start + timedelta(minutes=60), "error", 1)]
    df = spark.createDataFrame(rows, "event_id int, user_id int, ts timestamp, event_type string, value int")
    got = {x["event_id"]: (x["feature"], x["label"]) for x in X.point_in_time(df, "user_id", "ts", "event_id", "purchase", "view", "error", 600).collect()}
    want = {}
    for i, entity, at, kind, _ in rows:
        if kind == "purchase":
            seen = [(t, e, v) for e, u, t, k, v in rows if u == entity and k == "view" and t <= at and v is not None]
            after = any(u == entity and k == "error" and at < t <= at + timedelta(seconds=600) for _, u, t, k, _ in rows)
            want[i] = (max(seen)[2] if seen else None, after)
    assert got == want
