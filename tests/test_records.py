"""Golden literals of upserts, order lines, grain, schedules, sources and streams."""

import bisect
import json
import random
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import catalog as C
from tallyspark.operators import grain as G
from tallyspark.operators import learner as L
from tallyspark.operators import merge as M
from tallyspark.operators import metrics as X
from tallyspark.operators import orders as O
from tallyspark.operators import text as T
from tallyspark.sources import readers
from tallyspark.streaming import jobs

STATE = "inspection_id string, version int, inspected_units int, defective_units int"
Q = ["inspected_units", "defective_units"]


def test_guarded_upsert(spark):
    target = spark.createDataFrame([("A", 2, 12, 1), ("C", 1, 8, 0)], STATE)

    def up(rows):
        return sorted(map(tuple, M.guarded_upsert(target, spark.createDataFrame(rows, STATE), "inspection_id", "version", Q).collect()))

    assert up([("A", 3, 14, 1)]) == [("A", 3, 14, 1), ("C", 1, 8, 0)]
    assert up([("A", 1, 10, 1), ("C", 1, 8, 0)]) == [("A", 2, 12, 1), ("C", 1, 8, 0)]
    assert up([("Z", 1, 1, 0)]) == [("A", 2, 12, 1), ("C", 1, 8, 0), ("Z", 1, 1, 0)]
    for bad in ([("A", 2, 13, 1)], [("A", 3, 14, 1), ("A", 3, 14, 1)]):
        with pytest.raises(ValueError):
            up(bad)


def test_order_lines(spark):
    rows = [("O7", "L1", 1, 2, 300, "upsert"), ("O7", "L2", 1, 1, 500, "upsert"), ("O7", "L1", 2, 3, 300, "upsert"), ("O7", "L2", 2, 0, 500, "cancel"), ("O8", "L1", 1, 2, 200, "upsert")]
    ddl = "order_id string, line_id string, revision bigint, quantity bigint, unit_cents bigint, operation string"
    for history in (rows, rows[::-1], rows + rows):
        lines = O.current_lines(spark.createDataFrame(history, ddl))
        assert sorted(map(tuple, O.order_totals(lines).collect())) == [("O7", 900), ("O8", 400)]
        assert tuple(O.order_summary(lines).first()) == (1300, 3, 2, 1, 0)
    doubt = O.current_lines(spark.createDataFrame([*rows, ("O7", "L1", 2, 4, 300, "upsert")], ddl))
    assert O.order_summary(doubt).first()["ambiguous_lines"] == 1


def test_grain(spark):
    facts = spark.createDataFrame([("A", 12, 1), ("C", 8, 0)], "inspection_id string, inspected bigint, defective bigint")
    tags = spark.createDataFrame([("A", "urgent"), ("A", "sampled"), ("C", "routine")], "inspection_id string, tag string")
    got = G.fanout_audit(facts, tags, "inspection_id", ["inspected", "defective"]).first()
    assert (got["rows_after"], got["inspected_after"], got["defective_after"], got["multiplies"]) == (3, 32, 2, True)
    old = spark.range(0, 10).select("id", F.lit(1).alias("v"))
    moved = spark.range(5, 15).select("id", F.lit(1).alias("v"))
    counts = {r["status"]: r["count"] for r in G.dual_run(old, moved, ["id"], ["v"]).groupBy("status").count().collect()}
    assert counts == {"missing": 5, "extra": 5}
    assert tuple(G.relation_equivalence(old, moved).first()) == (True, 5, 5)


def test_value_and_latency(spark):
    grid = {r["hours"]: r for r in X.value_sensitivity(spark.createDataFrame([("s", 48, 27000)], "scenario string, weeks bigint, costs bigint"), 60, 15, 5).collect()}
    assert [grid[h]["net"] for h in (5, 10, 15)] == [-12600, 1800, 16200] and grid[5]["break_even"] == 9.375
    a = spark.createDataFrame([(1, 30, 5, 10)], "run int, queue int, execution int, transfer int")
    b = spark.createDataFrame([(1, 0, 5, 10)], a.schema)
    got = X.latency_attribution(b, a, "run", ["queue", "execution", "transfer"]).first()
    assert (got["total"], got["queue"], got["mostly"]) == (30, 30, "queue")


@pytest.mark.parametrize(("previous", "rating", "days"), [(0, "Again", 0), (4, "Again", 0), (0, "Hard", 1), (1, "Hard", 2), (4, "Hard", 5), (364, "Hard", 365), (0, "Good", 3), (4, "Good", 8), (0, "Easy", 7), (4, "Easy", 12), (200, "Easy", 365), (-1, "Good", None), (5, "Other", None)])
def test_intervals(spark, previous, rating, days):
    got = spark.range(1).select(L.next_interval(F.lit(previous), F.lit(rating))).first()[0]
    assert got == days


def test_fold_needs_only_its_memory(spark):
    """Ratings before the last MEMORY ones never change an interval, from whatever interval they start."""
    days = F.aggregate(F.array_repeat(F.lit("Hard"), L.MEMORY - 1), F.lit(0), lambda d, r: L.next_interval(d, r))
    assert spark.range(1).select(days).first()[0] == L.LONGEST
    rows = [(i, 1, 1, ["Good", "Hard", "Easy"][i % 3] if i % 41 else "Again", datetime(2024, 1, 1, 0, i // 60, i % 60, tzinfo=timezone.utc)) for i in range(200)]
    reviews = spark.createDataFrame(rows, "event_id long, learner_id long, card_id int, rating string, at timestamp")
    whole = 0
    for r in rows:
        whole = {"Again": 0, "Hard": min(365, max(1, -(-whole * 6 // 5))), "Good": 3 if whole == 0 else min(365, 2 * whole), "Easy": 7 if whole == 0 else min(365, 3 * whole)}[r[3]]
    got = L.schedule_fold(reviews.union(reviews.limit(5))).first()
    assert (got["interval_days"], got["last_event_id"]) == (whole, 199)


def test_queue(spark):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    sched = spark.createDataFrame([(1, c, 0, at, 0) for c in ("c", "a", "b")], "learner_id int, card_id string, interval_days int, due_at timestamp, revision int")
    cards = spark.createDataFrame([(c, 0) for c in "abc"], "card_id string, revision int")
    assert L.due_queue(sched, cards, F.lit("2023-12-31 23:59:59").cast("timestamp"), 2).count() == 0
    assert [r["card_id"] for r in L.due_queue(sched, cards, F.lit(at), 2).orderBy("place").collect()] == ["a", "b"]


def test_divergent_text_is_kept_and_stable(spark):
    rows = spark.createDataFrame([("n", 1, "old"), ("n", 2, "new"), ("n", 2, "new"), ("m", 1, None)], "id string, updated int, text string")
    once = M.merge_divergent(rows, "id", "updated", "text")
    again = M.merge_divergent(rows.union(rows), "id", "updated", "text")
    assert sorted(map(tuple, once.fillna("-").collect())) == sorted(map(tuple, again.fillna("-").collect())) and once.count() == 3
    assert {r["text"] for r in once.collect() if r["id"] == "n"} == {"new"}


def test_migration_and_frames(spark):
    old = spark.createDataFrame([(1, v, ["x"], "p", False) for v in (1, 2, 3, 4)], "id int, schema_version int, extra_practice array<string>, path_id string, show_extra boolean")
    got = sorted((len(r["extra_practice"]), r["path_id"], r["show_extra"]) for r in L.migrate(old).collect() if r["path_id"])
    assert L.migrate(old).filter("schema_version = 4").count() == 4 and got == [(1, "p", False), (1, "p", True)]
    frames = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 1, "z"), ("c", 0, "x"), ("c", 0, "x")], "b string, part int, data string")
    assert {r["b"]: r["status"] for r in M.frame_audit(frames, "b", "part", "data").collect()} == {"a": "ok", "b": "missing_part", "c": "repeated_part"}


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (7, 1), (8, 8), (9, 10)], "src long, dst long")
    assert sorted(r["id"] for r in C.cycle_nodes(edges).collect()) == [1, 2, 3, 5, 6, 8]
    assert C.cycle_nodes(edges.filter("src > 8")).count() == 0


def test_text(spark):
    md = "Intro\n<!-- section:a -->\nSee [x](https://e.org) and `[no](#/no)` [[c1|Concept one]].\n```py\n[z](w)\n```\n<!-- section:b -->\nEnd"
    row = spark.createDataFrame([(1, md)], "id int, md string")
    assert row.select(T.links(T.without_code(F.col("md")))).first()[0] == ["https://e.org"]
    assert row.select(T.concept_ids(F.col("md"))).first()[0] == ["c1"] and "Concept one." in row.select(T.plain_concepts(F.col("md"))).first()[0]
    assert row.select(T.first_fence(F.col("md"))).first()[0] == "[z](w)"
    assert [(r["ord"], r["section"]) for r in T.sections(row, "id", "md").collect()] == [(0, None), (1, "a"), (2, "b")]
    urls = ["https://a.org/x", "http://a.org", "https://u:p@a.org", "nonsense", None]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(C.https_url(F.col("u"))).collect()] == [True, False, False, False, False]
    paths = ["a/b.txt", "../a", "a//b", "a\\b", "con/x", "a/b.", None]
    assert [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(C.safe_path(F.col("p"))).collect()] == [True, False, False, False, False, False, False]


def test_readers(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"late": [{"event_id": "e", "inspection_id": "A", "version": 1}], "none": []}))
    assert [tuple(r)[:4] for r in readers.json_batches(spark, str(tmp_path / "b.json")).collect()] == [("late", 0, "e", "A")]
    (tmp_path / "l.json").write_text('{"v": "1"}\n{"v": true}\n{"v": 1}\n{}\n{"v": null}\nnot json\n')
    kinds = [r["v_type"] for r in readers.json_strict(readers.json_lines(spark, str(tmp_path / "l.json")), "text", ["v"]).collect()]
    assert kinds == ["STRING", "BOOLEAN", "BIGINT", None, "VOID", None]
    (tmp_path / "c.csv").write_text("record_id,units\np1,7\np2,\n")
    assert [tuple(r) for r in readers.csv_header(spark, str(tmp_path / "c.csv"), ["record_id", "units"]).collect()] == [("p1", "7"), ("p2", None)]


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i, i % 3, i % 2, ["Again", "Hard", "Good", "Easy"][i * 7 % 4], datetime(2024, 1, 1, 0, i % 60, tzinfo=timezone.utc)) for i in range(90)]
    ddl = "event_id long, learner_id long, card_id int, rating string, at timestamp"
    whole = spark.createDataFrame(rows, ddl)
    for k in range(3):
        whole.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.review_schedule(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = sorted(map(tuple, jobs.current_schedules(spark, f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, L.schedule_fold(whole).collect()))


def test_cycles_against_reachability(spark):
    r = random.Random(2)
    for n, m in ((12, 16), (20, 30), (9, 20)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        reach = {(a, b) for a, b in edges}
        while longer := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
            reach |= longer
        got = C.cycle_nodes(spark.createDataFrame([*edges, (None, 1)], "src int, dst int"))
        assert sorted(x["id"] for x in got.collect()) == sorted(a for a in range(n) if (a, a) in reach)


def test_features_of_a_long_timeline(spark):
    n = 60_000
    kind = F.when(F.col("id") % 3 == 0, "view").when(F.col("id") % 3 == 1, "purchase").when(F.col("id") % 50 == 2, "error").otherwise("signup")
    rows = spark.range(n).select(F.lit(1).alias("user_id"), (F.col("id") * 60).cast("timestamp").alias("ts"), F.col("id").alias("event_id"), kind.alias("event_type"), F.col("id").cast("double").alias("value"))
    began = time.monotonic()
    got = X.point_in_time(rows, "user_id", "ts", "event_id", "purchase", "view", "error", 600).collect()
    assert time.monotonic() - began < 60  # two passes; all pairs would be 3.6 billion
    errors = [i for i in range(n) if i % 3 == 2 and i % 50 == 2]
    for x in got[:: n // 300]:
        i = x["event_id"]
        assert x["feature"] == i - 1 and x["label"] == any(i < e <= i + 10 for e in errors[bisect.bisect_right(errors, i) :][:1])


def test_apply_resolved_compares_quantities_only(spark):
    ddl = "k string, version int, q int, loaded string"
    target = spark.createDataFrame([("a", 1, 5, "old"), ("b", 2, 6, "old"), ("c", 3, 7, "old")], ddl)
    source = spark.createDataFrame([("a", 2, 9, "new"), ("b", 2, 6, "new"), ("c", 1, 1, "new"), ("d", 1, 0, "new")], ddl)
    got = sorted(map(tuple, M.apply_resolved(target, source, "k", "version", ["q"]).collect()))
    assert got == [("a", 2, 9, "new"), ("b", 2, 6, "old"), ("c", 3, 7, "old"), ("d", 1, 0, "new")]
    with pytest.raises(ValueError, match="equal_version_disagrees"):
        M.apply_resolved(target, source.withColumn("q", F.col("q") + 1), "k", "version", ["q"])
    with pytest.raises(ValueError, match="equal_version_disagrees"):
        M.guarded_upsert(target, source, "k", "version", ["q", "loaded"])
