"""Steps whose work must grow no faster than their input, against brute force and by the rows of their steps."""

import random

import pytest

from tallyspark.functions import dealt as D
from tallyspark.operators import catalog as C
from tallyspark.operators import grain as G
from tallyspark.operators import learner as L
from tallyspark.operators import merge as M
from tallyspark.operators import resolve as R
from tallyspark.operators.resolve_state import ResolverState
from tallyspark.plans import publish as P
from tallyspark.plans.resolver_queries import QUERIES, RESOLVE_SQL
from tallyspark.plans.text_queries import QUERIES as QUERIES_OF_TEXTS
from tallyspark.streaming import jobs

DELIVERY = "event_id string, inspection_id string, version int, inspected_units int, defective_units int"


def largest(spark, run):
    """The most rows that any step of a piece of work puts out, as Spark counts them."""
    store = spark._jsparkSession.sharedState().statusStore()
    each = lambda seq: (seq.apply(i) for i in range(seq.size()))
    before = {x.executionId() for x in each(store.executionsList())}
    run()
    most = 0
    for done in [x.executionId() for x in each(store.executionsList()) if x.executionId() not in before]:
        values = store.executionMetrics(done)
        for node in each(store.planGraph(done).allNodes().toSeq()):
            for metric in each(node.metrics().toSeq()):
                text = values.get(metric.accumulatorId())
                if metric.name() == "number of output rows" and text.isDefined():
                    most = max(most, int(text.get().replace(",", "")))
    return most


def test_conflicts_of_a_stream_leave_no_key_to_python(spark, tmp_path):
    rows = [("a", "k", 1, 5, 0), ("a", "k", 1, 5, None), ("b", "k", 1, 5, 0), (None, "k", 1, 1, 1), (None, "k", 2, 1, 1)]
    spark.createDataFrame(rows, DELIVERY).coalesce(1).write.parquet(f"{tmp_path}/in")
    query = jobs.event_conflicts(spark.readStream.schema(DELIVERY).parquet(f"{tmp_path}/in"), f"{tmp_path}/flags", f"{tmp_path}/cp")
    query.awaitTermination()
    assert [r["event_id"] for r in jobs.current_conflicts(spark, f"{tmp_path}/flags").collect()] == ["a"]
    state = [op.operatorName for progress in query.recentProgress for op in progress.stateOperators]
    assert state and set(state) == {"stateStoreSave"}


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_card_pools_by_brute_force(spark, limit):
    r = random.Random(limit)
    opened = [(r.choice([None, 1, 2, 3, 4]), r.choice([None, 1, 2, 3])) for _ in range(12)]
    cards = [(r.choice([None, *range(20)]), r.choice([None, 1, 2, 3, 9])) for _ in range(60)]
    seen = [(r.choice([None, 1, 2, 3, 5]), r.choice([None, *range(20)])) for _ in range(40)]
    frames = spark.createDataFrame(opened, "learner_id int, lesson_id int"), spark.createDataFrame(cards, "card_id int, lesson_id int"), spark.createDataFrame(seen, "learner_id int, card_id int")
    known = {x for x in seen if None not in x}
    for scheduled in (False, True):
        want = []
        for learner in {x for x, _ in opened}:
            mine = [c for who, lesson in set(opened) if who == learner and lesson is not None for c, of in cards if of == lesson and ((learner, c) in known) == scheduled]
            want += [(learner, i + 1, c) for i, c in enumerate(sorted(mine, key=lambda c: (c is not None, c or 0))[:limit])]
        assert sorted(map(tuple, L.card_pool(*frames, limit, scheduled).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("scheduled", [False, True])
def test_card_pools_pair_no_learners_with_cards(spark, scheduled):
    opened = spark.range(2000).selectExpr("id AS learner_id", "1 AS lesson_id")
    cards = spark.range(2000).selectExpr("id AS card_id", "1 AS lesson_id")
    seen = spark.range(6000).selectExpr("id % 2000 AS learner_id", "id div 2000 AS card_id")
    found = []
    rows = largest(spark, lambda: found.extend(L.card_pool(opened, cards, seen, 2, scheduled).collect()))
    first = 0 if scheduled else 3
    assert sorted(map(tuple, found)) == [(i, k + 1, first + k) for i in range(2000) for k in range(2)]
    assert 2000 <= rows < 100_000  # there are 4,000,000 pairs


def test_recovery_without_a_new_batch_reads_no_state(spark, tmp_path):
    pipe = P.Pipeline(spark, f"file://{tmp_path}/p")
    rows = [(f"e{i}", f"k{i}", 1, 5, 0) for i in range(300)]
    assert pipe.ingest(spark.createDataFrame(rows, DELIVERY), "0") == "current"
    again = []
    assert largest(spark, lambda: again.append(pipe.recover())) < 20 and again == ["current"]
    assert pipe.publications().count() == pipe.outbox().count() == 1
    assert pipe.ingest(spark.createDataFrame([("e1", "k1", 1, 6, 0)], DELIVERY), "1") == pipe.recover() == "stale_previous"


def test_kept_deliveries_are_read_without_a_shuffle(spark, tmp_path):
    state = ResolverState(spark, f"{tmp_path}/state")
    for rows in ([("a", "k", 1, 5, None), ("a", "k", 1, 5, None), (None, None, None, None, None)], [("a", "k", 1, 5, None), (None, None, None, None, None), ("b", "", 1, 5, 0)]):
        state.apply(spark.createDataFrame(rows, DELIVERY))
    kept = state.deliveries().current()
    assert kept.count() == 3 and state.resolution().events.count() == 0
    assert "Exchange" not in G.plan_text(kept) and kept.columns == ["event_id", "inspection_id", "version", "inspected_units", "defective_units", "valid"]


def test_events_are_counted_not_compared(spark):
    rows = [("a", "k", 1, 5, 0), ("a", "k", 1, 5, 0), ("b", "k", 1, 5, 0), ("b", "k", 1, 5, None), (" ", "k", 1, 1, 1), (" ", "k", 1, 1, 2)]
    events = R.resolve(spark.createDataFrame(rows, DELIVERY)).events
    assert sorted(map(tuple, events.collect())) == [("a", 1, False), ("b", 2, True)]
    assert "SortAggregate" not in G.plan_text(events)


def test_upsert_violations_join_and_sort_nothing(spark):
    ddl = "k string, v int, q int"
    target = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("b", 2, 5), ("c", 1, None), ("d", 1, None), ("e", None, 1), (None, 1, 1)], ddl)
    source = spark.createDataFrame([("a", 1, 6), ("b", 1, 5), ("c", 1, None), ("d", 1, 0), ("e", None, 2), (None, 1, 2), ("f", 3, 1), ("f", 3, 1)], ddl)
    found = M.upsert_violations(target, source, "k", "v", ["q"])
    assert sorted(map(tuple, found.collect())) == [("duplicate_source_key", "f"), ("duplicate_target_key", "b"), ("equal_version_disagrees", "a"), ("equal_version_disagrees", "d")]
    text = G.plan_text(found)
    assert "Join" not in text and "Sort" not in text


def test_gate_and_totals_of_sql_are_one_pass(spark):
    rows = [("a", "k", 1, 5, 0), ("a", "k", 1, 5, None), ("b", "l", 1, 5, 1), ("b", "l", 1, 5, 1), ("c", "m", 1, 5, 1), ("d", "m", 1, 6, 1), (" ", "n", 1, 5, 1), ("e", "o", None, 5, 1), ("f", "o", 2, 7, 2), ("g", None, 1, 1, 1)]
    raw = spark.createDataFrame(rows, DELIVERY)
    one = spark.sql(RESOLVE_SQL["gate_totals"], raw=raw)
    assert tuple(one.first()) == (1, 2, 3, False, 5, 1, 0.2)
    found = R.resolve(raw)
    assert tuple(one.first()) == (*found.gate().first(), *found.totals().first()) == (*spark.sql(RESOLVE_SQL["gate"], raw=raw).first(), *spark.sql(RESOLVE_SQL["totals"], raw=raw).first())
    assert sorted(map(tuple, spark.sql(RESOLVE_SQL["revision_conflicts"], raw=raw).collect())) == sorted(map(tuple, found.revision_conflicts().collect())) == [("k", 1, 2), ("m", 1, 2)]
    text = G.plan_text(QUERIES["resolve_sql_gate"](spark, "/root/testdata/sf0.001"))
    assert text.count(") Scan parquet") <= 4 and "SortAggregate" not in text  # an events' count, their keys, the revisions


def test_accepted_state_groups_by_hashes(spark):
    rows = [("a", "k", 1, 5, 0), ("a", "l", 1, 5, 0), ("b", "l", 2, 5, 0), ("c", "m", 1, 5, 0), ("c", "m", 1, 5, 0), ("d", "m", 2, 6, 1), ("e", "n", 1, None, 0), ("e2", "n", 2, 4, 4), ("f", "", 1, 5, 0), (None, "o", 1, 5, 0)]
    raw = spark.createDataFrame(rows, DELIVERY)
    for staged in (False, True):
        found = R.resolve(raw, staged=staged)
        assert sorted(map(tuple, found.accepted().collect())) == [("m", 2, 6, 1), ("n", 2, 4, 4)]
        assert sorted(r[0] for r in found.unresolved().collect()) == ["k", "l"] and [r[0] for r in found.excluded().collect()] == ["o"]
    assert "SortAggregate" not in G.plan_text(R.resolve(raw).accepted())


def test_several_relations_are_compared_in_one_pass(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (2, None), (4, "z")], "k int, v string")
    both = G.relation_equivalences(a, {"same": a, "b": b, "types": a.withColumn("k", a.k.cast("long")), "none": a.limit(0)})
    assert sorted(map(tuple, both.collect())) == [(False, None, None, "types"), (True, 0, 0, "same"), (True, 2, 2, "b"), (True, 4, 0, "none")]
    assert tuple(G.relation_equivalence(a, b).first()) == (True, 2, 2)
    assert tuple(G.relation_equivalence(a, b.select("k")).first()) == (False, None, None)
    assert [tuple(r) for r in G.relation_equivalences(a.limit(0), {"b": b}).collect()] == [(True, 0, 4, "b")]


def test_path_neighbours_by_brute_force(spark):
    r = random.Random(8)
    rows = [(r.choice([None, 1, 2, 3, 4]), r.choice([None, 1, 2]), r.choice([None, 1, 2, 3]), r.choice([None, *range(9)])) for _ in range(90)]
    bridges = [(1, -1), (1, -1), (3, -2), (9, -1), (None, -1)]
    paths = {}
    for path, group, place, lesson in rows:
        paths.setdefault(path, {}).setdefault((group is not None, group or 0, place is not None, place or 0), []).append(lesson)
    want = []
    for path, groups in paths.items():
        steps = [min((x for x in groups[k] if x is not None), default=None) for k in sorted(groups)]
        want += [(path, x, steps[i - 1] if i else None, steps[i + 1] if i + 1 < len(steps) else None) for i, x in enumerate(steps)]
        want += [(path, lesson, None, steps[0]) for p, lesson in set(bridges) if p == path and p is not None]
    groups = C.least_lessons(spark.createDataFrame(rows, "path int, group_pos int, lesson_pos int, lesson int"))
    found = C.path_neighbours(groups, spark.createDataFrame(bridges, "path int, lesson int")).select("path", "lesson", "previous", "next")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    text = G.plan_text(groups)
    assert "Aggregate" not in text and text.count(") Sort") == text.count(") Exchange") == 1


@pytest.mark.parametrize("rows_of_a_task", [1, 12, 1000])
def test_arrivals_are_labelled_alike_by_windows_and_joins(spark, monkeypatch, rows_of_a_task):
    r = random.Random(rows_of_a_task)
    pick = lambda *x: r.choice(x)
    rows = [(pick(None, " ", *"abcdefghijkl"), pick(None, "", "k", "k", "k", "l", "m", "n"), pick(None, 0, 1, 1, 2, 3), pick(None, 5, 5, 6), pick(0, 0, None), pick(None, i, i, i)) for i in range(120)]
    raw = spark.createDataFrame(rows, DELIVERY + ", arrival_seq long")
    contradicted = {e for e, *_ in rows if e and e.strip() and len({x[:5] for x in rows if x[0] == e}) > 1}
    want = R._labels_by_joins(raw.withColumn("ec", raw.event_id.isin(*contradicted)), R.Policy(), "arrival_seq")
    monkeypatch.setattr(D, "ROWS", rows_of_a_task)
    monkeypatch.setattr(D, "BUCKETS", 16)
    found = R.classify_arrivals(raw)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    if rows_of_a_task == 1000:
        text = G.plan_text(R.classify_arrivals(raw))  # none is a large key: one shuffle by key, and the join with the contradicted events
        assert text.count(") Sort") == text.count(") Exchange") == 1


def test_dealt_rows_share_no_key(spark, monkeypatch):
    monkeypatch.setattr(D, "ROWS", 50)
    rows = spark.range(1000).selectExpr("CASE WHEN id < 300 THEN 'hot' WHEN id < 340 THEN NULL ELSE 'k' || id END AS k", "id")
    near, far = D.dealt(rows, "k")
    assert {x["k"] for x in far.collect()} == {"hot"} and far.count() == 300 and near.count() == 700
    per_key = near.groupBy("k").count()
    assert per_key.count() == 661 and G.plan_text(per_key).count(") Exchange") == 1 and near.rdd.getNumPartitions() == 20


@pytest.mark.parametrize("rows_of_a_task", [1, 20, 1000])
def test_histories_resolved_together_are_those_resolved_alone(spark, monkeypatch, rows_of_a_task):
    r = random.Random(rows_of_a_task)
    pick = lambda *x: r.choice(x)
    rows = [(pick(None, " ", *range(70)), pick(None, "", "k", "k", *range(30)), pick(None, 0, 1, 1, 2, 3), pick(None, -1, 5, 5, 6), pick(0, 0, None, 7), pick(1, 3, 3, 2, 6)) for _ in range(160)]
    rows = [tuple(str(x) if i < 2 and x is not None else x for i, x in enumerate(row)) for row in rows]
    raw = spark.createDataFrame(rows, DELIVERY + ", histories int")
    monkeypatch.setattr(D, "ROWS", rows_of_a_task)
    monkeypatch.setattr(D, "BUCKETS", 16)
    together = R.resolve_each(raw, ["a", "b", "c", "none"])
    ids = {}
    for i, name in enumerate(together):
        alone = R.resolve(raw.filter(f"histories & {1 << i} <> 0").drop("histories"))
        for relation, want in P.snapshot_of(alone).items():
            got = P.snapshot_of(together[name])[relation]
            assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        assert together[name].gate().first() == alone.gate().first()
        ids[name] = P.snapshot_id(P.snapshot_of(together[name])).first()[0]
        assert ids[name] == P.snapshot_id(P.snapshot_of(alone)).first()[0]
    assert len(set(ids.values())) == 4


def test_snapshots_of_histories_share_their_shuffles(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    each = lambda seq: (seq.apply(i) for i in range(seq.size()))
    before = {x.executionId() for x in each(store.executionsList())}
    found = QUERIES_OF_TEXTS["snapshot_identity"](spark, "/root/testdata/sf0.001")
    assert {tuple(x) for x in found.collect()} == {("once", True), ("replayed", True), ("clean", False), ("later", False)}
    sent = 0
    for done in [x.executionId() for x in each(store.executionsList()) if x.executionId() not in before]:
        values = store.executionMetrics(done)
        of_node = {m.accumulatorId() for node in each(store.planGraph(done).allNodes().toSeq()) for m in each(node.metrics().toSeq()) if m.name() == "shuffle records written"}
        sent += sum(int(values.get(i).get().replace(",", "")) for i in of_node if values.get(i).isDefined())
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert 6 * lines <= sent < 8 * lines  # each line numbered once, and what is sent of the 2.5 rows of a line once by event and once by key
