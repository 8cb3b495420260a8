"""Golden literals of record reconciliation, and properties that must hold on any history."""

import random

import pytest

from tallyspark.operators import resolve as R
from tallyspark.plans import publish as P

DDL = "event_id string, inspection_id string, version int, inspected_units int, defective_units int"
BASE = [("ev1", "A", 1, 10, 1), ("ev1", "A", 1, 10, 1), ("ev2", "B", 1, -3, 1), ("ev3", "A", 2, 12, 1), ("ev4", "C", 1, 8, 0)]
CORRECTION = ("ev5", "A", 3, 14, 1)
CASES = {
    "baseline": ([], [("A", 2, 12, 1), ("C", 1, 8, 0)], (20, 1, 0.05), ["B"], [], (0, 0, 0)),
    "replay": (BASE, [("A", 2, 12, 1), ("C", 1, 8, 0)], (20, 1, 0.05), ["B"], [], (0, 0, 0)),
    "late": ([("ev-late", "A", 1, 10, 1)], [("A", 2, 12, 1), ("C", 1, 8, 0)], (20, 1, 0.05), ["B"], [], (0, 0, 0)),
    "correction": ([CORRECTION, CORRECTION], [("A", 3, 14, 1), ("C", 1, 8, 0)], (22, 1, 1 / 22), ["B"], [], (0, 0, 0)),
    "event_conflict": ([("ev3", "A", 2, 13, 1)], [("C", 1, 8, 0)], (8, 0, 0.0), ["B"], ["A"], (1, 1, 1)),
    "version_conflict": ([("ev-other", "A", 2, 13, 1)], [("C", 1, 8, 0)], (8, 0, 0.0), ["B"], ["A"], (0, 1, 1)),
    "invalid_latest": ([("ev-invalid", "A", 3, None, 1)], [("C", 1, 8, 0)], (8, 0, 0.0), ["B"], ["A"], (0, 0, 1)),
    "missing_order": ([("ev-unordered", "A", None, 14, 1)], [("C", 1, 8, 0)], (8, 0, 0.0), ["B"], ["A"], (0, 0, 1)),
    "unkeyed": ([("unkeyed", None, 1, 2, 0), ("unkeyed", None, 1, 3, 0), CORRECTION], [("A", 3, 14, 1), ("C", 1, 8, 0)], (22, 1, 1 / 22), ["B"], [], (1, 0, 0)),
}


def outcome(spark, rows):
    found = R.resolve(spark.createDataFrame(rows, DDL))
    gate = found.gate().first()
    total = found.totals().first()
    return (
        sorted(map(tuple, found.accepted().collect())),
        tuple(total),
        sorted(r[0] for r in found.excluded().collect()),
        sorted(r[0] for r in found.unresolved().collect()),
        (gate["event_conflicts"], gate["revision_conflicts"], gate["unresolved_keys"]),
        gate["publication_allowed"],
    )


@pytest.mark.parametrize("case", CASES)
def test_golden(spark, case):
    more, accepted, totals, excluded, unresolved, counts = CASES[case]
    rows = BASE + more
    random.Random(case).shuffle(rows)
    got = outcome(spark, rows)
    assert got[0] == accepted and got[1] == pytest.approx(totals) and got[2:5] == (excluded, unresolved, counts)
    assert got[5] == (counts == (0, 0, 0))


@pytest.mark.parametrize("blank", [None, "", "   ", "\t\r\n", "  "])
def test_blank_keys_block_without_a_key(spark, blank):
    got = outcome(spark, [("u", blank, 1, 2, 0), ("u", blank, 1, 3, 0)])
    assert got == ([], (None, None, None), [], [], (1, 0, 0), False)


def test_reasons_in_order(spark):
    rows = [("k", None, 1, 3, 0), ("v", "D", 0, 3, 0), ("n", "E", 1, None, 0), ("q", "F", 1, 3, 4), ("m", "G", 1, -5, -1)]
    got = {r["event_id"]: r["reasons"] for r in R.resolve(spark.createDataFrame(rows, DDL)).quarantine().collect()}
    assert got == {"k": ["missing_inspection_id"], "v": ["invalid_version"], "n": ["missing_inspected_units"], "q": ["defective_exceeds_inspected"], "m": ["invalid_inspected_units", "invalid_defective_units", "defective_exceeds_inspected"]}


def test_evidence_and_labels(spark):
    rows = [(*r, i) for i, r in enumerate([*BASE, ("ev3", "A", 2, 12, 1), ("ev8", "A", 2, 12, 1), ("ev9", "A", 1, 10, 1), CORRECTION])]
    raw = spark.createDataFrame(rows, DDL + ", arrival_seq long")
    labels = {r["arrival_seq"]: r["label"] for r in R.classify_arrivals(raw).collect()}
    assert [labels[i] for i in (5, 6, 7, 8)] == ["identical_delivery", "redundant_evidence", "redundant_evidence", "correction"]
    more = raw.union(spark.createDataFrame([("ev5", "A", 3, 15, 1, 9), ("ev6", "A", None, 16, 1, 10)], raw.schema))
    labels = {r["arrival_seq"]: r["label"] for r in R.classify_arrivals(more).collect()}
    assert (labels[8], labels[9], labels[10]) == ("conflict", "conflict", "unresolved_ordering")
    evidence = {(r["kind"], r["identity"]): r["arrivals"] for r in R.conflict_evidence(more).collect()}
    assert evidence == {("event_id", "ev5"): [8, 9], ("key_version", "A@3"): [8, 9]}


def test_simple_policy_brings_back_an_older_revision(spark):
    rows = [(*r, i) for i, r in enumerate([*BASE, ("ev7", "A", 3, -1, 0)])]
    got = sorted(map(tuple, R.resolve_simple(spark.createDataFrame(rows, DDL + ", arrival_seq long")).collect()))
    assert got == [("A", 2, 12, 1), ("C", 1, 8, 0)]


def test_empty_history(spark):
    assert outcome(spark, []) == ([], (None, None, None), [], [], (0, 0, 0), True)


def test_publication_survives_failures(spark, tmp_path):
    def frame(rows):
        return spark.createDataFrame(rows, DDL)

    pipe = P.Pipeline(spark, f"file://{tmp_path}/a")
    assert pipe.ingest(frame([("x", "A", 1, 1, 0), ("x", "A", 1, 2, 0)]), "0") == "blocked_no_snapshot"
    assert pipe.publications().count() == pipe.outbox().count() == 0

    pipe = P.Pipeline(spark, f"file://{tmp_path}/b")
    assert pipe.ingest(frame(BASE), "0") == "current_with_exclusions"
    with pytest.raises(RuntimeError):
        pipe.ingest(frame([CORRECTION]), "1", "retained_raw")
    assert pipe.raw().count() == 6 and sorted(map(tuple, pipe.published().collect())) == [("A", 2, 12, 1), ("C", 1, 8, 0)]
    with pytest.raises(RuntimeError):
        pipe.recover("published_snapshot")
    assert pipe.outbox().count() == 1
    pipe.recover()
    pipe.recover()
    assert pipe.outbox().count() == 2 and pipe.publications().count() == 2
    assert sorted(map(tuple, pipe.published().collect())) == [("A", 3, 14, 1), ("C", 1, 8, 0)]
    assert pipe.ingest(frame([("ev5", "A", 3, 15, 1)]), "2") == "stale_previous"


def test_a_change_of_exclusions_alone_is_published(spark, tmp_path):
    def frame(rows):
        return spark.createDataFrame(rows, DDL)

    pipe = P.Pipeline(spark, f"file://{tmp_path}/c")
    assert pipe.status() == "not_published"
    with pytest.raises(RuntimeError):
        pipe.ingest(frame([("a1", "A", 1, 10, 1)]), "0", "retained_raw")
    assert pipe.status() == "not_published"
    assert pipe.recover() == "current" and pipe.status() == "stale_previous"
    assert pipe.ingest(frame([("a1", "A", 1, 10, 1)]), "1") == "current" and pipe.publications().count() == 1  # a replay
    assert pipe.ingest(frame([("z1", "Z", 1, -5, 0)]), "2") == "current_with_exclusions"
    assert [(r["seq"], r["status"]) for r in pipe.publications().orderBy("seq").collect()] == [(0, "current"), (1, "current_with_exclusions")]
    assert pipe.outbox().count() == 2 and [r[0] for r in pipe.published("excluded").collect()] == ["Z"]
    assert [tuple(r) for r in pipe.published().collect()] == [("A", 1, 10, 1)]
    assert pipe.published("totals").first()["inspected_units"] == 10 and pipe.published("coverage").first()["excluded"] == 1
    assert len({P.snapshot_id(P.snapshot_of(R.resolve(frame(x)))).first()[0] for x in (BASE, [*BASE, BASE[0]], BASE[:-1])}) == 2


def test_conflicting_revisions_are_counted(spark):
    rows = [("e1", "A", 1, 5, 1), ("e2", "A", 1, 6, 1), ("e3", "A", 1, None, 1), ("e4", "A", 1, 5, 1), ("e5", "A", 2, 5, 1)]
    assert [tuple(r) for r in R.resolve(spark.createDataFrame(rows, DDL)).revision_conflicts().collect()] == [("A", 1, 3)]


def test_content_id_ignores_order(spark):
    rows = spark.createDataFrame(BASE, DDL)
    one, two = P.content_id(rows).first()[0], P.content_id(rows.orderBy("version", ascending=False).repartition(3)).first()[0]
    assert one == two != P.content_id(rows.distinct()).first()[0]
