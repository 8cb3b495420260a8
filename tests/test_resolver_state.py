"""The resolver that keeps state against resolving the whole history."""

import random

import pytest

from tallyspark.operators import resolve as R
from tallyspark.operators.resolve_state import ResolverState

DDL = "event_id string, inspection_id string, version int, inspected_units int, defective_units int"


def history(seed):
    r = random.Random(seed)
    rows = []
    for _ in range(160):
        event = r.choice([None, "", " ", *[f"e{i}" for i in range(90)]])
        rows.append((event, r.choice([None, "", *[f"k{i}" for i in range(30)]]), r.choice([None, 0, -1, 1, 1, 2, 2, 3]), r.choice([None, -1, 5, 5, 5, 9]), r.choice([None, 0, 0, 0, 6])))
    sound = [(f"s{i}", f"q{i % 20}", 1 + i // 20, 10 + i, i % 5) for i in range(60)]
    rows += sound + r.choices(rows, k=30)
    rows += [("s7", "q9", 1, 1, 0)]  # contradicts an event of another key
    r.shuffle(rows)
    return rows


def relations(found):
    named = {"accepted": found.accepted(), "unresolved": found.unresolved(), "excluded": found.excluded(), "gate": found.gate(), "totals": found.totals(), "coverage": R.coverage(found)}
    return {name: sorted(map(repr, df.collect())) for name, df in named.items()}


@pytest.mark.parametrize("order", [0, 1])
def test_batches_in_any_order_equal_the_whole(spark, tmp_path, order):
    rows = history(3)
    want = relations(R.resolve(spark.createDataFrame(rows, DDL), staged=True))
    parts = [rows[k::4] for k in range(4)]
    random.Random(order).shuffle(parts)
    state = ResolverState(spark, f"{tmp_path}/state")
    for part in parts:
        state.apply(spark.createDataFrame(part, DDL))
    assert relations(state.resolution()) == want


def test_a_batch_that_fails_runs_again(spark, tmp_path, monkeypatch):
    rows = history(5)
    first, second = rows[::2], rows[1::2]
    want = relations(R.resolve(spark.createDataFrame(rows, DDL), staged=True))
    state = ResolverState(spark, f"{tmp_path}/state")
    state.apply(spark.createDataFrame(first, DDL))
    whole = ResolverState._keys_of

    def broken(self, *args):
        raise RuntimeError("lost")

    monkeypatch.setattr(ResolverState, "_keys_of", broken)
    with pytest.raises(RuntimeError):
        state.apply(spark.createDataFrame(second, DDL))
    monkeypatch.setattr(ResolverState, "_keys_of", whole)
    assert state.applied() == 1
    state.apply(spark.createDataFrame(second, DDL))
    state.apply(spark.createDataFrame(second, DDL), 1)  # it is there already
    assert relations(state.resolution()) == want and state.applied() == 2
    written = spark.read.parquet(f"{tmp_path}/state/keys/d-000000000001-").count()
    state.apply(spark.createDataFrame(first[:5], DDL))  # nothing new
    assert written > 0 == spark.read.parquet(f"{tmp_path}/state/keys/d-000000000002-").count()


def test_a_contradiction_reaches_the_key_of_an_earlier_batch(spark, tmp_path):
    state = ResolverState(spark, f"{tmp_path}/state")
    state.apply(spark.createDataFrame([("a", "k1", 1, 5, 0), ("b", "k2", 1, 5, 0), ("c", "k3", 1, 5, 0)], DDL))
    state.apply(spark.createDataFrame([("a", "k2", 2, 5, 0)], DDL))
    found = state.resolution()
    assert [r[0] for r in found.accepted().collect()] == ["k3"] and sorted(r[0] for r in found.unresolved().collect()) == ["k1", "k2"]
    assert spark.read.parquet(f"{tmp_path}/state/keys/d-000000000001-").count() == 2
