"""Ids at any depth of documents, stored sketches of days."""

import json
import random

import pytest

from tallyspark.operators import catalog as C
from tallyspark.operators import metrics as X


def plain_ids(value, path=""):
    if isinstance(value, list):
        return {x for item in value for x in plain_ids(item, path)}
    if not isinstance(value, dict):
        return set()
    own = {(path, value["id"])} if isinstance(value.get("id"), str) else set()
    return own | {x for key, item in value.items() if key != "id" for x in plain_ids(item, f"{path}.{key}" if path else key)}


def test_ids_at_every_depth(spark):
    docs = [
        {"id": "a", "modules": [{"id": "b", "lessons": [{"id": "c", "x": {"y": {"id": "d"}}}, {"id": 5, "z": [{"id": "e"}]}]}]},
        {"id": {"id": "not looked into"}, "m": {"k1": {"id": "f"}, "k2": {"id": "f"}, "list": [[{"id": "g"}], []]}},
        [{"id": "h"}, 3, "id", None],
        {"id": None, "empty": {}, "none": None, "text": "id"},
        7,
    ]
    rows = [(json.dumps(d),) for d in docs] + [(None,), ("no json",), ("",)]
    got = C.all_ids(spark.createDataFrame(rows, "doc string"), "doc").collect()
    assert {(r["path"], r["id"]) for r in got} == {x for d in docs for x in plain_ids(d)} and len(got) == len({tuple(r) for r in got})
    assert C.all_ids(spark.createDataFrame([], "doc string"), "doc").count() == 0


def test_documents_that_are_too_deep_are_refused(spark, monkeypatch):
    monkeypatch.setattr(C, "LEVELS", 4)
    with pytest.raises(ValueError):
        C.all_ids(spark.createDataFrame([('{"a":{"b":{"c":{"d":{"id":"x"}}}}}',)], "doc string"), "doc").collect()


def test_stored_sketches_are_near_the_rank(spark, tmp_path):
    rows = spark.range(1_000_000).selectExpr("id % 2 as g", "cast(id / 2 % 10 as int) as day", "cast((id * 7919) % 1000003 as double) as value")
    X.day_sketches(rows, "g", "day", "value", 500_000).write.parquet(f"{tmp_path}/s")
    kept = spark.read.parquet(f"{tmp_path}/s")
    for days in ("day >= 0", "day in (1, 2, 5)"):
        got = {r["g"]: r for r in X.tail_of_days(kept.filter(days), "g", 0.95).collect()}
        for g in (0, 1):
            group = rows.filter(days).filter(f"g = {g}")
            n = group.count()
            for name, p in (("median", 0.5), ("tail", 0.95)):
                assert abs(group.filter(f"value <= {got[g][name]}").count() / n - p) < 0.002
            assert got[g]["share_under"] == group.filter("value < 500000").count() / n


def test_small_groups_of_sketches_are_exact(spark):
    r = random.Random(2)
    rows = [(g, d, r.choice([None, *range(100)])) for g in "ab" for d in range(5) for _ in range(60)] + [("c", 1, None)]
    got = {x["g"]: x for x in X.tail_of_days(X.day_sketches(spark.createDataFrame(rows, "g string, day int, value int"), "g", "day", "value", 50), "g", 0.95).collect()}
    assert set(got) == {"a", "b"}
    for g in "ab":
        values = sorted(v for k, _, v in rows if k == g and v is not None)
        assert got[g]["median"] == values[-(-len(values) // 2) - 1] and got[g]["tail"] == values[-(-len(values) * 95 // 100) - 1]
        assert got[g]["share_under"] == sum(v < 50 for v in values) / len(values)


def test_token_types_of_files(spark, tmp_path):
    from tallyspark.sources import readers

    lines = ['{"k": "1"}', '{"k": true}', '{"k": 1.0}', '{"k": null}', "{}", '{"k": 1}', "not json", '{"k": ', "[1]"]
    (tmp_path / "a.json").write_text("\n".join(lines) + "\n", encoding="utf-8")
    got = [(r["k_type"], r["_corrupt_record"]) for r in readers.json_variants(spark, f"{tmp_path}/a.json", ["k"]).collect()]
    assert got == [("STRING", None), ("BOOLEAN", None), ("DECIMAL(1,0)", None), ("VOID", None), (None, None), ("BIGINT", None), (None, "not json"), (None, '{"k": '), (None, None)]
