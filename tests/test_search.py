"""Search by grams against a scan of all texts."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import search as S
from tallyspark.operators import text as T

ORDER = ["kind", "id"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    r = random.Random(4)
    words = ["alpha", "Beta", "gamma ray", "ÜBER", "日本語", "a.b*c", "x\ny", "the MIT", "the", "mit", "  ", "delta", "zz"]
    rows = [(i % 3, i, " ".join(r.choices(words, k=r.randrange(0, 9))) if i % 11 else None, f"t{i}") for i in range(300)]
    rows += [(9, 1000 + i, "common common", "c") for i in range(200)] + [(9, 2000, "q" * 50_000 + "needle", "n")]
    df = spark.createDataFrame(rows, "kind int, id long, text string, title string").repartition(5)
    root = str(tmp_path_factory.mktemp("grams"))
    S.write(df, ORDER, root)
    return df, root


@pytest.mark.parametrize("q", ["the mit", "The MIT", "a", "ta", "zz", "gamma ray alpha", "über", "日本語", "a.b*c", "x\ny", "common", "qqneedle", "nowhere at all", "mit the", "   ", "alpha beta"])
@pytest.mark.parametrize("limit", [5, 1000])
def test_same_rows_as_a_scan(spark, kept, q, limit):
    df, root = kept
    want = [tuple(x) for x in T.search(df, q, limit, ORDER).select("kind", "id", "text", "title").collect()]
    assert [tuple(x) for x in S.search(spark, root, ORDER, q, limit).select("kind", "id", "text", "title").collect()] == want


def test_only_the_rarest_grams_are_read(spark, kept):
    _, root = kept
    chosen = S.rarest(spark, root, "common qqneedle the") or S.rarest(spark, root, "qqneedle")
    assert len(chosen) <= S.RAREST and "qqq" not in chosen
    rows = S.postings(spark, root, chosen)
    paths = rows.select(F.input_file_name().alias("f")).distinct().collect()
    buckets = {r["b"] for r in spark.createDataFrame([(g,) for g in chosen], "g string").select(S._bucket(F.col("g")).alias("b")).collect()}
    assert {int(p["f"].split("bucket=")[1].split("/")[0]) for p in paths} == buckets
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "In(gram" in plan
    assert S.rarest(spark, root, "xyzxyz") is None


def test_grams_of_awkward_texts(spark):
    rows = [(None,), ("",), ("ab",), ("aBc",), ("a\nbc",), ("ababab",)]
    got = [x[0] for x in spark.createDataFrame(rows, "text string").select(S.grams(F.col("text"))).collect()]
    assert got == [None, [], [], ["abc"], ["a\nb", "\nbc"], ["aba", "bab"]]


def test_postings_are_kept_by_many_entries(spark, tmp_path):
    texts = [None, "", "ab", "aBc", "a\nbc", "ababab", "x\0\0", "\0\0x", "ÀÉß straße", "日本語 日本語", "a😀b😀c", *["common words"] * 500]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "kind int, id long, text string")
    S.write(df, ORDER, str(tmp_path))
    kept = spark.read.parquet(f"{tmp_path}/postings")
    places = spark.read.parquet(f"{tmp_path}/entries").select("slot", "entry", "id")
    got = S.postings(spark, str(tmp_path), [r[0] for r in kept.select("gram").distinct().collect()]).join(places, ["slot", "entry"])
    want = {(i, t.lower()[k : k + 3]) for i, t in enumerate(texts) if t for k in range(len(t.lower()) - 2)}
    found = [(r["id"], r["gram"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert kept.count() < len(want) / 5
    assert {r["gram"]: r["n"] for r in spark.read.parquet(f"{tmp_path}/grams").collect()}["mmo"] == 500


def test_chunks_end_with_their_slot_size_and_offsets(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 12)
    rows = [(0, 5, "abcd"), (0, 6, None), (0, 7, "bcd"), (0, 9, "abcdefgh"), (0, 1 << 40, "abc"), (1, 3, "abc"), (1, 4, "ab")]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("slot", "entry", "text"), r)) for r in part]) for part in (rows[:2], rows[2:])]
    out = [(c["slot"], c["first"], c["gram"], c["n"], c["offsets"]) for b in S._lists(iter(batches)) for c in b.to_pylist()]
    assert out[:2] == [(0, 5, "abc", 1, [0]), (0, 5, "bcd", 2, [0, 2])]
    assert [(s, f) for s, f, g, *_ in out if g == "abc"] == [(0, 5), (0, 9), (0, 1 << 40), (1, 3)]
    assert all(n == len(offsets) for *_, n, offsets in out)


def test_entries_of_one_name_are_all_found(spark, tmp_path):
    df = spark.createDataFrame([(1, 7, "the mit one"), (1, 7, "the mit two"), (1, 8, "other")], "kind int, id long, text string")
    S.write(df, ORDER, str(tmp_path))
    assert sorted(r["text"] for r in S.search(spark, str(tmp_path), ORDER, "the mit").collect()) == ["the mit one", "the mit two"]
