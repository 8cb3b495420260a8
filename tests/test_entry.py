"""Every registered query that has SQL gives the same rows in DuckDB; the entry imports without the corpus folders."""

import datetime
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from tallyspark.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.10g}")
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    df, want = QUERIES[name](spark, SF), db.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["inspection_id", "version", "inspected_units", "defective_units"]


def test_imports_without_the_corpus_folders(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(os.path.join(root, "tallyspark"), tmp_path / "tallyspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'accepted_state' in q and 'pipeline' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_documents_of_a_key_are_bounded(spark, monkeypatch):
    from collections import Counter

    from tallyspark.plans import text_queries as Q
    from tallyspark.plans import views as V
    from tallyspark.sources import readers

    monkeypatch.setattr(V, "PART_ROWS", 50)
    rows = spark.createDataFrame([(1, i) for i in range(2000)] + [(2, i) for i in range(5)] + [(None, i) for i in range(400)], "user_id int, event_id int")
    parted = V.in_parts(rows, "user_id", "event_id").collect()
    assert Counter((r["user_id"], r["event_id"]) for r in parted) == Counter((r["user_id"], r["event_id"]) for r in rows.collect())
    sizes = Counter((r["user_id"], r["part"]) for r in parted)
    assert max(sizes.values()) <= 100 and sizes[2, 0] == 5

    held = []
    family = readers.family
    monkeypatch.setattr(readers, "family", lambda docs, *rest: held.append(docs) or family(docs, *rest))
    monkeypatch.setattr(V, "PART_ROWS", 5)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = Q.scan_state_doc(spark, "/root/testdata/sf0.001")
    assert Counter(r["id"] for r in got.collect()) == Counter(r["event_id"] for r in events.collect())
    largest_user = events.groupBy("user_id").count().agg({"count": "max"}).first()[0]
    entries = [len(d["doc"].split('"rating"')) - 1 for d in held[0].collect()]
    assert sum(entries) == events.count() and max(entries) < largest_user
    want = {r["event_type"]: (r["n"], r["s"]) for r in events.selectExpr("event_type", "event_id").groupBy("event_type").agg({"event_id": "sum", "*": "count"}).toDF("event_type", "s", "n").collect()}
    batches = {r["batch_id"]: (r["rows"], r["ids"]) for r in Q.scan_json_batches(spark, "/root/testdata/sf0.001").collect()}
    assert batches in (want, {k: v[::-1] for k, v in want.items()})
    folders = []
    scratch = Q.scratch
    monkeypatch.setattr(Q, "scratch", lambda *a: folders.append(scratch(*a)) or folders[-1])
    nations, customers = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("nation", "customer"))
    paths = Q.scan_paths(spark, "/root/testdata/sf0.001").collect()
    assert sum(r["groups"] for r in paths) == nations.count() and sum(r["lessons"] for r in paths) == customers.count()
    assert spark.read.json(folders[-1]).count() > len(paths)
