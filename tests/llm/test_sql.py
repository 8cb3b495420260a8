"""Corpus queries that have SQL give the same rows in DuckDB."""

import random

import duckdb
import pytest

from tallyspark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def same(spark, name, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet{'' if folder == SF else '/*.parquet'}')")
    df, want = QUERIES[name](spark, folder), con.sql(ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    rows = lambda columns, found: sorted((tuple(r[columns.index(c)] for c in order) for r in found), key=repr)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    same(spark, name, SF)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Documents with missing and repeated ids, equal rows, near copies, missing and empty texts."""
    r, words = random.Random(8), [f"w{i}" for i in range(200)]
    base = " ".join(r.choice(words) for _ in range(90))
    texts = [base, base, base + " end", "x " + base, None, "", " \n", "A b", "a B", base.upper(), base[:250], *(" ".join(r.choice(words) for _ in range(60)) for _ in range(8))]
    ids = [None, 3, 3, 9, 9, None, 1, 2, 2, None, 7, *(r.choice([None, 3, 11, 12]) for _ in range(8))]
    rows = [(i, t, r.choice(["en", None, "de"]), r.choice(["a", None, "b", ""]), None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    rows += [(3, base, "en", "a", 5)] * 2 + [(None, base, None, None, None)] * 2
    folder = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql_on_awkward_rows(spark, awkward, name):
    same(spark, name, awkward)
