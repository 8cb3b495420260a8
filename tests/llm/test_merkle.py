"""Merkle manifest against plain recursion, and its paths."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import merkle

DDL = "doc_id long, text string, lang string, source string, n_chars long, size int, index int, tree string, digest string, found string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(leaves):
    """(root, siblings of each leaf with their side) of hex leaves, level by level."""
    now, paths, where = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(now) > 1:
        for i, k in enumerate(where):
            other = k ^ 1
            paths[i].append((k % 2, now[other]) if other < len(now) else (None, ""))
        where = [k // 2 for k in where]
        now = [sha("".join(now[k : k + 2])) for k in range(0, len(now), 2)]
    return now[0], paths


def folded(leaf, path):
    for side, other in path:
        leaf = sha(leaf if side is None else other + leaf if side else leaf + other)
    return leaf


def expected(rows, changed):
    trees = defaultdict(list)
    for doc, text, lang, source, n in rows:
        leaf = sha("".join(map(field, (doc, source, lang, n, text))))
        seen = sha("".join(map(field, (doc, source, lang, changed(doc, n), text))))
        trees[lang].append((-1 if doc is None else doc, leaf, seen, doc))
    order = sorted(trees, key=lambda x: b"" if x is None else b"=" + x.encode())
    made = {lang: brute([leaf for _, leaf, *_ in sorted(trees[lang])]) for lang in order}
    root, above = brute([made[lang][0] for lang in order])
    out = []
    for lang, up in zip(order, above):
        for (_, leaf, seen, doc), path in zip(sorted(trees[lang]), made[lang][1]):
            whole = path + up
            found = folded(seen, whole)
            out.append((doc, lang, leaf, made[lang][0], root, sha("".join(x for _, x in whole)), found, found == root))
    return Counter(out)


@pytest.mark.parametrize("block", [1, 2, 10])
def test_manifest_against_recursion(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    r = random.Random(block)
    langs = ["en"] * 12 + ["de", "fr", None, "", "zz", "é", "日本", "-"]
    rows = [(r.choice([None, *range(60)]), r.choice([None, "", "a é", "x" * 3000]), r.choice(langs), r.choice([None, "s", "12:ab"]), r.choice([None, 0, 7])) for _ in range(90)]
    rows += [rows[0]] * 5 + [(5, "t", "only", "s", 1)]
    df = spark.createDataFrame([(*x, 1, 2, "t", "d", "f") for x in rows], DDL).repartition(5)
    changed = F.col("n_chars") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    got = merkle.manifest(df, found={"n_chars": changed}).collect()
    want = expected(rows, lambda doc, n: n + 1 if n is not None and doc is not None and doc % 3 == 0 else n)
    assert Counter((x["doc_id"], x["lang"], x["leaf"], x["subroot"], x["root"], x["proof_sha256"], x["folded_root"], x["verified"]) for x in got) == want
    assert any(not x["verified"] for x in got) and all(merkle.fold(bytes.fromhex(x["leaf"]), bytes(x["path"])).hex() == x["root"] for x in got)


def test_queue_holds_no_more_than_the_height(monkeypatch):
    most = []

    def push(queue, entry):
        merkle_push(queue, entry)
        most.append(len(queue))

    merkle_push = merkle.heappush
    monkeypatch.setattr(merkle, "heappush", push)
    leaves = [hashlib.sha256(bytes([i % 256, i >> 8])).digest() for i in range(1000)]
    levels = merkle.forward(leaves, 10)
    assert max(most) <= 11 and [len(x) for x in levels][-3:] == [4, 2, 1]
    assert all(merkle.fold(leaf, path) == levels[-1][0] for leaf, path in zip(leaves, merkle.backward(levels, b"")))


def test_manifest_edges(spark):
    empty = spark.createDataFrame([], DDL)
    assert merkle.manifest(empty).count() == 0
    (one,) = merkle.manifest(spark.createDataFrame([(None, None, None, None, None, 1, 1, "", "", "")], DDL)).collect()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] == sha("-----") and one["proof_sha256"] == sha("") and one["verified"]
    long = spark.createDataFrame([(1, "é" * 3_000_000, "en", "s", 3, 1, 1, "", "", ""), (2, "b", "en", "s", 1, 1, 1, "", "", "")], DDL)
    got = {x["doc_id"]: x for x in merkle.manifest(long).collect()}
    assert got[1]["leaf"] == sha("1:1" + "1:s" + "2:en" + "1:3" + "6000000:" + "é" * 3_000_000)
    assert got[2]["proof_sha256"] == sha(got[1]["leaf"]) and got[1]["root"] == sha(got[1]["leaf"] + got[2]["leaf"])
