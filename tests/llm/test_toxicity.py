"""Toxicity network: gradients, windows, edges, held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import gru, toxicity

DDL = "doc_id long, text string, lang string, label int, body string, held_out string, windows int"
SF = "/root/testdata/sf0.1"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "b", "h", 2) for i, t in rows], DDL)


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in gru.new_layer(rng, "x", 3, 4, 5).items()}
    x, mask = rng.standard_normal((6, 2, 3)), np.ones((6, 2, 1), bool)
    mask[4:, 1] = False
    aim = rng.standard_normal((2, 8))
    value = lambda: float((gru.forward(p, "x", gru.projected(p, "x", x), mask) * aim).sum())
    grads = {}
    _, kept = gru.forward(p, "x", gru.projected(p, "x", x), mask, keep=True)
    grads["input"] = gru.backward(p, "x", x, mask, kept, aim, grads)
    for name, g in grads.items():
        target = x if name == "input" else p[name]
        for place in [tuple(rng.integers(0, s) for s in target.shape) for _ in range(6)]:
            was = target[place]
            target[place] = was + 1e-6
            up = value()
            target[place] = was - 1e-6
            down = value()
            target[place] = was
            assert g[place] == pytest.approx((up - down) / 2e-6, abs=1e-6), name


def test_windows_cover_all_words_twice():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        starts = toxicity.window_starts(n)
        assert starts[0] == 0 and (np.diff(starts) == toxicity.STRIDE).all() and starts[-1] + toxicity.WINDOW >= n
        assert n <= toxicity.WINDOW or starts[-1] + toxicity.STRIDE < n
    pieces = toxicity.words_of(b"Ab " + b"0123456789" * 5 + b"\t\xc3\xa9")
    assert pieces[0] == b"ab" and pieces[-1] == b"\xc3\xa9" and all(len(w) <= toxicity.LETTERS for w in pieces)
    assert pieces[1][0:8] + b"".join(w[8:] if i else w[8:] for i, w in enumerate(pieces[1:-1])) == b"0123456789" * 5


def small_network(seed=3):
    r = random.Random(seed)
    calm, bad = [b"w%d" % i for i in range(300)], [b"rotten", b"vile", b"nasty"]
    texts, labels = [], []
    for i in range(300):
        words = [r.choice(calm) for _ in range(r.randrange(5, 80))]
        if i % 3 == 0:
            words[r.randrange(len(words))] = r.choice(bad)
        texts.append([words[s : s + toxicity.WINDOW] for s in toxicity.window_starts(len(words)).tolist()])
        labels.append(i % 3 == 0)
    return toxicity.fit(texts, np.array(labels, np.float32))


def test_scores_do_not_depend_on_batches_and_whole_texts_count(spark):
    import pickle

    network = pickle.dumps(small_network())
    calm = " ".join(f"w{i % 300}" for i in range(40_000))
    rows = [(None, "w1 w2 VILE w3"), (2, calm), (3, calm + " nasty"), (4, ""), (5, None), (6, " \n"), (2, "w1 w2 vile w3"), (7, "x" * 200_000), (8, "w5 " * 10)]
    got = toxicity.score(frame(spark, rows).repartition(3), network).collect()
    by = {(r["doc_id"], r["n_windows"]): r for r in got}
    assert len(got) == len(rows) and by[None, 1]["score"] == pytest.approx(by[2, 1]["score"]) and by[None, 1]["predicted"] == 1
    assert [by[i, n]["predicted"] for i, n in ((2, 2499), (3, 2500), (4, 1), (8, 1))] == [0, 1, 0, 0]
    assert by[3, 2500]["worst_word"] + toxicity.WINDOW > 40_000 and by[4, 1]["score"] == by[5, 1]["score"] == by[6, 1]["score"]
    net = small_network()
    words = [b"w1", b"rotten", b"w2"]
    windows = np.full((5000, toxicity.WINDOW), -1)
    windows[:, 0], windows[7, 1] = 0, 1
    chance = net.chances(words, windows)
    assert (chance[7] > 0.5) and np.allclose(np.delete(chance, 7), net.chances(words, windows[:1])[0], atol=1e-6)


def test_training_ignores_held_out_and_missing_labels(spark):
    docs = frame(spark, [(i, f"w{i} text") for i in range(40)])
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0]
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, label([(i, 1, i % 2) for i in held])) is None
    assert toxicity.train(docs, label([(None, 1, 1), (1, 1, None), (999, 1, 1)])) is None
    assert toxicity.train(docs, label([(i, 1, 0) for i in range(40)])) is None
    assert toxicity.train(docs, label([]).limit(0)) is None and toxicity.train(docs.limit(0), label([(1, 1, 1)])) is None
    rows = toxicity.score(docs, None).collect()
    assert {r["doc_id"] for r in rows if r["held_out"]} == set(held) and {r["score"] for r in rows} == {0.0}
    assert toxicity.score(docs.limit(0), None).count() == 0
    a = toxicity.train(docs, label([(i, 1, i % 2) for i in range(40)] * 2))
    assert a == toxicity.train(docs.repartition(5), label([(i, 1, i % 2) for i in range(40)]))


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(F.broadcast(labels.select("doc_id")), "doc_id", "left_semi")
    network = toxicity.train(docs, labels)
    rows = toxicity.score(docs, network).filter("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    right = sum(r["toxic"] == r["predicted"] for r in rows) / len(rows)
    found = sum(r["predicted"] for r in rows if r["toxic"]) / sum(r["toxic"] for r in rows)
    wrong = sum(r["predicted"] for r in rows if not r["toxic"]) / sum(not r["toxic"] for r in rows)
    print(right, found, wrong)
    assert right > 0.96 and found > 0.7 and wrong < 0.015
