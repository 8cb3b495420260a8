"""Mixing, sharding, licences, tokens, neighbours, quality and the pipeline."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

import corpus_pipeline
from tallyspark.llm import byte_bpe, graph_index, license_texts, licenses, mixing, neighbours, quality, sharding
from tallyspark.operators.grain import plan_text
from test_dedup import brute_components

DDL = "doc_id long, text string, lang string, source string, size int, rank int, key string"


def frame(spark, texts, sources=None, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", None if sources is None else sources[i], 1, 2, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DDL)


def test_mix_targets_and_copies(spark):
    r = random.Random(5)
    sources = [r.choice(["a", "b", "c", "Z", None]) for _ in range(600)]
    texts = [None if i == 3 else " ".join(["w"] * r.randrange(0, 60)) for i in range(600)]
    rows = mixing.mix(frame(spark, texts, sources)).collect()
    total = sum(x["size"] for x in rows)
    target = {x["source"]: (x["target"], x["source_size"]) for x in rows}
    assert sum(t for t, _ in target.values()) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-6 and 0 <= x["copies"] <= 3 for x in rows for t, s in [target[x["source"]]])
    taken = defaultdict(int)
    for x in rows:
        taken[x["source"]] += x["copies"] * x["size"]
    assert all(abs(taken[s] - t) < 0.1 * t + 60 for s, (t, _) in target.items())
    again = mixing.mix(frame(spark, texts, sources).repartition(3)).collect()
    assert {x["doc_id"]: x["copies"] for x in rows} == {x["doc_id"]: x["copies"] for x in again}
    out = mixing.emit(frame(spark, texts, sources))
    assert out.columns == frame(spark, ["x"]).columns and out.count() == sum(x["copies"] for x in rows)
    assert out.select("rank").distinct().collect()[0][0] == 2
    assert mixing.mix(frame(spark, ["a"]).limit(0)).count() == 0


def test_mix_caps_are_shared_again(spark):
    sizes = spark.createDataFrame([(False, "a", 10), (False, "b", 1000), (False, "c", 1000)], "no_source boolean, key string, source_size long")
    got = {r["key"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got["b"] == pytest.approx(1980 * 2 / 3) and got["c"] == pytest.approx(1980 / 3)


def needed(sizes, capacity):
    n, i = 0, 0
    while i < len(sizes):
        total, i = sizes[i], i + 1
        if total <= capacity:
            while i < len(sizes) and total + sizes[i] <= capacity:
                total, i = total + sizes[i], i + 1
        n += 1
    return n


@pytest.mark.parametrize("seed", range(4))
def test_shards_are_minimax(spark, seed):
    r = random.Random(seed)
    texts = ["".join(r.choice("abcé") for _ in range(r.randrange(0, 90))) for _ in range(300)] + ["big" * (4000 if seed % 2 else 5)] * 30 + [None, ""]
    rows = sharding.shard(frame(spark, texts)).collect()
    groups, shards, where = defaultdict(int), defaultdict(list), defaultdict(set)
    for x in rows:
        text = texts[x["doc_id"]] or ""
        assert (x["size"], x["text_crc32"], x["law"], x["grown_shard"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "bytes", None)
        groups[hashlib.sha256(text.encode()).hexdigest()] += x["size"]
        shards[x["shard"]].append(x)
        where[text].add(x["shard"])
    assert len(rows) == len(texts) and all(len(s) == 1 for s in where.values()) and set(shards) <= set(range(16))
    assert all(sorted(x["slot"] for x in s) == list(range(len(s))) for s in shards.values())
    sizes = [groups[k] for k in sorted(groups)]
    low = next(c for c in range(1, sum(sizes) + 1) if needed(sizes, c) <= 16)
    assert max(sum(x["size"] for x in s) for s in shards.values()) == max(low, max(sizes))
    assert sum(1 for s in shards.values() if sum(x["size"] for x in s) > low) <= sum(1 for g in sizes if g > low)


def test_sharding_edges(spark):
    assert sharding.shard(frame(spark, ["x"]).limit(0)).count() == 0
    assert [r["slot"] for r in sharding.shard(frame(spark, [None, None], ids=[None, None])).orderBy("slot").collect()] == [0, 1]


def test_licenses(spark):
    texts = ["Released under the MIT License. under the mit license", "Apache License, Version 2.0; CC-BY-NC 4.0 cc by nc", "mit license under the", None, "", "This work is licensed under the GNU General Public License, version 3.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "under the mıt license", "under the MIT licence", "x " * 50_000 + "under the mit license"]
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {r["doc_id"]: r for r in licenses.license_scan(frame(spark, texts)).collect()}
    for d, text in enumerate(texts):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(upper))
        starts = [(i, t.label) for t in licenses.BASE for i in range(len(words)) if tuple(words[i : i + len(t.words)]) == t.words]
        r = got[d]
        assert (r["n_words"], r["n_base"]) == (len(words), len(starts))
        assert (r["first_word"], r["last_word"]) == ((min(starts)[0], max(starts)[0]) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in starts})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1
    assert (got[5]["labels"], got[6]["labels"], got[2]["labels"], got[4]["score"]) == ("gpl", "mit", "", 0)
    assert licenses.license_scan(frame(spark, ["x"]).limit(0)).count() == 0


UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_licenses(texts, templates):
    """(labels, score) of each text: every start of every template is tried."""
    files = [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(UPPER)) for t in texts]
    idf = {w: math.log((len(files) + 1) / (sum(w in set(f) for f in files) + 1)) + 1 for t in templates for w in t.words}
    out = []
    for words in files:
        labels, best = set(), 0.0
        for t in templates:
            rare = sorted(set(t.words), key=lambda w: (-idf[w], w))[: 1 if t.base else licenses.RARE_WORDS]
            spots = [k for k, w in enumerate(t.words) if w in rare]
            total = sum(idf[w] for w in t.words)
            for i in range(len(words)):
                here = words[i : i + len(t.words)]
                same = [k < len(here) and here[k] == w for k, w in enumerate(t.words)]
                score = sum(idf[w] for w, ok in zip(t.words, same, strict=True) if ok) / total
                if all(ok for ok, must in zip(same, t.key, strict=True) if must) and sum(same[k] for k in spots) >= min(2, len(spots)) and score >= licenses.LEAST_SCORE:
                    labels.add(t.label)
                    best = max(best, score)
        out.append((",".join(sorted(labels)), min(1.0, best)))
    return out


def test_license_templates(spark):
    r = random.Random(8)
    texts = [None, "", "plain words only"]
    for _, text in license_texts.TEXTS:
        words = text.replace("[", "").replace("]", "").split()
        texts.append(" ".join(words))
        for share in (0.03, 0.1, 0.3):
            texts.append("some code\n# " + " ".join("xyz" if r.random() < share else w for w in words) + "\nmore code")
        texts.append(" ".join(words[2:]))  # its start lies before the text
        texts.append(" ".join(words[:-3] + words))
    got = {x["doc_id"]: x for x in licenses.license_scan(frame(spark, texts)).collect()}
    for d, (labels, score) in enumerate(brute_licenses(texts, [*licenses.BASE, *licenses.OWN])):
        assert got[d]["labels"] == labels and got[d]["score"] == pytest.approx(score), texts[d]
    assert len({x["labels"] for x in got.values()}) > 10


def test_license_scan_of_one_long_text(spark):
    began = time.monotonic()
    row = licenses.license_scan(frame(spark, ["cc by nc " * 60_000])).collect()[0]
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["labels"]) == (180_000, 60_000, 0, 179_997, "cc-by-nc")
    assert time.monotonic() - began < 60  # linear: seconds, where all pairs of places would take hours


def test_tokens_round_trip(spark):
    path, pattern = byte_bpe.public_ranks()
    with open(path, "rb") as f:
        whole = byte_bpe.encoding(f.read(), pattern)
    long = "".join(random.Random(1).choice(["word ", "Über ", "\n\n", "  x", "12", "'ll ", "日本 "]) for _ in range(30_000))
    texts = ["Hello  world\n", None, "", "<|endoftext|>", "a" * 70_000, long, "   x", "🙂 é"]
    got = {r["doc_id"]: r for r in byte_bpe.encode_decode(frame(spark, texts), path, pattern).collect()}
    for d, text in enumerate(texts):
        ids = whole.encode_ordinary(text or "")
        assert list(got[d]["ids"]) == ids and got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert byte_bpe.encode_decode(frame(spark, ["x"]).limit(0), path, pattern).count() == 0
    assert len(byte_bpe.safe_pieces(long)) > 1 and "".join(byte_bpe.safe_pieces(long)) == long


def merged_by_rank(piece, ranks):
    """Byte-pair merges in plain Python: the pair of least rank first, the leftmost of equal ones."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], math.inf), i) for i in range(len(parts) - 1))
        if rank == math.inf:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[x] for x in parts]


def test_white_space_runs_against_pattern_and_merges():
    path, pattern = byte_bpe.public_ranks()
    with open(path, "rb") as f:
        bpe = byte_bpe.encoding(f.read(), pattern)
    ranks, r = bpe._mergeable_ranks, random.Random(9)
    for i in range(60):
        runs = ["".join(r.choices(" \t\n\u3000\x85\x1c", [8, 2, 2, 1, 1, i % 2], k=r.choice([1, 3, 1023, 1024, 1100]))) for _ in range(2)]
        text = r.choice(["", "hi", "'s", "é", "1"]) + runs[0] + r.choice(["", "x", "!", "2", "'ll"]) + runs[1] + r.choice(["", "y", "語"])
        want = [t for piece in regex.findall(pattern, text, regex.V1) for t in merged_by_rank(piece.encode(), ranks)]
        assert byte_bpe.encode(bpe, text).tolist() == want == bpe.encode_ordinary(text)


@pytest.mark.parametrize("space", [" ", "\n", "\t", "\t \n"])
def test_ten_megabytes_of_white_space(spark, space):
    path, pattern = byte_bpe.public_ranks()
    with open(path, "rb") as f:
        bpe = byte_bpe.encoding(f.read(), pattern)
    run = space * (10_000_000 // len(space))
    one = bpe._encode_single_piece
    head, last = one(run[:-1]), bpe.encode_ordinary(run[-1] + "x")  # the pattern's rule: all but the last before another character
    texts = {run: one(run), run + "x": [*head, *last], "hi" + run: [*one("hi"), *one(run)], "hi" + run + "x" + run: [*one("hi"), *head, *last, *one(run)]}
    got = {r["doc_id"]: r for r in byte_bpe.encode_decode(frame(spark, list(texts)), path, pattern, ids=False).collect()}
    for d, (text, ids) in enumerate(texts.items()):
        assert got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(900, 16)).astype(np.float32)
    vectors[100:400] = vectors[100]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [None] * 16), (None, [1.0] * 16), (7, vectors[7].tolist()), (1200, [1.0, 2.0])]
    rows = [(*x, 0, "v", [1], 3, 4, 5) for x in rows]
    got = defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string, ids array<int>, shard int, dim int, rank int")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    x = vectors.astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    assert set(got) == set(range(0, 900, 50))
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and q not in [f[1] for f in found]
        score = np.round(unit @ unit[q], 12)
        best = [i for i in np.lexsort((np.arange(900), -score)).tolist() if i != q][:5]
        hits += len(set(best) & {f[1] for f in found})
        assert all(abs(f[2] - score[f[1]]) < 1e-9 for f in found)
    assert hits >= 0.9 * 5 * len(got)
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_VECTORS", 200)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(2500, 24))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in neighbours.nearest(rows).collect():
        got[r["query_id"]].add(r["vec_id"])
    best = {q: {i for i in np.argsort(-(unit @ unit[q]))[:6].tolist() if i != q} for q in range(0, 2500, 50)}
    assert np.mean([len(got[q] & best[q]) / 5 for q in best]) >= 0.95


def test_query_blocks_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_VECTORS", 50)
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))] + [(1000, [1.0, 2.0]), (1001, [2.0, 1.0])]  # a dimension that few shards have
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert "Join" not in plan_text(found) and "Broadcast" not in plan_text(found)
    ranks = defaultdict(list)
    for r in found.collect():
        ranks[r["query_id"]].append((r["rank"], r["vec_id"]))
    assert sorted(ranks.pop(1000)) == [(1, 1001)]
    assert {q: len(x) for q, x in ranks.items()} == {q: 5 for q in range(0, 300, 50)}


def test_graph_recall():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(3000, 64))
    points = (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32)
    graph, entry = graph_index.build(points)
    ids, _ = graph_index.beam_search(points, graph, entry, points[:100], neighbours.SEARCH_BEAM)
    exact = np.argsort(-(points[:100] @ points.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b[:6])) / 6 for a, b in zip(exact.tolist(), ids.tolist(), strict=True)]) >= 0.9


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.op1_quality(spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    right = sum(got[r["doc_id"]]["kept"] == bool(r["quality"]) for r in labels)
    lost = sum(not got[r["doc_id"]]["kept"] for r in labels if r["quality"])
    assert right >= 0.97 * len(labels) and lost <= 0.01 * len(labels)


def test_quality_edges(spark):
    assert quality.rate(frame(spark, ["x"]).limit(0)).count() == 0
    kept = quality.keep_good(frame(spark, [None, "", "Plain words in a plain line.", "#" * 300], ids=[None, 1, 2, 3]))
    assert kept.columns == frame(spark, ["x"]).columns and "#" * 300 not in [r["text"] for r in kept.collect()]
    assert quality.keep_good(frame(spark, ["x"]).limit(0)).count() == 0
    many = frame(spark, [f"line {i}" for i in range(50)], ids=[None] * 50)
    assert 0 < quality.rate(many, sample=10).count() == 50  # rows without a doc_id are told apart by their text


def slow_score(text, stats, weights):
    """The scorer written out: shares of hashed 4-byte strings and one slot for each statistic's step."""
    b, size = text.encode(), 1 << quality.BITS
    grams = [int.from_bytes(b[i : i + 4], "big") for i in range(len(b) - 3)]
    total = weights[-1]
    for g in grams:
        total += weights[((g * 2654435761) % 2**32) >> (32 - quality.BITS)] * 4.0 / len(grams)
    for k, x in enumerate(stats):
        step = 99 if math.isnan(x) else min(60, int(x * 10)) + 100 * int(x >= quality.LABELLERS[k][1])
        z = k * 1000 + step
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = ((z ^ (z >> shift)) * factor) % 2**64
        total += 0.5 * weights[(z ^ (z >> 31)) % size]
    return 1 / (1 + math.exp(-total))


def slow_posteriors(patterns):
    """Expectation-maximisation document by document."""
    votes = [[p >> k & 1 for k in range(quality.N_VOTES)] for p in patterns]
    post = [0.1 if any(v[:-1]) else 0.9 if v[-1] else 0.6 for v in votes]
    strength = quality.PRIOR * len(votes) + 1
    for _ in range(200):
        odds = [1.0] * len(votes)
        share = min(max(sum(post) / len(post), 1e-3), 1 - 1e-3)
        for good, mass in ((True, post), (False, [1 - p for p in post])):
            chance = []
            for k in range(quality.N_VOTES):
                guess = 0.5 if (k == quality.N_VOTES - 1) == good else 0.02
                chance.append((sum(m for m, v in zip(mass, votes, strict=True) if v[k]) + strength * guess) / (sum(mass) + strength))
            for i, v in enumerate(votes):
                p = math.prod([share if good else 1 - share, *(c if x else 1 - c for c, x in zip(chance, v, strict=True))])
                odds[i] = p if good else odds[i] / (odds[i] + p)
        post = odds
    return post


def test_quality_against_plain_python(spark):
    r = random.Random(4)
    words = ["the", "light", "of", "Morning", "river", "walks", "quietly", "and", "stone", "über"]
    good = [" ".join(r.choice(words) for _ in range(60)) + "." for _ in range(120)]
    bad = ["#$% " * r.randrange(10, 40) + "BUY NOW!!! " * r.randrange(3, 9) for _ in range(60)]
    texts = [*good, *bad, "", "x"]
    rows = frame(spark, texts)
    stats = [quality.statistics(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    post = slow_posteriors([quality.pattern(quality.votes(s)) for s in stats])
    weights = quality.train(rows, quality.posteriors(rows))
    got = {x["doc_id"]: x for x in quality.rate(rows).collect()}
    for i, text in enumerate(texts):
        assert got[i]["posterior"] == pytest.approx(post[i], abs=1e-6)
        assert got[i]["score"] == pytest.approx(slow_score(text, stats[i], weights), abs=1e-9)
    held_out = [" ".join(r.choice(words) for _ in range(50)) for _ in range(30)] + ["%&* " * 30 + "WIN!!! " * 5 for _ in range(30)]
    scores = [slow_score(t, quality.statistics(np.frombuffer(t.encode(), np.uint8)), weights) for t in held_out]
    assert min(scores[:30]) > 0.5 > max(scores[30:])


def test_sameness_covers_every_word():
    at = [x[0] for x in quality.LABELLERS].index("sameness")
    seen = lambda words: quality.statistics(np.frombuffer(" ".join(words).encode(), np.uint8))[at]
    varied, same = [f"w{i}" for i in range(18_000)], ["same"] * 18_000
    bad = quality.LABELLERS[at][1]
    assert seen(varied[:2000] + same) >= bad  # varied start, repeated words after it
    assert seen(same[:2000] + varied) < quality.LABELLERS[at][2]  # a list first, varied words after it
    assert seen(varied[:2000] + same) == pytest.approx(seen(same + varied[:2000]))
    assert seen(varied[:2000] + same[:1]) == pytest.approx(0) and seen(varied[:2000] + same[:300]) > 0.05  # the last words count
    for n in (40, 1999, 2000, 2001, 3999, 4000, 4001, 19_999, 20_000):
        words = np.arange(n, dtype=np.uint64)
        assert quality.sameness(words) == 0
        for place in {0, n // 2, n - 2}:
            twice = words.copy()
            twice[place + 1] = twice[place]
            assert quality.sameness(twice) > 0 or n > quality.WINDOW  # a pair may be cut by a window's edge
        assert quality.sameness(words // np.uint64(10)) == pytest.approx(0.9, abs=0.02)


def test_em_finds_who_is_right():
    clean, junk, odd = 1 << 7, 0b1000001, 0b0000100
    post = quality.expectation_maximisation({clean: 900, junk: 60, odd: 40, 0: 30})
    assert post[clean] > 0.9 and post[junk] < 0.1 and post[odd] < 0.5


def slow_mix(rows):
    """Copies of each (doc_id, source, words) row: systematic sampling one source at a time."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    size = {s: sum(n for _, t, n in rows if t == s) for s in sources}
    target, open_ = {}, list(sources)
    while open_:
        left = sum(size.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * size[s]]
        target |= {s: 3 * size[s] for s in full} if full else share
        open_ = [s for s in open_ if s not in target]
    number = lambda *parts: int(hashlib.md5("|".join(parts).encode()).hexdigest()[:15], 16)
    copies = {}
    for s in sources:
        each = target[s] / size[s] if size[s] else 0
        whole, part = int(each), int((each % 1) * 2**28)
        place = number(mixing.SEED, "offset", str(s is None).lower(), s or "") >> 32
        steps = lambda n: n if n < 8 else n.bit_length() * 8 + (n >> (n.bit_length() - 4) & 7)
        for d, _, _ in sorted((x for x in rows if x[1] == s), key=lambda x: (steps(x[2]), number(mixing.SEED, str(x[0])))):
            copies[d] = whole + ((place + part) >> 28) - (place >> 28)
            place += part
    return copies


def test_mix_against_plain_python(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["a", "b", "c", "dé", None]), r.randrange(0, 50)) for i in range(500)]
    got = mixing.mix(frame(spark, [" ".join(["w"] * n) for _, _, n in rows], [s for _, s, _ in rows])).collect()
    want = slow_mix(rows)
    assert {x["doc_id"]: x["copies"] for x in got} == want
    assert {(x["rank"], x["key"]) for x in got} == {(2, "k")}  # columns of the caller


def test_pipeline_end_to_end(spark, tmp_path):
    r = random.Random(9)
    words = ["the", "light", "of", "morning", "river", "walks", "quietly", "and", "stone", "bridge", "hollow", "seven"]
    base = [[r.choice(words) + str(r.randrange(40)) for _ in range(60)] for _ in range(30)]
    texts = [" ".join(b) for b in base]
    texts += [" ".join([*b[:59], "end"]) for b in base[:10]] + texts[5:15] + ["#$% !!! " * 50] * 3 + [None, "", "one", "long " + "text and more of it " * 4000]
    rows = [(i, t, "en", r.choice(["a", "b", None]), len(t or ""), 1, 2, "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, rank int, size int, id string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    good = {x["doc_id"] for x in corpus_pipeline.STAGES[0][1](spark, docs, "").collect()}
    assert all(i in good for i in range(30)) and all(x[0] not in good for x in rows if "#" in (x[1] or ""))
    once = {}
    for d, t, *_ in rows:
        if d in good:
            once[t or ""] = d
    component = brute_components([(d, t) for t, d in once.items()])
    left = [x for x in rows if component.get(x[0], (0, 0, False))[2]]
    want = Counter()
    for d, n in slow_mix([(x[0], x[3], len((x[1] or "").split())) for x in left]).items():
        want[d] = n
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(x["doc_id"] for x in out) == +want
    assert all(x["decoded_sha256"] == hashlib.sha256((texts[x["doc_id"]] or "").encode()).hexdigest() for x in out)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), "")
        assert empty.count() == 0 and (name == "byte_bpe" or empty.columns == docs.columns)


def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    good = stages[names[0]](spark, docs, "")
    kept = [r["doc_id"] for r in quality.rate(docs).filter("kept").collect()]
    assert good.columns == columns and sorted(r["doc_id"] for r in good.collect()) == sorted(kept) and 0 < len(kept) < docs.count()
    once = stages[names[1]](spark, docs, "").collect()
    assert len({r["text"] for r in once}) == len(once) == docs.select("text").distinct().count()
    mixed = stages[names[3]](spark, docs, "")
    assert mixed.columns == columns and mixed.distinct().exceptAll(docs.distinct()).count() == 0
    last = stages[names[4]](spark, docs, "").collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest() for r in last)
