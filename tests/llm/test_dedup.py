"""Dedup operators against brute force: edge cases first, then texts with planted repeats."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyspark.llm import exact_dedup, near_dedup, substring_dedup, suffix_dedup, windows

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "doc_id long, text string, lang string, source string, m int, start int, size int, doc int"


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those inside the operators."""
    rows = [(i if ids is None else ids[i], t, "en", None, 7, 8, 9, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, EXTRA)


def planted(seed=1, n=24):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["é", "Ü", "x" * 30]
    passage = [r.choice(words) for _ in range(60)]
    out = [" ".join(r.choice(words) for _ in range(r.randrange(1, 160))) for _ in range(n)]
    for i in (2, 5, 9, 13):
        out[i] += " " + " ".join(passage[: 40 + i]) + f" tail {i}"
    out[6] = out[3]
    out[7] = "ab " * 300
    out[8] = "a" * 5000
    return [*out, None, "", " \n\t", "one", out[3], " ".join(passage)]


def brute_bytes(rows, length):
    """(n, removed, spans, sha) by (doc_id, text) in order of doc_id."""
    seen, out = {}, {}
    for key, text in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen.setdefault(b[i : i + length], (key, i)) != (key, i):
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[key] = (len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("part", [windows.PART_TOKENS, 400, 1])
def test_suffix_dedup(spark, part):
    texts = planted()
    spec = windows.Spec(length=40, gram=12, words=False)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(frame(spark, texts), spec, part_tokens=part).collect()}
    assert got == brute_bytes(list(enumerate(texts)), 40)


@pytest.mark.parametrize("part", [windows.PART_TOKENS, 400, 1])
def test_substring_dedup(spark, part):
    texts = planted(2)
    spec = windows.Spec(length=12, gram=4, words=True)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(frame(spark, texts), spec, part_tokens=part).collect()}
    assert got == brute_words(texts, 12)


def test_window_dedup_as_registered(spark):
    """100 bytes and 35 words; passages that many texts share, at different places."""
    r = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    passages = [[r.choice(words) for _ in range(n)] for n in (34, 35, 36, 60, 200)]
    texts = []
    for i in range(60):
        parts = [[r.choice(words) for _ in range(r.randrange(5, 90))] for _ in range(3)]
        for p in r.sample(passages, 2):
            parts.insert(r.randrange(4), p)
        texts.append(" ".join(w for p in parts for w in p))
    texts += [texts[0], texts[1][7:], "é" * 49 + "xy", "é" * 50, "é" * 51, None, ""]
    rows = list(enumerate(texts))
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.suffix_dedup(frame(spark, texts)).collect()}
    assert got == brute_bytes(rows, 100)
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring_dedup.substring_dedup(frame(spark, texts)).collect()}
    assert got == brute_words(texts, 35)


def test_rows_equal_in_doc_id_and_text(spark):
    r = random.Random(22)
    text = " ".join(f"w{r.randrange(500)}" for _ in range(80))
    rows = frame(spark, [text, text, text, text + " tail", "short", "short"], [None, None, None, 5, None, None])
    got = sorted((x["doc_id"] or 0, x["n_bytes"] - x["n_removed"]) for x in suffix_dedup.suffix_dedup(rows).collect())
    assert got == [(0, 0), (0, 0), (0, 5), (0, 5), (0, len(text)), (5, 5)]
    got = sorted((x["doc_id"] or 0, x["n_words"] - x["n_removed"]) for x in substring_dedup.substring_dedup(rows).collect())
    assert got == [(0, 0), (0, 0), (0, 0), (0, 1), (0, 1), (5, 1)]


@pytest.mark.parametrize("part", [windows.PART_TOKENS, 1])
def test_no_copy_follows_what_the_index_does_not_find(spark, part):
    none = np.zeros(0, np.int64)
    deny = lambda bodies, held: (none, none, none, np.zeros(held.n.size, bool))
    spec = windows.Spec(length=40, gram=12, words=False)
    assert windows.found_places(windows.Texts(frame(spark, planted())), spec, deny, part).count() == 0


@pytest.mark.parametrize("find", [suffix_dedup.later_windows, substring_dedup.shared_windows])
def test_equal_digests_of_different_tokens_are_refused(find):
    """A shard whose held segments claim five copies each: the first has a real one, the second only a forged one."""
    r = np.random.default_rng(4)
    real, other, forged = (r.integers(1, 200, 30).astype(np.uint64) for _ in range(3))
    bodies = [np.concatenate([real, other]), real, forged]
    held = windows.Held(np.array([0, 0, 1, 2]), np.array([0, 30, 0, 0]), np.array([21, 21, 21, 21]), np.array([5, 5, 0, 0]))
    row, offset, n, sure = find(bodies if find is substring_dedup.shared_windows else [b.astype(np.uint8) for b in bodies], held, 10)
    assert sure.tolist()[:2] == [True, False]
    found = {(a, b + i) for a, b, k in zip(row.tolist(), offset.tolist(), n.tolist(), strict=True) for i in range(k)}
    late, early = {(1, i) for i in range(21)}, {(0, i) for i in range(21)}
    assert found == (late if find is suffix_dedup.later_windows else late | early)


def test_rows_of_common_keys_are_joined_in_place(spark, monkeypatch):
    monkeypatch.setattr(windows, "HEAVY", 4)
    many = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(90)], "m long, x long")
    few = many.groupBy("m").count().withColumnRenamed("count", "c").filter("m % 2 = 0")
    got = windows.joined_by_count(many, few, ["m"])
    assert sorted(map(tuple, got.select("m", "x", "c").collect())) == sorted(map(tuple, many.join(few, "m").select("m", "x", "c").collect()))
    monkeypatch.setattr(windows, "HEAVY", 1)
    assert windows.joined_by_count(many, few, ["m"]).count() == got.count()


def test_words_that_a_polynomial_takes_as_equal(spark):
    """Thue-Morse words over two letters, and runs of such words."""
    morse = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join("ab"[x ^ flip] for x in morse) for flip in (0, 1))
    got = near_dedup.near_dedup(frame(spark, [one, other])).collect()
    assert sorted((x["doc_id"], x["component_id"]) for x in got) == [(0, 0), (1, 1)]
    tail = " ".join(f"t{i}" for i in range(40))
    got = substring_dedup.substring_dedup(frame(spark, [f"{one} {tail}", f"{other} {tail}"])).collect()
    assert [x["n_removed"] for x in got] == [40, 40]
    long, rest = (" ".join(f"w{x ^ flip}" for x in morse) for flip in (0, 1))
    want = brute_words([long, rest], 35)
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substring_dedup.substring_dedup(frame(spark, [long, rest])).collect()} == want


def brute_words(texts, length):
    """(n, removed, sha) of each text."""
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    want = {}
    for d, w in enumerate(words):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        want[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return want


def test_window_dedup_edges(spark):
    empty = frame(spark, []).limit(0)
    assert suffix_dedup.suffix_dedup(empty).count() == substring_dedup.substring_dedup(empty).count() == 0
    long = " ".join(f"v{i % 977}" for i in range(300_000))
    rows = frame(spark, [long, "x " * 80, "x " * 80, "x " * 80], [3, None, 2, 2])
    got = suffix_dedup.suffix_dedup(rows, texts=False).collect()
    period = len(" ".join(f"v{i}" for i in range(977))) + 1  # what stands there for the first time
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in got) == [(-1, 160, 158), (2, 160, 160), (2, 160, 160), (3, len(long), len(long) - period)]


def test_exact_dedup(spark):
    texts = ["a", "b", "a", None, "", "a ", "b", "a", "c"]
    ids = [5, 9, 7, 1, 2, 3, 9, None, 4]
    got = sorted(((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(frame(spark, texts, ids)).collect()))
    assert got == [(-1, 7, 3, False), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 4, 1, True), (5, 7, 3, False), (7, 7, 3, True), (9, 9, 2, False), (9, 9, 2, True)]
    kept = sorted(r["doc_id"] for r in exact_dedup.drop_copies(frame(spark, texts, ids)).collect())
    assert kept == [2, 3, 4, 7, 9]
    assert exact_dedup.exact_dedup(frame(spark, []).limit(0)).count() == exact_dedup.drop_copies(frame(spark, []).limit(0)).count() == 0


def test_exact_dedup_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PART_ROWS", 7)
    rows = frame(spark, [""] * 50 + ["x"] * 14 + [None], [None] * 50 + [3] * 14 + [None])
    got = exact_dedup.exact_dedup(rows).collect()
    assert Counter((x["doc_id"], x["keep_id"], x["group_size"], x["kept"]) for x in got) == {(None, None, 51, False): 50, (None, None, 51, True): 1, (3, 3, 14, False): 13, (3, 3, 14, True): 1}


def test_digests_that_agree_in_64_bits(spark):
    digests = [bytes(8) + b"k" * 8 + bytes([i]) * 16 for i in range(6)]
    table = spark.createDataFrame([(d, i, 1) for i, d in enumerate(digests[:4])], "digest binary, winner long, n long")
    asked = spark.createDataFrame([(d, 10 + i, 2) for i, d in enumerate(digests)], "digest binary, winner long, n long")
    got = exact_dedup.look_up(exact_dedup.build_index(table, 1), asked, 1).collect()
    assert sorted((x["digest"][-1], x["winner"], x["n"], x["historical"]) for x in got) == [*((i, 10 + i, 3, True) for i in range(4)), (4, 14, 2, False), (5, 15, 2, False)]


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(3).integers(0, 2**64, 5000, dtype=np.uint64)
    hashed = exact_dedup.PerfectHash.build(keys)
    assert sorted(hashed.slots(keys).tolist()) == list(range(5000))
    assert exact_dedup.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]


def shingle_set(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets, parent = {d: shingle_set(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            index[x].add(d)
    for d, s in sets.items():
        for e in {e for x in s for e in index[x] if e < d}:
            both = len(s & sets[e])
            if 100 * both >= 75 * (len(s) + len(sets[e]) - both):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def test_near_dedup_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_HASHES", 2000)
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(2):
        base = [r.choice(words) for _ in range(120)]
        for _ in range(80):
            w = list(base)
            for _ in range(int(abs(r.gauss(0, 4)))):
                w[r.randrange(120)] = r.choice(words)
            texts.append(" ".join(w))
    r.shuffle(texts)
    texts += ["Short One", "short  one", "short two", "A b c d e", "a B c d e\n", None, "", " ", texts[0].upper()]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_dedup.near_dedup(frame(spark, texts)).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_near_dedup_edges(spark):
    assert near_dedup.near_dedup(frame(spark, []).limit(0)).count() == near_dedup.drop_near_copies(frame(spark, []).limit(0)).count() == 0
    rows = frame(spark, ["same words in this text here", "same words in this text here", "other", None], [None, 4, 4, 8])
    got = sorted(((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in near_dedup.near_dedup(rows).collect()))
    assert got == [(-1, 4, False), (4, 4, True), (4, 4, True), (8, 8, True)]
    assert {"m", "size"} <= set(near_dedup.drop_near_copies(rows).columns)


@pytest.mark.parametrize("kind", ["missing", "repeated", "mixed"])
def test_near_dedup_of_rows_without_an_id_of_their_own(spark, kind):
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for size in (1, 2, 2, 3, 6):  # groups of near copies; pairs are two-member buckets
        base = [r.choice(words) for _ in range(80)]
        for k in range(size):
            texts.append(" ".join([*base[:79], f"end{k}"]))
    texts += [texts[0], texts[1], texts[1].upper(), None, None, "", " \n"]
    r.shuffle(texts)
    ids = {"missing": [None] * len(texts), "repeated": [5 + i % 2 for i in range(len(texts))], "mixed": [None if i % 3 == 0 else i % 4 for i in range(len(texts))]}[kind]
    root = {i: c for i, (_, c, _) in brute_components(list(enumerate(texts))).items()}
    rank = lambda x: (x is None, x or 0)
    least = {c: min((ids[i] for i in root if root[i] == c), key=rank) for c in set(root.values())}
    rows = frame(spark, texts, ids)
    got = near_dedup.near_dedup(rows).collect()
    want = Counter((ids[i], len(shingle_set(t)), least[root[i]], ids[i] == least[root[i]]) for i, t in enumerate(texts))
    assert Counter((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in got) == want
    stay = near_dedup.drop_near_copies(rows).collect()
    assert Counter(x["doc_id"] for x in stay) == Counter(least.values())
    group = {(ids[i], t): root[i] for i, t in enumerate(texts) if shingle_set(t)}
    chosen = [group[x["doc_id"], x["text"]] for x in stay if shingle_set(x["text"])]
    assert sorted(chosen) == sorted(set(group.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 75), (7, 7)]
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 75: 50, 100: 50}
