"""Token alignment against plain Python over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tokenizers

from tallyspark.llm import alignment, common

DDL = "doc_id long, text string, slice long, pair long, n long, row int, held int, groups string"
PATHS = [public_tokenizers.path(alignment.A_FILE), public_tokenizers.path(alignment.B_FILE)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, "g") for i, t in rows], DDL)


@pytest.fixture(scope="module")
def plain():
    """(A ids and bytes, B ids and bytes) of a whole text, by the libraries alone."""
    a = tokenizers.Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    byte_of = {}
    extra = 0
    for i in range(256):
        shown = 33 <= i <= 126 or 161 <= i <= 172 or 174 <= i <= 255
        byte_of[chr(i if shown else 256 + extra)] = i
        extra += not shown

    def run(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        raw_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b))]
        return (ids_a, raw_a), (ids_b, raw_b)

    return run


def brute(rows, plain):
    docs, held = [], defaultdict(set)
    for k, (doc, text) in enumerate(rows):
        groups = []
        if text:
            (ids_a, raw_a), (ids_b, raw_b) = plain(text)
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                i = j = at_a = at_b = 0
                now = ([], [])
                while i < len(ids_a) or j < len(ids_b):
                    if at_a <= at_b:
                        now[0].append(ids_a[i])
                        at_a, i = at_a + len(raw_a[i]), i + 1
                    else:
                        now[1].append(ids_b[j])
                        at_b, j = at_b + len(raw_b[j]), j + 1
                    if at_a == at_b:
                        groups.append(now)
                        now = ([], [])
        links = Counter()
        for x, y in groups:
            links.update((p, q) for p in x for q in y)
        for pair in links:
            held[pair].add(k)
        docs.append((doc, groups, links))
    top = defaultdict(int)
    for (p, _), where in held.items():
        top[p] = max(top[p], len(where))
    out = []
    for doc, groups, links in docs:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        best = sum(n for pair, n in links.items() if len(held[pair]) == top[pair[0]])
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), best, sum(n * len(held[pair]) for pair, n in links.items()), sha, text))
    return Counter(out)


def result(df):
    return Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")) for r in df.collect())


@pytest.mark.parametrize("slice_bytes", [300, 16 << 20])
def test_alignment_against_whole_texts(spark, plain, monkeypatch, slice_bytes):
    monkeypatch.setattr(alignment, "SLICE_BYTES", slice_bytes)
    r = random.Random(4)
    parts = ["Über", " the", "  two", " ", "\n", "\t", "日本語", "don't", "12,5", "<|endoftext|>", "<s>", "<0x41>", "é", "🙂", " x.", "!", " ", "　", "\x00", "\x1c", "ßtraße", " idiot", " "]
    texts = [None, "", " ", "  ", "a ", " a", "\n", "x▁y", "▁", "a  b", "a \n b "]
    texts += ["".join(r.choice(parts) for _ in range(r.randrange(1, 40))) for _ in range(150)]
    texts += [texts[20]] * 4 + ["word " * 400]
    rows = [(r.choice([None, i, i, 7]), t) for i, t in enumerate(texts)]
    got = result(alignment.align(frame(spark, rows).repartition(3), *PATHS))
    assert got == brute(rows, plain)


def test_alignment_of_given_documents(spark, plain):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(x["doc_id"], x["text"]) for x in df.select("doc_id", "text").collect()]
    assert result(alignment.align(df, *PATHS)) == brute(rows, plain)


def test_alignment_of_long_texts(spark, plain):
    r = random.Random(2)
    texts = [" " * 2_000_000, "\n" * 1_000_000 + "x", "".join(r.choice("abcdefgh") for _ in range(300_000)), "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(100_000)), "short"]
    got = {x["doc_id"]: x for x in alignment.align(frame(spark, list(enumerate(texts))), *PATHS, groups=False).collect()}
    for i, text in enumerate(texts):
        (ids_a, raw_a), (ids_b, raw_b) = plain(text)
        ends = lambda raw: set(__import__("itertools").accumulate(map(len, raw)))
        assert (got[i]["n_a"], got[i]["n_b"], got[i]["n_groups"]) == (len(ids_a), len(ids_b), len(ends(raw_a) & ends(raw_b)))
        assert got[i]["n_links"] >= got[i]["n_groups"] and got[i]["groups"] is None


def test_ranks_give_what_the_file_gives():
    with open(PATHS[0], encoding="utf-8") as file:
        spec = file.read()
    made, model = alignment.tokenizer_a(spec), tokenizers.Tokenizer.from_str(spec)
    model.encode_special_tokens = True
    r = random.Random(1)
    chars = [chr(c) for c in range(0x250)]
    chunks = [" x" + c + "y" + c + c + " " for c in chars] + ["".join(r.choices(chars, k=30)) for _ in range(3000)] + ["".join(r.choices("abcde 's'll1!\n\t", k=40)) for _ in range(3000)]
    chunks += [x.decode() for x in made.raw[:50256] if not any(c >= 0x80 for c in x)]
    assert made.encode.__name__ == "encode" and all(alignment.LATIN.fullmatch(x) for x in chunks)
    assert made.encode(chunks) == [x.ids for x in model.encode_batch(chunks, add_special_tokens=False)]


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    ids = [np.array(x) for x in ([9, 1, 2, 1, 3, 1], [7, 5, 5, 6, 6], [1, 4, 1], [1, 3, 1])]
    for large in (1 << 12, 4, 1):
        monkeypatch.setattr(alignment, "LARGE", large)
        pairs, times, entries = alignment.links_of(*ids, 10)
        of_group = np.split(np.stack([pairs, times], axis=1), np.cumsum(entries)[:-1])
        got = [{p: int(x[x[:, 0] == p, 1].sum()) for p in x[:, 0].tolist()} for x in of_group]
        assert got == [{97: 1}, {15: 4, 16: 2, 25: 2, 26: 1, 35: 2, 36: 1}, {16: 1}]


def test_packed_numbers():
    for values in ([], [0], [255, 1], [256], [65536], [2**32], [2**62, 0]):
        assert alignment.unpacked(alignment.packed(np.array(values, np.int64))).tolist() == values


def test_large_rows_of_slices_have_row_groups_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(common, "ROW_GROUP", 1 << 16, raising=False)
    staged, stage = {}, common.stage
    monkeypatch.setattr(common, "stage", lambda df, name, **more: staged.setdefault(name, stage(df, name, **more)))
    words = [f"{x}word{y}" for x in "abcdef" for y in "ghijklmn"]
    r = random.Random(6)
    texts = [" ".join(r.choices(words, k=1_500_000)) for _ in range(3)]  # 9 MB: each alone is a slice
    found = alignment.align(frame(spark, list(enumerate(texts))).coalesce(1), *PATHS, groups=False)
    (file,) = [x.removeprefix("file:") for x in staged["slices"].inputFiles()]
    assert pq.ParquetFile("/" + file.lstrip("/")).metadata.num_row_groups == 3
    assert sorted((x["doc_id"], x["n_groups"] >= 1_500_000, x["n_best"] > 0) for x in found.collect()) == [(i, True, True) for i in range(3)]


def test_alignment_of_no_rows(spark):
    assert alignment.align(frame(spark, []), *PATHS).count() == 0
