"""Alignment of two tokenizers over the same bytes (operator 13).

A is a byte-level BPE of the tokenizers library, B a BPE of the sentencepiece library with byte fallback. Both
read a space and the text; byte offsets where tokens of both end cut the two id lists into groups, and all A
tokens of a group are linked with all its B tokens.

1. Texts go in slices of bounded bytes. A text is cut into chunks, each a space and what follows: before a space
   that follows another character, tokens of A end since no match of its pattern goes on over such a space, and
   tokens of B end since none of its pieces holds a space behind another character (checked when it is loaded).
   So a chunk has the same tokens, groups and links wherever it stands, and each different one of a slice is encoded once.
2. The ends of both id lists of some chunks in a row go into dictionaries from end to index; the common ends, sorted, slice both
   lists into groups, and links are expanded per slice of the lists.
3. A slice is one row: its documents as lists of chunks, its chunks as lists of linked id pairs, and for each id pair how many
   of its documents hold it. Documents that hold a pair are summed over slices by a shuffle of (pair, slice) rows,
   and the sums go back to the slices that asked, so no row is made for a pair of each document.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: Bytes of texts in a slice (a longer text alone), and of chunks that are encoded at a time.
SLICE_BYTES, ENCODE_BYTES = 3 << 20, 1 << 16

#: Links of a group from which on they are counted by distinct ids.
LARGE = 1 << 12

#: A chunk starts at a space behind a character that is surely no white space, if it is not the last character.
CHUNK = re.compile(r"(?<=[!-~À-ɏ])(?= [\s\S])")

#: Short chunks of characters whose classes are the same in all versions of Unicode.
LATIN = re.compile(r"[\x00-\u024f]{1,4096}")

#: How byte-level BPE splits a text before it merges (a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


@dataclass(frozen=True)
class Tokenizer:
    """``encode`` gives the ids of chunks, each of which starts with a space; ``size`` is a bound on ids; ``raw`` has
    each id's bytes."""

    encode: Callable[[list[str]], list[list[int]]]
    raw: list[bytes]

    @property
    def size(self) -> int:
        return len(self.raw)

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(x) for x in self.raw], np.int64)


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def tokenizer_a(spec: str) -> Tokenizer:
    """The byte-level BPE of a tokenizers file. Where the order of its merges is that of its ids, chunks of Latin characters are
    encoded by rank with the tiktoken library, which is faster: a token is made by one merge only, so the pair of least rank
    is the pair of least id, and both libraries split such characters alike (tests compare them)."""
    import tiktoken
    import tokenizers

    model = tokenizers.Tokenizer.from_str(spec)
    model.encode_special_tokens = True  # their strings in a text are ordinary text
    table, raw = byte_level(), [b""] * model.get_vocab_size()
    special = {i: t.content for i, t in model.get_added_tokens_decoder().items()}
    for entry, i in model.get_vocab().items():
        raw[i] = special[i].encode() if i in special else bytes(table[c] for c in entry)
    by_file = lambda chunks: [x.ids for x in model.encode_batch_fast(chunks, add_special_tokens=False)]
    loaded = json.loads(spec)
    pairs = [x.split(" ") if isinstance(x, str) else x for x in loaded["model"]["merges"]]
    made = [model.token_to_id("".join(x)) for x in pairs]
    if made != sorted(set(made)) or (loaded.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or loaded.get("normalizer"):
        return Tokenizer(by_file, raw)
    ranked = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={x: i for i, x in enumerate(raw) if i not in special}, special_tokens={})

    def encode(chunks: list[str]) -> list[list[int]]:
        out = [ranked.encode_ordinary(x) if LATIN.fullmatch(x) else None for x in chunks]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, by_file([chunks[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    return Tokenizer(encode, raw)


@lru_cache(maxsize=4)
def tokenizer_b(model: bytes) -> Tokenizer:
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_proto=model)
    raw = []
    for i in range(made.get_piece_size()):
        piece = made.id_to_piece(i)
        if " " in piece.lstrip("▁").replace("▁", " "):
            raise ValueError(f"piece {i} holds a space behind another character: chunks would not be independent")
        known = _BYTE_PIECE.fullmatch(piece) if made.is_byte(i) else None
        raw.append(bytes([int(known[1], 16)]) if known else piece.replace("▁", " ").encode())
    return Tokenizer(lambda chunks: made.encode([x[1:] for x in chunks], num_threads=1), raw)  # it adds the space


def cuts_of(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """How many tokens of each of two id lists, over the same bytes, lie before each of their common ends, in order."""
    of_a, of_b = (dict(zip(np.cumsum(size[ids]).tolist(), range(1, ids.size + 1), strict=True)) for ids, size in ((a, a_size), (b, b_size)))
    common_ends = sorted(of_a.keys() & of_b.keys())
    return np.array([list(map(of_a.__getitem__, common_ends)), list(map(of_b.__getitem__, common_ends))], np.int64).T


def links_of(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked pairs (A id * width + B id), how many links each stands for, and entries per group, of groups of n_a and n_b
    tokens that stand one after the other in two flat id lists. Large groups come by their distinct ids."""
    start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    large = np.flatnonzero(n_a * n_b >= LARGE)
    entries = n_a * n_b
    distinct = {}
    for g in large.tolist():
        (x, n), (y, m) = (np.unique(ids[at : at + k], return_counts=True) for ids, at, k in ((a, start_a[g], n_a[g]), (b, start_b[g], n_b[g])))
        distinct[g] = ((x[:, None] * width + y).ravel(), (n[:, None] * m).ravel())
        entries[g] = 0
    group = np.repeat(np.arange(entries.size), entries)
    turn = np.arange(group.size) - np.repeat(np.cumsum(entries) - entries, entries)
    pairs = a[start_a[group] + turn // np.maximum(n_b[group], 1)] * width + b[start_b[group] + turn % np.maximum(n_b[group], 1)]
    times = np.ones(pairs.size, np.int64)
    if distinct:
        pairs, times = np.concatenate([pairs, *(x for x, _ in distinct.values())]), np.concatenate([times, *(n for _, n in distinct.values())])
        group = np.concatenate([group, *(np.full(x.size, g) for g, (x, _) in distinct.items())])
        order = np.argsort(group, kind="stable")
        pairs, times = pairs[order], times[order]
        entries[large] = [distinct[g][0].size for g in large.tolist()]
    return pairs, times, entries


def given_back(raw: list[bytes], ids: list[list[int]], by: Tokenizer) -> np.ndarray:
    """Which texts the bytes of their tokens are equal to."""
    of, counts = by.raw, np.array(list(map(len, ids)), np.int64)
    flat = list(chain.from_iterable(ids))
    lengths = _by_length(by.sizes[np.array(flat, np.int64)], counts)
    if (lengths == np.array(list(map(len, raw)), np.int64)).all() and b"".join(map(of.__getitem__, flat)) == b"".join(raw):
        return np.ones(len(raw), bool)
    return np.array([b"".join([of[i] for i in x]) == r for x, r in zip(ids, raw, strict=True)], bool)


class Numbers(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


@lru_cache(maxsize=1)
def _marked(size: int) -> np.ndarray:
    """Decimal ids with the mark that follows them: a comma, a bar, a semicolon."""
    return np.array([f"{i}{mark}" for mark in ",|;" for i in range(size)], object)


class Chunks:
    """The different chunks of a slice, each aligned once: text and counts (n_a, n_b, n_groups, n_links) of each, whether
    both tokenizers give it back, and its linked pairs as places in ``pairs``."""

    def __init__(self, chunks: list[str], a: Tokenizer, b: Tokenizer):
        n = len(chunks)
        self.sound, self.text, self.counts, self.n_pairs = np.zeros(n, bool), [""] * n, np.zeros((n, 4), np.int64), np.zeros(n, np.int64)
        pairs, times, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        self._names = _marked(max(a.size, b.size))
        while at < n:
            then, size = at, 0
            while then < n and (then == at or size < ENCODE_BYTES):
                size += len(chunks[then])
                then += 1
            raw, ids_a, ids_b = [x.encode() for x in chunks[at:then]], a.encode(chunks[at:then]), b.encode(chunks[at:then])
            sound = given_back(raw, ids_a, a) & given_back(raw, ids_b, b)
            good = np.flatnonzero(sound).tolist()
            flat_a, flat_b = (np.fromiter(chain.from_iterable([ids[k] for k in good]), np.int64) for ids in (ids_a, ids_b))
            cuts = cuts_of(flat_a, flat_b, a.sizes, b.sizes)  # a chunk's end is a common end
            (n_a, n_b), ends = np.diff(cuts, axis=0, prepend=0).T, np.cumsum([len(ids_a[k]) for k in good])
            of_chunk = np.diff(np.searchsorted(cuts[:, 0], ends, side="right"), prepend=0)
            self.sound[at:then] = sound
            if good:
                self.counts[at:then][good, :3] = np.stack([[len(ids_a[k]) for k in good], [len(ids_b[k]) for k in good], of_chunk], axis=1)
            shown = self._shown(flat_a, flat_b, cuts)
            start = 0
            for k, n_tokens in zip(good, self.counts[at:then][good, :2].sum(axis=1).tolist(), strict=True):
                self.text[at + k] = "".join(shown[start : start + n_tokens])[:-1]
                start += n_tokens
            linked, held, entries = links_of(flat_a, flat_b, n_a, n_b, b.size)
            pairs.append(linked)
            times.append(held)
            groups = self.counts[at:then, 2]
            self.counts[at:then, 3] = _by_length(n_a * n_b, groups)
            self.n_pairs[at:then] = _by_length(entries, groups)
            at = then
        self.pairs, local = np.unique(np.concatenate(pairs), return_inverse=True)
        self.local, self.times = local.astype(np.int64), np.concatenate(times)

    def _shown(self, a: np.ndarray, b: np.ndarray, cuts: np.ndarray) -> list[str]:
        """Both flat id lists as decimal ids, group by group, each with the mark that follows it."""
        each = self._names.size // 3
        group_a, group_b = (np.repeat(np.arange(len(cuts)), np.diff(side, prepend=0)) for side in cuts.T)
        names = np.concatenate([self._names[a], self._names[b]])
        last_a, last_b = cuts[:, 0] - 1, cuts[:, 1] - 1
        names[last_a] = self._names[each + a[last_a]]
        names[a.size + last_b] = self._names[2 * each + b[last_b]]
        return names[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")].tolist()

    def held(self, documents: list[np.ndarray]) -> np.ndarray:
        """How many of the documents (lists of chunks) hold each pair."""
        starts = np.cumsum(self.n_pairs) - self.n_pairs
        out = np.zeros(self.pairs.size, np.int64)
        for chunks in documents:
            own = np.unique(chunks)
            n = self.n_pairs[own]
            entries = np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out[np.unique(self.local[entries])] += 1
        return out


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest one takes, after a byte that says how many."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if values.max(initial=0) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + np.ascontiguousarray(values, kind).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[data[0]], offset=1).astype(np.int64)


def larger_slices(batches, column: str):
    """Arrow batches joined to about SLICE_BYTES of texts."""
    held, size = [], 0
    for batch in batches:
        for part in common.slices([batch], column):
            n = pc.sum(pc.binary_length(part.column(part.schema.names.index(column)))).as_py() or 0
            if held and size + n > SLICE_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.Table.from_batches(held)


SLICES = "slice long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, groups array<string>, n_chunks binary, chunks binary, n_pairs binary, local binary, times binary, pairs array<long>, held array<int>"


def slices(docs: DataFrame, a_spec: str, b_model: bytes, groups: bool = False) -> DataFrame:
    """A row for each slice of the documents."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its core
        a, b = tokenizer_a(a_spec), tokenizer_b(b_model)
        for table in larger_slices(batches, "text"):
            known, documents = Numbers(), []
            for text in table["text"].to_pylist():
                documents.append(np.array(list(map(known.__getitem__, CHUNK.split(" " + text))) if text else [], np.int64))
            found = Chunks(list(known), a, b)
            documents = [x if found.sound[x].all() else x[:0] for x in documents]
            sums = np.array([found.counts[x].sum(axis=0) for x in documents], np.int64).reshape(-1, 4)
            texts = [";".join([found.text[i] for i in x.tolist()]) for x in documents] if groups else None
            sha = [hashlib.sha256(";".join([found.text[i] for i in x.tolist()]).encode()).hexdigest() if x.size else "" for x in documents]
            flat = np.concatenate([np.zeros(0, np.int64), *documents])
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            cols = [
                table["row"].slice(0, 1).combine_chunks(), one(table["doc_id"].combine_chunks()), *[one(pa.array(sums[:, i])) for i in range(4)],
                one(pa.array(sha, pa.string())), one(pa.array(texts, pa.string())) if groups else pa.nulls(1, pa.list_(pa.string())),
                *[pa.array([x], pa.binary()) for x in map(packed, (np.array([x.size for x in documents]), flat, found.n_pairs, found.local, found.times))],
                one(pa.array(found.pairs)), one(pa.array(found.held(documents).astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(cols, schema=SCHEMA)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text"))
    return rows.mapInArrow(run, SLICES)


_longs = pa.list_(pa.int64())
SCHEMA = pa.schema([("slice", pa.int64()), *[(c, _longs) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.list_(pa.string())), ("groups", pa.list_(pa.string())), *[(c, pa.binary()) for c in ("n_chunks", "chunks", "n_pairs", "local", "times")], ("pairs", _longs), ("held", pa.list_(pa.int32()))])


def pair_counts(made: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(slice, pair, held) of all slices, and for each pair (pair, n, best): the documents that hold it linked, and
    whether no pair of its A id is held by more."""
    asked = made.select("slice", F.inline(F.arrays_zip("pairs", "held"))).withColumnRenamed("pairs", "pair").filter("held > 0")
    counts = common.stage(asked.groupBy("pair").agg(F.sum("held").alias("n")).withColumn("a", (F.col("pair") / width).cast("long")), "pair-counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # a row for each A id: no more than the vocabulary
    return asked, counts.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, groups: bool = True) -> DataFrame:
    """Tokens, groups and links of each document over two tokenizers, with how common its linked id pairs are.

    Gives (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups). A pair's count is the number of
    documents that hold it linked; count_sum adds it up over a document's links, and n_best counts the links whose
    pair has the highest count of its A id, ties included. groups is ``a1,a2|b1;a3|b2,b3`` with decimal ids (null unless
    asked for), groups_sha256 its digest. A text that is missing or empty, or that either tokenizer does not give
    back byte by byte, has no tokens: zeros and empty strings. Repeated rows count as documents each, rows with a missing doc_id
    as well. An empty table gives no rows; other columns are not read. The vocabulary files are read by the
    driver and sent with the tasks.
    """
    with open(a_path, encoding="utf-8") as file:
        a_spec = file.read()
    with open(b_path, "rb") as file:
        b_model = file.read()
    made = common.stage(slices(docs, a_spec, b_model, groups), "slices", large_rows=True)
    asked, scored = pair_counts(made, tokenizer_b(b_model).size)
    replies = asked.select(F.col("slice").alias("asking"), "pair").join(scored, "pair")

    def finish(rows: pa.Table, told: pa.Table) -> pa.Table:
        parts = [pa.table({c: pa.array([], t) for c, t in zip(RESULT.names, RESULT.types, strict=True)}, schema=RESULT)]
        order = told.sort_by("pair")
        pair, n, best = (order[c].to_numpy().astype(np.int64) for c in ("pair", "n", "best"))
        for row in rows.to_pylist():
            n_pairs, local, times, chunks, n_chunks = (unpacked(row[c]) for c in ("n_pairs", "local", "times", "chunks", "n_chunks"))
            own = np.array(row["pairs"], np.int64)
            at = np.minimum(np.searchsorted(pair, own), max(0, pair.size - 1))
            known = pair[at] == own if pair.size else np.zeros(own.size, bool)  # pairs of unsound documents alone have no count

            def sums(values, *, at=at, known=known, local=local, times=times, n_pairs=n_pairs, chunks=chunks, n_chunks=n_chunks):
                of_pair = np.where(known, values[at], 0) if values.size else np.zeros(known.size, np.int64)
                of_chunk = _by_length(times * of_pair[local], n_pairs)
                return _by_length(of_chunk[chunks], n_chunks)

            parts.append(pa.table({**{c: row[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}, "n_best": sums(best), "count_sum": sums(n), "groups_sha256": row["groups_sha256"], "groups": row["groups"] or [None] * n_chunks.size}, schema=RESULT))
        return pa.concat_tables(parts)

    lists = made.drop("held")
    return lists.groupBy("slice").cogroup(replies.groupBy("asking")).applyInArrow(finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string")


RESULT = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string()), ("groups", pa.string())])


def _by_length(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches."""
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
    ends = np.cumsum(lengths)
    return before[ends] - before[ends - lengths]


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(common.documents(spark, sf_dir), public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE), groups=False).drop("groups")
