"""Routing of fixed-length windows, so that equal windows of any two documents meet in one shard.

Every window of L tokens is assigned to its minimizer: the leftmost smallest hash among its K-token
grams. Equal windows have equal minimizers. Consecutive windows with one minimizer position form a
segment, and only segments, some two per L-K tokens, travel:

1. ``segments``: (m, d, doc, tie, start, n): minimizer, digest of the segment's tokens, place, windows.
2. ``some``: segments whose minimizer occurs more than once; nothing else can hold a repeat. A minimizer's
   home is one document that holds it, the one of least hash.
3. ``groups``: segments of a minimizer with one digest are represented by the first and the last of them,
   with their number. Others, however many, end here by partial aggregation.
4. ``contents``: the tokens of every representative, read from the documents they stand in. All segments of
   one minimizer lie in one shard, and minimizers with one home lie together, so a document's representatives
   are mostly one stretch of text there and not overlapping pieces. A home too large for a shard is dealt out
   by minimizer. A minimizer too large on its own (a very common line) is cut into windows: those with one
   digest are represented by two again, and these are dealt out by window. They are segments of one window to
   everything that follows.
5. ``in_shards``: each shard's index says which windows stand elsewhere. Digests only propose: the other
   copies of a segment follow its first where the index finds all windows of that a second time, which they
   are if the last copy has the same tokens. Where it does not find them, nothing follows.

A document is (doc, tie): its doc_id (a missing one as NO_ID) and a 60-bit hash of the text, so that rows
that share a doc_id but not the text are kept apart. Rows equal in both go through the index once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import common, tokens

U = np.uint64
SHARD_TOKENS = 1_500_000

#: Tokens of one home or minimizer that stay together; more are dealt out.
PART_TOKENS = 300_000
#: Keys with more than one in HEAVY of all rows; there are fewer than HEAVY of them, whatever the input.
HEAVY = 1000
#: Ranges digested at once, and windows in a batch of them.
DIGESTS = 50_000
_POS = 21  # bits for a position inside a piece of CHUNK tokens


@dataclass(frozen=True)
class Spec:
    """length: tokens in a window; gram: tokens in a minimizer gram; words: tokens are words, else bytes."""

    length: int
    gram: int
    words: bool

    def raw(self, buf: np.ndarray) -> np.ndarray:
        """The tokens that windows are compared by: bytes, or a 64-bit digest of each word."""
        return tokens.word_hashes(buf, fold=False) if self.words else buf

    def values(self, raw: np.ndarray) -> np.ndarray:
        """64-bit numbers to make gram hashes of."""
        return raw if self.words else tokens.byte_values(raw)


@dataclass(frozen=True)
class Held:
    """The representatives in a shard, in order: text number, place in it, windows, and the number of segments
    that a first one stands for (0: a last one)."""

    row: np.ndarray
    at: np.ndarray
    n: np.ndarray
    c: np.ndarray


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries, by block prefix and suffix minima."""
    n = x.size - w + 1
    size = -(-x.size // w) * w
    padded = np.full(size, np.iinfo(U).max, U)
    padded[: x.size] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def digests(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each token range."""
    data, width, out = memoryview(np.ascontiguousarray(raw)).cast("B"), raw.itemsize, np.empty(first.size, U)
    of = xxhash.xxh3_64_intdigest
    for at in range(0, first.size, DIGESTS):
        a, b = first[at : at + DIGESTS] * width, (first + size)[at : at + DIGESTS] * width
        out[at : at + DIGESTS] = [of(data[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    return out


def cut_segments(raw: np.ndarray, spec: Spec) -> Iterator[tuple[np.ndarray, ...]]:
    """(m, d, start, n) arrays of a document's segments, a piece at a time."""
    total = raw.size - spec.length + 1
    for at in range(0, max(0, total), tokens.CHUNK):
        part = raw[at : min(at + tokens.CHUNK, total) + spec.length - 1]
        pre = tokens.prefix(spec.values(part))
        starts = np.arange(part.size - spec.gram + 1)
        grams = tokens.ranges(pre, starts, starts + spec.gram)
        key = (grams & ~U((1 << _POS) - 1)) | starts.astype(U)
        place = (sliding_min(key, spec.length - spec.gram + 1) & U((1 << _POS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        n = np.diff(first, append=place.size)
        yield grams[place[first]], digests(part, first, n + spec.length - 1), at + first, n


def segments(docs: DataFrame, spec: Spec) -> DataFrame:
    """All segments of (doc, tie, body) rows; body is the text in UTF-8."""

    def run(batches):
        for batch in common.slices(batches, "body"):
            names, parts = batch.schema.names, []
            doc, tie = (batch.column(names.index(c)) for c in ("doc", "tie"))
            for i, buf in enumerate(tokens.rows_of(batch.column(names.index("body")))):
                for m, d, start, n in cut_segments(spec.raw(buf), spec):
                    parts.append((m, d, np.full(m.size, i), start, n))
            if parts:
                m, d, row, start, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(d.view(np.int64)), doc.take(at), tie.take(at), pa.array(start), pa.array(n.astype(np.int32))], names=["m", "d", "doc", "tie", "start", "n"])

    return docs.mapInArrow(run, "m long, d long, doc long, tie long, start long, n int")


def doc_key() -> tuple[Column, Column]:
    """(doc, tie) of a row."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NO_ID)).alias("doc"), common.order_hash(common.whole_text()).alias("tie")


class Texts:
    """Documents by key, with those apart that share doc_id and text with another row: ``repeated`` (staged) or None."""

    def __init__(self, docs: DataFrame):
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *doc_key(), common.whole_text().cast("binary").alias("body"))
        more = docs.select(*doc_key()).groupBy("doc", "tie").agg(F.count("*").alias("c")).filter("c > 1").select("doc", "tie")
        more = common.stage(more, "repeated-keys")
        self.rows, self.repeated = rows, None
        if not more.isEmpty():
            same = common.stage(rows.join(more, ["doc", "tie"], "left_semi").withColumn("row", F.monotonically_increasing_id()), "repeated-rows")
            head = same.groupBy("doc", "tie").agg(F.min("row").alias("head"))
            self.rows = rows.join(more, ["doc", "tie"], "left_anti")
            self.repeated = same.join(head, ["doc", "tie"]).withColumn("again", F.col("row") > F.col("head"))

    def every(self) -> DataFrame:
        """(doc_id, doc, tie, body, twin, again) of every row: twin if other rows have its key, again in all but one of them."""
        rows = self.rows.withColumns({"twin": F.lit(False), "again": F.lit(False)})
        return rows if self.repeated is None else rows.unionByName(self.repeated.withColumn("twin", F.lit(True)).select(rows.columns))

    def once(self) -> DataFrame:
        """(doc, tie, body), one row of each key."""
        return self.every().filter("not again").select("doc", "tie", "body")


def place() -> Column:
    return F.struct("doc", "tie", "start")


def joined_by_count(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``many`` (staged) joined with ``few`` (staged), which has one row a key and in c how many rows ``many`` has of it, or fewer.

    A key with more than one in HEAVY of the rows would be one task's work: fewer than HEAVY keys have so
    many, so these are broadcast and their rows stay where they are. The others are shuffled.
    """
    heavy = F.col("c") * HEAVY > many.count()
    common_keys = few.filter(heavy)
    if common_keys.isEmpty():
        return many.join(few, keys)
    rest = many.join(F.broadcast(common_keys.select(keys)), keys, "left_anti").join(few.filter(~heavy), keys)
    return rest.unionByName(many.join(F.broadcast(common_keys), keys))


def _represented(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """(keys, first, last, c): the first and last place of each key, the last only where there are more."""
    groups = rows.groupBy(keys).agg(F.min(place()).alias("first"), F.max(place()).alias("last"), F.count("*").alias("c"), *more)
    return groups.withColumn("last", F.when(F.col("c") > 1, F.col("last")))


def _wanted(groups: DataFrame) -> DataFrame:
    """(doc, tie, wanted): the representatives in each document, as many as its text has windows at most; c is 0 in last ones."""
    both = F.array(F.struct(F.col("first").alias("p"), "c"), F.struct(F.col("last").alias("p"), F.lit(0).cast("long").alias("c")))
    rows = groups.select("shard", "m", "d", "n", F.inline(both)).filter("p is not null")
    return rows.groupBy("p.doc", "p.tie").agg(F.collect_list(F.struct("shard", "p.start", "n", "c", "m", "d")).alias("wanted"))


def _windows_of(docs: Texts, groups: DataFrame, spec: Spec) -> DataFrame:
    """(m, doc, tie, start, of_m, of_d, of_n, head): a row for each window of the representatives: its digest and place,
    the segment's key and windows, and whether it is a first one."""

    def run(batches):
        for batch in common.slices(batches, "body"):
            names = batch.schema.names
            doc, tie = (batch.column(names.index(c)).to_pylist() for c in ("doc", "tie"))
            bodies = tokens.rows_of(batch.column(names.index("body")))
            for key, t, buf, want in zip(doc, tie, bodies, tokens.lists_of(batch.column(names.index("wanted"))), strict=True):
                raw, n = spec.raw(buf), want["n"].astype(np.int64)
                every = np.repeat(want["start"] - np.cumsum(n) + n, n) + np.arange(n.sum())
                segment = np.repeat(np.arange(n.size), n)
                for at in range(0, every.size, DIGESTS):
                    start, of = every[at : at + DIGESTS], segment[at : at + DIGESTS]
                    m = digests(raw, start, np.full(start.size, spec.length)).view(np.int64)
                    cols = [m, np.full(start.size, key), np.full(start.size, t), start, want["m"][of], want["d"][of], n[of], want["c"][of] > 0]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["m", "doc", "tie", "start", "of_m", "of_d", "of_n", "head"])

    return docs.once().join(_wanted(groups), ["doc", "tie"]).mapInArrow(run, "m long, doc long, tie long, start long, of_m long, of_d long, of_n long, head boolean")


def _extract(rows: DataFrame, spec: Spec) -> DataFrame:
    """(shard, doc, tie, start, body, held): the stretches of each document that a shard needs, with the
    representatives in them as rows of (place, windows, c, m, d)."""

    def run(batches):
        for batch in common.slices(batches, "body"):
            out = []
            doc, tie, body, wanted = (batch.column(batch.schema.names.index(c)) for c in ("doc", "tie", "body", "wanted"))
            for key, t, buf, want in zip(doc.to_pylist(), tie.to_pylist(), tokens.rows_of(body), tokens.lists_of(wanted), strict=True):
                raw, order = spec.raw(buf), np.lexsort((want["start"], want["shard"]))
                shard, start, n, c, m, d = (want[name][order] for name in ("shard", "start", "n", "c", "m", "d"))
                end = start + n + spec.length - 1
                head = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (start[1:] > end[:-1])))
                last = np.append(head[1:], start.size)
                held = np.stack([start - np.repeat(start[head], last - head), n, c, m, d], axis=1).astype(np.int64)
                out += [(int(shard[a]), key, t, int(start[a]), raw[start[a] : end[b - 1]].tobytes(), held[a:b].tobytes()) for a, b in zip(head.tolist(), last.tolist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), CONTENT, strict=True)], schema=CONTENT)

    return rows.mapInArrow(run, "shard int, doc long, tie long, start long, body binary, held binary")


CONTENT = pa.schema([("shard", pa.int32()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("body", pa.binary()), ("held", pa.binary())])


def _dealt(groups: DataFrame, length: int, part_tokens: int) -> tuple[DataFrame, int]:
    """(m, hot, part) of each minimizer in ``groups``, staged, and the number of tokens that are not hot.

    part is what lies together: a home, or a piece of one. hot minimizers are too large for a part.
    """
    loads = groups.groupBy("m", "home").agg(F.sum((F.col("n") + length) * F.when(F.col("c") > 1, 2).otherwise(1)).alias("load")).withColumn("hot", F.col("load") > part_tokens)
    loads = common.stage(loads, "loads")
    homes = loads.filter("not hot").groupBy("home").agg(F.sum("load").alias("total"))
    piece = F.pmod(F.xxhash64("m"), F.coalesce(F.ceil(F.col("total") / part_tokens), F.lit(1)))
    dealt = common.stage(loads.join(homes, "home", "left").select("m", "hot", F.xxhash64("home", piece).alias("part"), F.when(~F.col("hot"), F.col("load")).alias("load")), "dealt")
    total = int(dealt.agg(F.sum("load")).first()[0] or 0)
    common.release(loads)
    return dealt, total


def found_places(docs: Texts, spec: Spec, find: Callable, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(doc, tie, start, n): runs of windows that ``find`` reports, staged; see ``in_shards`` for ``find``.

    Segments that ``find`` confirms the first of are reported wherever else they stand; whether the first's own
    place is, ``find`` says. A run may be reported twice.
    """
    every = common.stage(segments(docs.once(), spec), "segments")
    often = every.groupBy("m").agg(F.count("*").alias("c"), F.min(F.xxhash64("doc", "tie")).alias("home")).filter("c > 1")
    some = common.stage(joined_by_count(every, common.stage(often, "often"), ["m"]).drop("c"), "repeated")
    common.release(every)
    groups = common.stage(_represented(some, ["m", "d"], F.first("n").alias("n"), F.first("home").alias("home")), "groups")
    dealt, total = _dealt(groups, spec.length, part_tokens)
    placed = groups.drop("home").join(dealt.drop("load"), "m")
    calm, hot, cut = placed.filter("not hot"), None, None
    if not dealt.filter("hot").isEmpty():
        hot = common.stage(placed.filter("hot").withColumn("shard", F.lit(0)), "hot")
        cut = common.stage(_windows_of(docs, hot, spec), "windows")
        alone = _represented(cut, ["m"]).filter("c > 1").withColumns({"d": F.col("m"), "n": F.lit(1), "hot": F.lit(False), "part": F.xxhash64("m")})
        alone = common.stage(alone.select(calm.columns), "alone")
        total += 2 * alone.count() * spec.length
        calm = calm.unionByName(alone)
    n_shards = max(1, -(-total // SHARD_TOKENS))
    wanted = _wanted(calm.withColumn("shard", F.pmod("part", F.lit(n_shards)).cast("int")))
    contents = common.stage(_extract(docs.once().join(wanted, ["doc", "tie"]), spec), "contents")
    found = common.stage(in_shards(contents, spec, find, n_shards), "found")
    own = found.filter("m is null").select("doc", "tie", "start", "n")
    sure = found.filter("m is not null").select("m", "d", place().alias("first"), "c")

    def others(rows, confirmed, keys):
        """Places in ``rows`` of what is confirmed, other than the first."""
        return joined_by_count(rows, confirmed, keys).filter(place() != F.col("first")).select("doc", "tie", "start", "n")

    places = own.unionByName(others(some, sure, ["m", "d"]))
    if hot is not None:
        each = sure.filter("m = d").drop("d")
        places = places.unionByName(others(cut.withColumn("n", F.lit(1)), each, ["m"]))
        # A segment that was cut is confirmed if all windows of its first are.
        whole = cut.filter("head").join(each.select("m"), "m").groupBy(F.col("of_m").alias("m"), F.col("of_d").alias("d"), "of_n").agg(F.count("*").alias("k")).filter("k = of_n")
        whole = common.stage(hot.filter("c > 1").join(whole, ["m", "d"]).select("m", "d", "first", "c"), "whole")
        places = places.unionByName(others(some, whole, ["m", "d"]))
    marks = common.stage(places, "marks")
    common.release(some, groups, dealt, contents, found, *([hot, cut, alone, whole] if hot is not None else []))
    return marks


def in_shards(contents: DataFrame, spec: Spec, find: Callable, n_shards: int) -> DataFrame:
    """``find(bodies, held) -> (row, offset, n, sure)`` over each shard's stretches, which are in order of place.

    Gives (doc, tie, start, n) with m and d missing for the runs of windows of stretch ``row`` that are found,
    and (m, d, c) with the first one's place for those of ``held`` that stand for more and are ``sure``. A shard
    holds about SHARD_TOKENS tokens, whatever the input's size.
    """

    def run(pdf):
        dtype = np.uint64 if spec.words else np.uint8
        pdf = pdf.sort_values(["doc", "tie", "start"], kind="stable").reset_index(drop=True)
        parts = [np.frombuffer(x, np.int64).reshape(-1, 5) for x in pdf["held"]]
        row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        at, n, c, m, d = np.concatenate(parts).T
        got, offset, runs, sure = find([np.frombuffer(x, dtype) for x in pdf["body"]], Held(row, at, n, c))
        doc, tie, start = (pdf[c].to_numpy(np.int64) for c in ("doc", "tie", "start"))
        rep = np.flatnonzero(sure & (c > 1))
        own = pa.table({"doc": doc[got], "tie": tie[got], "start": start[got] + offset, "n": runs, **{x: pa.nulls(got.size, pa.int64()) for x in ("m", "d", "c")}})
        others = pa.table({"doc": doc[row[rep]], "tie": tie[row[rep]], "start": start[row[rep]] + at[rep], "n": n[rep], "m": m[rep], "d": d[rep], "c": c[rep]})
        return pa.concat_tables([own, others]).cast(FOUND)

    return contents.repartition(n_shards, "shard").groupBy("shard").applyInArrow(lambda table: run(table.to_pandas()), "doc long, tie long, start long, n int, m long, d long, c long")


FOUND = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("m", pa.int64()), ("d", pa.int64()), ("c", pa.int64())])


def all_true(flags: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether all of flags[start : start + n] are true."""
    before = np.concatenate(([0], np.cumsum(flags)))
    return before[start + n] - before[start] == n


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true flags."""
    turns = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return turns[0::2], turns[1::2] - turns[0::2]


def marked(docs: Texts, marks: DataFrame) -> DataFrame:
    """Every document row with the list ``marks`` of its (start, n) window runs, or null."""
    lists = marks.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    return docs.every().join(lists, ["doc", "tie"], "left")


def covered(n_tokens: int, marks: dict[str, np.ndarray], length: int) -> np.ndarray:
    """Flags of the tokens that some marked window covers."""
    change = np.zeros(n_tokens + 1, np.int64)
    np.add.at(change, marks["start"], 1)
    np.subtract.at(change, marks["start"] + marks["n"] + length - 1, 1)
    return np.cumsum(change[:-1]) > 0
