"""Shards of nearly equal bytes: minimax contiguous partition (operator 6). DataFrame functions only.

Groups of equal texts are atomic and ordered by the SHA-256 of the text. The smallest feasible shard
capacity is found by binary search; a capacity is checked greedily, each shard reaching as far as it can.
A group larger than the capacity fills a shard of its own: so the largest shard is as small as it can be,
and the others are as even as they can be.

The search needs sums of sizes over ranges of the order only. They come from aggregates by hash prefix:
first 4096 ranges, then the few ranges in which a cut can fall, cut again by the next two digits until
the answer is certain. At most a few hundred thousand numbers reach the driver, whatever the input's size.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common
from tallyspark.llm.numbering import numbered

SHARDS = 16
DIGITS = 3
FINER = 2


@dataclass
class Ranges:
    """Ranges of the order with the sum of sizes before each; ``many``: a range with more than one group."""

    low: list[str]
    ends: list[int]
    many: list[bool]
    edges: list[int] = field(init=False)

    def __post_init__(self):
        self.edges = [0, *self.ends]

    def reach(self, at: int, capacity: int, bold: bool) -> int:
        """How far a shard from ``at`` goes: at most (``bold``: any cut may exist in a range with many groups) or at least."""
        i = bisect_right(self.edges, at + capacity) - 1
        if i >= len(self.ends):
            return self.edges[-1]
        if self.many[i] and bold:
            return self.edges[i + 1]
        if self.edges[i] > at:
            return self.edges[i]
        # The next group alone is larger than the capacity, or the range hides smaller ones.
        return self.edges[i + 1] if not self.many[i] else at

    def cuts(self, capacity: int, shards: int, bold: bool) -> list[int] | None:
        """Where greedy shards of this capacity end, or None if more than ``shards`` are needed."""
        out, at = [], 0
        while at < self.edges[-1]:
            then = self.reach(at, capacity, bold)
            if then == at or len(out) == shards:
                return None
            out.append(at := then)
        return out

    def smallest(self, shards: int, bold: bool) -> int:
        low, high = 1, max(1, self.edges[-1])
        if self.cuts(high, shards, bold) is None:
            return high
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, bold) is None:
                low = middle + 1
            else:
                high = middle
        return low


def _undecided(known: Ranges, least: int, most: int, shards: int) -> list[int]:
    """Ranges with many groups in which a cut of some capacity in least..most can fall, up to the first range
    that must be looked into before anything can be said about later cuts."""
    found, low, high, last = set(), 0, 0, len(known.ends)
    for _ in range(shards):
        i, j = (bisect_right(known.edges, at + cap) - 1 for at, cap in ((low, least), (high, most)))
        found.update(k for k in range(i, min(j + 1, last)) if known.many[k])
        here = bisect_right(known.edges, low) - 1
        if here >= last:
            break
        if i == here and known.many[here]:
            return sorted({*(k for k in found if k <= here), here})
        low = known.edges[max(i, here + 1)]
        high = known.edges[min(j + 1, last)]
    return sorted(found)


def _aggregate(rows: DataFrame, digits: int) -> list[tuple[str, int, str, bool]]:
    """(prefix, size, least key, many) of the ranges of the order that share so many digits, in order."""
    prefix = F.substring("key", 1, digits).alias("prefix")
    cells = rows.groupBy(prefix).agg(F.sum("size").alias("size"), F.min("key").alias("low"), (F.min("key") < F.max("key")).alias("many"))
    return sorted((c["prefix"], int(c["size"]), c["low"], c["many"]) for c in cells.collect())


def _ranges(cells: list[tuple[str, int, str, bool]]) -> Ranges:
    return Ranges([c[2] for c in cells], list(accumulate(c[1] for c in cells)), [c[3] for c in cells])


def boundaries(rows: DataFrame, shards: int = SHARDS) -> list[str]:
    """Keys at which shards after the first begin, of (key, size) rows; key is a SHA-256 in hex."""
    cells = _aggregate(rows, DIGITS)
    while True:
        known = _ranges(cells)
        least, most = known.smallest(shards, bold=True), known.smallest(shards, bold=False)
        sure = known.cuts(most, shards, bold=False)
        open_ = [] if least == most and sure is not None and sure == known.cuts(most, shards, bold=True) else _undecided(known, least, most, shards)
        if not open_:
            starts = dict(zip(known.edges, known.low, strict=False))
            return [starts[c] for c in (sure or [])[:-1]]
        length = min(len(cells[i][0]) for i in open_)
        wanted = [cells[i][0] for i in open_ if len(cells[i][0]) == length]
        finer = _aggregate(rows.filter(F.substring("key", 1, length).isin(wanted)), length + FINER)
        inner: dict[str, list] = {}
        for c in finer:
            inner.setdefault(c[0][:length], []).append(c)
        cells = [x for c in cells for x in (inner[c[0]] if len(c[0]) == length and c[0] in inner else [c])]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of every row by the law ``bytes``: sizes near equal, equal texts together.

    Gives (doc_id, size, text_crc32, law, shard, slot, grown_shard). Size is the text's UTF-8 bytes plus 1;
    a missing text counts as empty, is grouped with empty ones and has size 1. Slots count the rows of a shard from 0 without
    gaps. grown_shard belongs to another law and is null. Fewer groups than shards leave shards empty.
    Rows with equal doc_id and text are interchangeable; other columns are not read. An empty table gives no rows.
    """
    text = common.whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("key"))
    rows = common.stage(rows, "sizes")
    number = reduce(lambda a, b: a + b, [(F.col("key") >= b).cast("int") for b in boundaries(rows.select("key", "size"), shards)], F.lit(0))
    cell, fine = F.conv(F.substring("key", 1, DIGITS), 16, 10).cast("int"), common.order_hash(F.coalesce(F.col("doc_id").cast("string"), F.col("key")))
    placed = numbered(rows.withColumns({"shard": number, "__cell": cell, "__fine": fine}), ["shard"], "__cell", "__fine", ["key", "doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("__rank").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.documents(spark, sf_dir))
