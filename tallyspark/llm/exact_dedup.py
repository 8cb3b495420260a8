"""Exact deduplication against a minimal perfect hash of historical digests (operator 5)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common, tokens
from tallyspark.llm.fm import BitRank

#: Distinct digests in a shard of the index, on average.
SHARD_DIGESTS = 50_000

#: Slots tried for each key of a level; fewer would need more levels.
SPREAD = 2

#: Rows equal in doc_id and text that are written out at once.
PART_ROWS = 10_000

U = np.uint64


def place_at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (tokens.mix(keys ^ tokens.mix(np.array([level + 1], U))) % U(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of 64-bit keys by levels of bit vectors: a key's level is the first where no
    other key shares its bit; its slot is the number of bits before its own over all levels."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = BitRank(bits)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, rest = [], [], keys
        while rest.size:
            size = SPREAD * rest.size
            at = place_at(rest, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            rest = rest[~alone[at]]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of keys that the function was not built from any slot, or -1."""
        out, open_, base = np.full(keys.size, -1), np.arange(keys.size), 0
        for level, size in enumerate(self.sizes):
            at = base + place_at(keys[open_], level, size)
            hit = self.bits[at]
            out[open_[hit]] = self.rank.ones(at[hit])
            open_, base = open_[~hit], base + size
        return out


def _digests(frame: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["digest"]), np.uint8).reshape(-1, 32)


def _keys(digests: np.ndarray) -> np.ndarray:
    """64 bits of each digest as hash keys (a shard is a few bits of other bytes)."""
    return np.ascontiguousarray(digests[:, 8:16]).view(U).ravel()


def _shard(n_shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n_shards)).cast("int").alias("shard")


def build_index(groups: DataFrame, n_shards: int) -> DataFrame:
    """A row for each shard: the perfect hash, and its slots (digest, winner, n) in slot order."""

    def run(pdf):
        digests = _digests(pdf)
        keys = _keys(digests)
        first = np.sort(np.unique(keys, return_index=True)[1])
        hashed = PerfectHash.build(keys[first])
        # A digest that agrees with another of its shard in 64 bits has no slot; it stands behind the slots.
        order = np.concatenate((first[np.argsort(hashed.slots(keys[first]))], np.setdiff1d(np.arange(keys.size), first)))
        return pd.DataFrame([{"shard": pdf["shard"].iloc[0], "sizes": hashed.sizes, "bits": np.packbits(hashed.bits).tobytes(), "digests": digests[order].tobytes(), "winners": pdf["winner"].to_numpy(np.int64)[order].tobytes(), "counts": pdf["n"].to_numpy(np.int64)[order].tobytes()}])

    return groups.select(_shard(n_shards), "digest", "winner", "n").groupBy("shard").applyInPandas(run, "shard int, sizes array<long>, bits binary, digests binary, winners binary, counts binary")


def look_up(index: DataFrame, batch: DataFrame, n_shards: int) -> DataFrame:
    """(digest, winner, n, member): every slot with the batch's repeats added, then the batch's new digests."""

    def run(slots, pdf):
        digests = np.zeros((0, 32), np.uint8)
        winners = counts = np.zeros(0, np.int64)
        if len(slots):
            row = slots.iloc[0]
            digests = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
            winners, counts = (np.frombuffer(row[c], np.int64).copy() for c in ("winners", "counts"))
        asked, winner, n = _digests(pdf), pdf["winner"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        member = np.zeros(len(pdf), bool)
        if len(slots) and len(pdf):
            sizes = [int(x) for x in row["sizes"]]
            bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(sizes)].astype(bool)
            slot = PerfectHash(sizes, bits).slots(_keys(asked))
            for i in range(int(bits.sum()), len(digests)):
                slot[(asked == digests[i]).all(axis=1)] = i
            found = slot >= 0
            member[found] = (digests[slot[found]] == asked[found]).all(axis=1)  # every byte
            winners[slot[member]] = np.maximum(winners[slot[member]], winner[member])
            counts[slot[member]] += n[member]
        new = ~member
        return pd.DataFrame({"digest": [x.tobytes() for x in digests] + [x.tobytes() for x in asked[new]], "winner": np.concatenate((winners, winner[new])), "n": np.concatenate((counts, n[new])), "historical": np.arange(len(digests) + int(new.sum())) < len(digests)})

    asked = batch.select(_shard(n_shards), "digest", "winner", "n")
    return index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(run, "digest binary, winner long, n long, historical boolean")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NO_ID)), "__digest": F.unhex(F.sha2(common.whole_text(), 256))})


def verdicts(places: DataFrame) -> DataFrame:
    """(digest, winner, n, historical) of each different text of (doc, digest, m) rows; staged.

    History is the lower half of the doc_id range, as in an append-only corpus: its distinct digests are
    indexed, the upper half is looked up.
    """
    ends = places.filter(F.col("doc") != common.NO_ID).agg(F.min("doc").alias("low"), F.max("doc").alias("high")).first()
    split = (ends["low"] + ends["high"]) // 2 if ends["low"] is not None else 0
    groups = common.stage(places.groupBy((F.col("doc") <= split).alias("old"), "digest").agg(F.max("doc").alias("winner"), F.sum("m").alias("n")), "digests")
    n_shards = max(1, -(-groups.count() // SHARD_DIGESTS))
    index = common.stage(build_index(groups.filter("old"), n_shards), "index")
    out = common.stage(look_up(index, groups.filter("not old"), n_shards), "verdicts")
    common.release(groups, index)
    return out


def exact_dedup(docs: DataFrame) -> DataFrame:
    """For each row: the doc_id of the row that stays among equal texts, the group's size, and whether it is this one.

    Texts are equal when their bytes are; a missing one is empty. The largest doc_id stays; a missing
    doc_id counts as smaller than all. Of rows equal in doc_id and text one stays. Gives (doc_id,
    keep_id, group_size, kept, text_sha256); other columns are not read. An empty table gives no rows.
    """
    rows = _keyed(docs).groupBy(F.col("__doc").alias("doc"), F.col("__digest").alias("digest")).agg(F.count("*").alias("m"))
    places = common.stage(rows, "places")
    found = places.join(verdicts(places).drop("historical"), "digest")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / PART_ROWS))).alias("part")
    rest = F.least(F.col("m") - F.col("part") * PART_ROWS, F.lit(PART_ROWS))
    each = found.select("*", part).select("*", F.explode(F.sequence(F.lit(1).cast("long"), rest)).alias("copy"))
    known = lambda c: F.nullif(F.col(c), F.lit(common.NO_ID))
    return each.select(known("doc").alias("doc_id"), known("winner").alias("keep_id"), F.col("n").alias("group_size"), ((F.col("doc") == F.col("winner")) & (F.col("part") == 0) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are. An empty table stays empty."""
    keyed = _keyed(docs)
    places = common.stage(keyed.groupBy(F.col("__doc").alias("doc"), F.col("__digest").alias("digest")).agg(F.count("*").alias("m")), "places")
    stay = verdicts(places).select(F.col("winner").alias("__doc"), F.col("digest").alias("__digest"))
    return keyed.join(stay, ["__doc", "__digest"], "left_semi").dropDuplicates(["__doc", "__digest"]).drop("__doc", "__digest")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.documents(spark, sf_dir))


OP5_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM t WINDOW g AS (PARTITION BY text)
"""
