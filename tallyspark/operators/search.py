"""Substring search over an index of entries by posting lists of three-character grams.

``write`` keeps three Parquet tables: ``entries`` (by slot of a hash of what names an entry), ``postings`` by bucket of the
gram and sorted by it, and ``grams`` with each gram's number of entries. A row of ``postings`` has a gram's entries among some
texts of a slot that one task read together, as offsets from the first one's number. A query looks up its grams there, reads
the posting lists of its rarest ones only (``RAREST``), intersects them, and verifies the whole query on the texts of the
entries that are left. Its cost follows the rarest grams, not the index. Queries of one or two characters have no gram and
scan the entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.text import search as scan

GRAM = 3
#: Posting lists that a query intersects at most; more of them would cost more than the candidates they rule out.
RAREST = 4
#: Folders that grams and entries are dealt out to, and parts of a frequent gram's list and of a slot.
BUCKETS, SLOTS, PARTS = 64, 16, 8
#: Characters of texts whose postings a task makes together, and the bits that an offset of theirs has.
CHUNK, OFFSET = 1 << 23, 31


def grams(text: Column) -> Column:
    """The different three-character grams of a text, case ignored; ``write`` makes the same ones for many texts at a time."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=({'.' * GRAM}))"), F.lit(1)))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write(index: DataFrame, order: list[str], root: str) -> None:
    """Keep an index of entries (``text`` and any other columns; ``order`` names and orders an entry) under ``root``."""
    name = F.pmod(F.xxhash64(*order), F.lit(SLOTS * PARTS))
    rows = index.withColumn("__part", name).repartition("__part").withColumn("slot", F.pmod("__part", F.lit(SLOTS)).cast("int"))
    rows = rows.sortWithinPartitions("slot").withColumn("entry", F.monotonically_increasing_id())  # in a slot's files its entries follow each other
    rows.drop("__part").write.mode("overwrite").partitionBy("slot").parquet(f"{root}/entries")
    kept = index.sparkSession.read.parquet(f"{root}/entries")
    lists = kept.select("slot", "entry", F.lower("text").alias("text")).mapInArrow(_lists, "slot int, first long, gram string, n int, offsets array<int>")
    lists = lists.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket", F.pmod(F.xxhash64("first"), F.lit(PARTS))).sortWithinPartitions("bucket", "gram")
    lists.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings")
    counts = index.sparkSession.read.parquet(f"{root}/postings").groupBy("gram").agg(F.sum("n").alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{root}/grams")


def _codes(text: str) -> np.ndarray:
    """The different grams of a text, in order, as numbers: 21 bits for each of the three characters."""
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique(chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:])


def _chunk(slot: int, first: int, entries: list[int], codes: list[np.ndarray]) -> pa.RecordBatch:
    """The postings of some texts of a slot: a row for each of their grams."""
    sizes = [len(c) for c in codes]
    offsets = np.repeat(np.array(entries, np.int64) - first, sizes).astype(np.int32)
    every = np.concatenate(codes)
    order = np.argsort(every, kind="stable")
    every = every[order]
    starts = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    found = every[starts]
    chars = np.stack([found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF], axis=1).astype(np.uint32).tobytes().decode("utf-32-le")
    ends = np.append(starts, len(every)).astype(np.int32)
    columns = [
        pa.array(np.full(len(found), slot, np.int32)),
        pa.array(np.full(len(found), first, np.int64)),
        pa.array([chars[i : i + GRAM] for i in range(0, len(chars), GRAM)], pa.string()),
        pa.array(np.diff(ends)),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(offsets[order])),
    ]
    return pa.RecordBatch.from_arrays(columns, ["slot", "first", "gram", "n", "offsets"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of (slot, entry, text in lower case), made for CHUNK characters of a slot at a time."""
    slot = first = size = 0
    entries: list[int] = []
    codes: list[np.ndarray] = []
    for batch in batches:
        for now, entry, text in zip(*(batch.column(i) for i in range(3))):
            now, entry, text = now.as_py(), entry.as_py(), text.as_py()
            if text is None or len(text) < GRAM:
                continue
            if entries and (now != slot or size + len(text) > CHUNK or not 0 <= entry - first < 1 << OFFSET):
                yield _chunk(slot, first, entries, codes)
                entries, codes = [], []
            if not entries:
                slot, first, size = now, entry, 0
            entries.append(entry)
            codes.append(_codes(text))
            size += len(text)
    if entries:
        yield _chunk(slot, first, entries, codes)


def rarest(spark: SparkSession, root: str, q: str) -> list[str] | None:
    """The rarest grams of a query, no more than RAREST; None if one of them is nowhere."""
    text = q.lower()
    mine = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
    known = spark.read.parquet(f"{root}/grams").filter(F.col("gram").isin(mine)).collect()  # a row for each gram of the query
    if len(known) < len(mine):
        return None
    return [r["gram"] for r in sorted(known, key=lambda r: (r["n"], r["gram"]))[:RAREST]]


def postings(spark: SparkSession, root: str, chosen: list[str]) -> DataFrame:
    """The posting lists of some grams, (slot, entry, gram): only their buckets' files are read."""
    rows = spark.read.parquet(f"{root}/postings")
    buckets = [r["bucket"] for r in spark.createDataFrame([(g,) for g in chosen], "gram string").select(_bucket(F.col("gram")).alias("bucket")).distinct().collect()]
    return rows.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(chosen)).select("slot", "first", "gram", F.explode("offsets").alias("offset")).select("slot", (F.col("first") + F.col("offset")).alias("entry"), "gram")


def search(spark: SparkSession, root: str, order: list[str], q: str, limit: int = 80) -> DataFrame:
    """The first ``limit`` entries, by ``order``, whose text holds the query, case ignored: as ``text.search`` over all of them."""
    entries = spark.read.parquet(f"{root}/entries")
    found = entries
    if len(q.lower()) >= GRAM:
        chosen = rarest(spark, root, q)
        if chosen is None:
            return entries.limit(0).drop("entry", "slot")
        held = postings(spark, root, chosen).groupBy("slot", "entry").agg(F.count("*").alias("n")).filter(F.col("n") == len(chosen))
        found = entries.join(held, ["slot", "entry"], "left_semi")
    return scan(found, q, limit, order).drop("entry", "slot")
