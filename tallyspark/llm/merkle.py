"""Merkle dataset manifest by time-forward processing (operator 11).

Leaves are numbered within their tree by a range sort, without one task per tree, and cut into blocks of 2**BLOCK
consecutive ones: subtrees. A node's label is (last leaf under it, level), so every child comes before its
parent. In a block a priority queue ordered by label delivers digests of children to their parent, and holds no
more entries than the subtree is high. Between blocks the queue is external: the blocks' digests are rows that
Spark's shuffle sorts and spills, and which are the leaves of the next round, until each tree has one node.
Subroots are leaves of one more tree. Then the sweep is reversed: from the root down, labels falling, a queue
delivers to each node the suffix of the proof that its parent has, with the sibling in front; rounds deliver
these to blocks, and the first blocks to leaves.

A path is a byte string, from the leaf to the root: a byte that says where the sibling stands (LEFT, RIGHT, ALONE)
and, but for ALONE, the sibling's 32 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import common

#: A block has 2**BLOCK leaves.
BLOCK = 10
LEFT, RIGHT, ALONE = 0, 1, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(parts: list[bytes]) -> bytes:
    """SHA-256 of digests, which are taken as lowercase hex text."""
    return hashlib.sha256("".join(x.hex() for x in parts).encode()).digest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 in hex of the fields, each ``-`` if missing, else its length in UTF-8 bytes, ``:`` and the value."""

    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(field, fields)), 256)


def forward(leaves: list[bytes], height: int) -> list[list[bytes]]:
    """Digests of a subtree's nodes, level by level, by one sweep over its labels in rising order."""
    n, queue, levels = len(leaves), [], [[] for _ in range(height + 1)]

    def settle(level: int, k: int, digest: bytes) -> None:
        levels[level].append(digest)
        if level < height:
            end = min(((k >> 1) + 1) << (level + 1), n) - 1
            heappush(queue, (end, level + 1, k, digest))

    for i, leaf in enumerate(leaves):
        settle(0, i, leaf)
        while queue and queue[0][0] == i:  # nodes whose last leaf this is
            end, level, k, digest = heappop(queue)
            parts = [digest]
            if queue and queue[0][:2] == (end, level):
                parts.append(heappop(queue)[3])
            settle(level, k >> 1, digest_of(parts))
    return levels


def backward(levels: list[list[bytes]], suffix: bytes) -> list[bytes]:
    """The path of each leaf of a subtree whose own path is ``suffix``: the sweep in falling order of labels."""
    height, n = len(levels) - 1, len(levels[0])
    out, queue = [b""] * n, [(1 - n, -height, 0, suffix)]
    while queue:
        _, level, k, path = heappop(queue)
        if level == 0:
            out[k] = path
            continue
        below = levels[-level - 1]
        for child in (2 * k, 2 * k + 1):
            if child < len(below):
                step = bytes([RIGHT if child % 2 == 0 else LEFT]) + below[child ^ 1] if child ^ 1 < len(below) else bytes([ALONE])
                heappush(queue, (1 - min((child + 1) << (-level - 1), n), level + 1, child, step + path))
    return out


def steps(path: bytes) -> Iterator[tuple[int, bytes]]:
    """(side, sibling) of a path, leaf to root."""
    at = 0
    while at < len(path):
        size = 0 if path[at] == ALONE else 32
        yield path[at], path[at + 1 : at + 1 + size]
        at += 1 + size


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    for side, other in steps(path):
        leaf = digest_of([leaf] if side == ALONE else [other, leaf] if side == LEFT else [leaf, other])
    return leaf


def placed(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """``rows`` (staged) with ``index`` (0, 1, ... by ``order`` within ``tree``) and ``size`` of the tree.

    A range sort deals out large trees to many tasks; the counts of its ranges give each range its first index.
    """
    ranges = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("__at", F.monotonically_increasing_id())
    ranges = common.stage(ranges.withColumn("__range", F.shiftright("__at", 33)), name)
    counts = ranges.groupBy(tree, "__range").agg(F.min("__at").alias("__least"), F.count("*").alias("__n"))
    of_tree = Window.partitionBy(tree)  # one row a range
    before = F.coalesce(F.sum("__n").over(of_tree.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = common.stage(counts.select(tree, "__range", (before - F.col("__least")).alias("__shift"), F.sum("__n").over(of_tree).alias("size")), f"{name}-starts")
    return ranges.join(starts, [tree, "__range"]).withColumn("index", F.col("__at") + F.col("__shift")).drop("__at", "__range", "__shift")


BLOCKS = "tree string, index long, size long, digest binary, nodes array<binary>, ids array<long>, found array<binary>"


def _sweep_up(rows: DataFrame, name: str) -> DataFrame:
    """A row for each block of (tree, index, size, digest, id, found) rows, staged: its place and digest among blocks, its
    nodes by level, and the ids and found digests of its leaves."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("index")
        first, size, n = table["index"][0].as_py(), table["size"][0].as_py(), table.num_rows
        levels = forward(table["digest"].to_pylist(), min(BLOCK, (size - 1).bit_length()))
        nodes = [b"".join(level) for level in levels]
        one = lambda name, kind: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), table[name].combine_chunks().cast(kind))
        cols = [table["tree"].slice(0, 1).combine_chunks(), pa.array([first >> BLOCK]), pa.array([(size - 1 >> BLOCK) + 1]), pa.array([levels[-1][0]], pa.binary())]
        return pa.table([*cols, pa.array([nodes], pa.list_(pa.binary())), one("id", pa.int64()), one("found", pa.binary())], names=["tree", "index", "size", "digest", "nodes", "ids", "found"])

    block = rows.withColumn("block", F.shiftright("index", BLOCK))
    return common.stage(block.groupBy("tree", "block").applyInArrow(run, BLOCKS), name)


def climb(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Rounds of blocks from (tree, index, size, digest, id, found) rows up to one node a tree."""
    rounds = [_sweep_up(leaves, f"{name}-blocks")]
    while (rounds[-1].agg(F.max("size")).first()[0] or 1) > 1:
        above = rounds[-1].select("tree", "index", "size", "digest", F.col("index").alias("id"), F.lit(None).cast("binary").alias("found"))
        rounds.append(_sweep_up(above, f"{name}-blocks"))
    return rounds


def _paths(row: dict) -> list[bytes]:
    levels = [[x[i : i + 32] for i in range(0, len(x), 32)] for x in row["nodes"]]
    return backward(levels, row["suffix"])


def descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The blocks of the first round with ``suffix``, their path, and the other columns of ``tops``, which has a row
    (tree, suffix, ...) for each tree."""
    more = [c for c in tops.columns if c not in ("tree", "suffix")]

    def run(batches):
        for batch in batches:
            for row, i in zip(batch.to_pylist(), range(batch.num_rows), strict=True):
                paths = _paths(row)
                at = pa.array(np.full(len(paths), i))
                yield pa.RecordBatch.from_arrays([batch["tree"].take(at), pa.array(row["ids"], pa.int64()), pa.array(paths, pa.binary()), *[batch[c].take(at) for c in more]], names=["tree", "index", "suffix", *more])

    known = tops.withColumn("index", F.lit(0).cast("long"))
    schema = "tree string, index long, suffix binary" + "".join(f", {c} binary" for c in more)
    for blocks in reversed(rounds[1:]):
        known = common.stage(blocks.select("tree", "index", "nodes", "ids").join(known, ["tree", "index"]).mapInArrow(run, schema), "suffixes")
    return rounds[0].join(known, ["tree", "index"])


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, found: dict[str, Column] | None = None, paths: bool = True) -> DataFrame:
    """Each row's leaf, the roots above it, its proof, and whether what is found now still leads to the root.

    A row is a leaf: the digest of its ``fields`` (see ``leaf_digest``). Per lang, leaves are ordered by doc_id; runs
    of two become one node, an odd last one a node of its own, until one is left, the subroot (a lone leaf itself).
    Subroots ordered by lang (a missing one first, then by UTF-8 bytes) lead to the root likewise. ``found`` has
    columns as they are found at the time of checking, by name; without it all rows are as they were.

    Gives (doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified, path). proof_sha256 is the digest of
    the siblings' hex text from the leaf to the root; folded_root is what the found row leads to over the original
    path, verified whether that is the root. path is null unless ``paths``; ``steps`` reads it. A missing doc_id comes before all
    others; rows that share lang and doc_id are ordered by their leaf, equal ones in no set order. An empty table
    gives no rows. Columns outside ``fields`` are not read.
    """
    was = {c: F.col(f"`{c}`") for c in fields}
    now = {**was, **(found or {})}
    leaf = leaf_digest(list(was.values()))
    changed = reduce(lambda a, b: a | b, [~now[c].eqNullSafe(was[c]) for c in fields if c in (found or {})], F.lit(False))
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("id"), F.unhex(leaf).alias("digest"), F.when(changed, F.unhex(leaf_digest(list(now.values())))).alias("found"))
    leaves = placed(common.stage(rows, "leaves"), "tree", ["id", "digest"], "sorted")
    rounds = climb(leaves, "lang")
    subroots = rounds[-1].select("tree", "digest")
    above = placed(common.stage(subroots.select(F.lit("").alias("all"), F.col("tree").alias("name"), "digest"), "subroots"), "all", ["name"], "ranked")
    named = common.stage(above, "named")
    over = climb(named.select(F.col("all").alias("tree"), "index", "size", "digest", F.col("index").alias("id"), F.lit(None).cast("binary").alias("found")), "dataset")
    root = over[-1].select("tree", F.lit(b"").alias("suffix"), F.col("digest").alias("root"))

    def top_paths(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = _paths(row)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(out, pa.binary()), pa.array([row["root"]] * len(out), pa.binary())], names=["index", "suffix", "root"])

    tops = descend(over, root).select("nodes", "ids", "suffix", "root").mapInArrow(top_paths, "index long, suffix binary, root binary")
    tops = common.stage(tops.join(named.select("index", F.col("name").alias("tree"), F.col("digest").alias("subroot")), "index").select("tree", "suffix", "subroot", "root"), "tops")

    def prove(batches):
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                paths_, leaves_ = _paths(row), [row["nodes"][0][k : k + 32] for k in range(0, len(row["nodes"][0]), 32)]
                proofs = [hashlib.sha256(b"".join(x.hex().encode() for _, x in steps(p))).hexdigest() for p in paths_]
                folded = [fold(new or old, p) for new, old, p in zip(row["found"], leaves_, paths_, strict=True)]
                n = len(paths_)
                text = lambda values: pa.array([x.hex() for x in values], pa.string())
                cols = [pa.array(row["ids"], pa.int64()), batch["tree"].take(pa.array(np.full(n, i))), text(leaves_), text([row["subroot"]] * n), text([row["root"]] * n), pa.array(proofs), text(folded), pa.array([x == row["root"] for x in folded]), pa.array(paths_, pa.binary()) if paths else pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "tree", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "path"])

    proved = descend(rounds, tops).select("tree", "nodes", "ids", "found", "suffix", "subroot", "root").mapInArrow(prove, "doc_id long, tree string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, path binary")
    return proved.select("doc_id", F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1)).alias("lang"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "path")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``, checked against a table in which n_chars is one too many in every seventh row by crc32."""
    tampered = F.col("n_chars") + F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)
    return manifest(common.documents(spark, sf_dir), found={"n_chars": tampered}, paths=False).drop("path", "lang")


#: Levels by recursion, siblings by their place; crc32 of the decimal doc_id bit by bit.
OP11_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, n_chars, text,
  coalesce(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x // 2, (x % 2) * 3988292384))), 0) AS inverted FROM documents),
f AS (SELECT r, doc_id, lang, inverted IS NOT NULL AND doc_id IS NOT NULL AND xor(inverted, 4294967295) % 7 = 0 AND n_chars IS NOT NULL AS tampered,
  list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text], lambda v: CASE WHEN v IS NULL THEN '-' ELSE octet_length(encode(v)) || ':' || v END) AS was,
  list_transform([doc_id::VARCHAR, source, lang, (n_chars + 1)::VARCHAR, text], lambda v: CASE WHEN v IS NULL THEN '-' ELSE octet_length(encode(v)) || ':' || v END) AS now FROM d),
e AS MATERIALIZED (SELECT r, doc_id, lang, sha256(array_to_string(was, '')) AS leaf, CASE WHEN tampered THEN sha256(array_to_string(now, '')) END AS found FROM f),
p AS MATERIALIZED (SELECT r, doc_id, coalesce('=' || lang, '') AS tree, leaf, coalesce(found, leaf) AS found, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM e),
t AS (SELECT 0 AS l, tree, i, n, leaf AS h FROM p
  UNION ALL SELECT l, tree, i, n, h FROM (SELECT l + 1 AS l, tree, i // 2 AS i, (n + 1) // 2 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM t WHERE n > 1 GROUP BY l, tree, i // 2, n)),
s AS MATERIALIZED (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
g AS (SELECT 0 AS l, i, n, subroot AS h FROM s
  UNION ALL SELECT l, i, n, h FROM (SELECT l + 1 AS l, i // 2 AS i, (n + 1) // 2 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM g WHERE n > 1 GROUP BY l, i // 2, n)),
a AS (SELECT p.r, t.l AS step, (p.i >> t.l) % 2 = 1 AS odd, x.h AS other FROM p JOIN t ON t.tree = p.tree AND t.i = p.i >> t.l AND t.n > 1 LEFT JOIN t x ON x.tree = t.tree AND x.l = t.l AND x.i = xor(t.i, 1)
  UNION ALL SELECT p.r, 1000 + g.l, (s.i >> g.l) % 2 = 1, x.h FROM p JOIN s USING (tree) JOIN g ON g.i = s.i >> g.l AND g.n > 1 LEFT JOIN g x ON x.l = g.l AND x.i = xor(g.i, 1)),
q AS MATERIALIZED (SELECT r, step, odd, other, row_number() OVER (PARTITION BY r ORDER BY step) AS k FROM a),
o AS (SELECT r, 0::BIGINT AS k, found AS h FROM p
  UNION ALL SELECT q.r, q.k, sha256(CASE WHEN other IS NULL THEN h WHEN odd THEN other || h ELSE h || other END) FROM o JOIN q ON q.r = o.r AND q.k = o.k + 1),
z AS (SELECT r, arg_max(h, k) AS folded_root FROM o GROUP BY r),
w AS (SELECT r, string_agg(other, '' ORDER BY k) AS proof FROM q GROUP BY r)
SELECT doc_id, leaf, subroot, h AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = h AS verified
FROM p JOIN s USING (tree) JOIN z USING (r) LEFT JOIN w USING (r), (SELECT h FROM g WHERE n = 1)
"""
