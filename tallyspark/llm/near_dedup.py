"""MinHash near-duplicate groups (operator 10).

1. One Arrow pass hashes each document's word shingles and takes 144 universal-hash minima. It emits 36
   band keys of four minima each, and one bit of each minimum as a 144-bit signature.
2. Documents with equal shingle sets form a class; a class is one node, whatever the doc_ids in it, and its
   first row by (doc_id, hash of the text) gives the text that it is confirmed on.
3. Documents that share a band key are candidates. In a bucket each document is paired with the *hub*, its
   smallest node, never all with all. Pairs whose signatures disagree too much go.
4. What is left is confirmed on full shingle sets: first one pair per document, then those of the others
   that are not yet in one component. Components come from alternating large-star and small-star.
5. A bucket whose members are then in one component is done. In the others most members are in one main
   component, and the rest are outliers of it. Outliers are compared with all documents of the buckets of
   that main component on full shingle sets, block against block inside tasks, so that no link between a
   document and any other than its hub is lost and no pairs are written out.

With bands of four minima, a pair at similarity 0.75 is missed by all 36 with probability 1.1e-6, and a
signature rejects a pair at 0.75 with about 3e-7 (it asks for five standard deviations below).

From step 3 on, ``doc`` is a node.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import common, tokens

U = np.uint64
SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 36, 4
MINIMA = BANDS * ROWS

#: Least number of equal bits of 144: 126 expected at similarity 0.75, less five standard deviations.
LEAST_BITS = 106

#: Shingle hashes in a block that outliers are compared in, on average.
BLOCK_HASHES = 32_000

#: Universal hashing: (a x + b) mod 2**64, high bits, a odd. Fixed by a seed.
_AB = np.random.default_rng(20250).integers(0, 2**64, (2, MINIMA), dtype=U)
_A, _B = _AB[0] | U(1), _AB[1]


def shingles(buf: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the runs of five folded words; of the whole sequence where there are fewer."""
    words = tokens.word_hashes(buf, fold=True)
    if not words.size:
        return words
    start = np.arange(max(1, words.size - SHINGLE + 1))
    return np.unique(tokens.ranges(tokens.prefix(words), start, np.minimum(start + SHINGLE, words.size)))


def minima(hashes: np.ndarray) -> np.ndarray:
    low = np.full(MINIMA, np.iinfo(U).max, U)
    for at in range(0, hashes.size, 128):
        np.minimum(low, (hashes[at : at + 128, None] * _A + _B).min(axis=0), out=low)
    return low >> U(32)


def features(docs: DataFrame) -> DataFrame:
    """(id, tie, n, set, s0..s2, bands) of (id, tie, body) rows; no bands where the set is empty."""

    def run(batches):
        for batch in common.slices(batches, "body"):
            out = []
            for buf in tokens.rows_of(batch.column(2)):
                hashes = shingles(buf)
                low = minima(hashes)
                bits = np.zeros(192, np.uint8)
                bits[:MINIMA] = low & U(1)
                sketch = np.packbits(bits).view(np.int64)
                bands = tokens.ranges(tokens.prefix(tokens.mix(low)), np.arange(0, MINIMA, ROWS), np.arange(ROWS, MINIMA + 1, ROWS))
                bands = tokens.mix(bands + np.arange(BANDS, dtype=U)).view(np.int64).tolist() if hashes.size else []
                out.append((hashes.size, hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), *sketch.tolist(), bands))
            if out:
                types = (pa.int64(), pa.binary(), *[pa.int64()] * 3, pa.list_(pa.int64()))
                cols = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["id", "tie", "n", "set", "s0", "s1", "s2", "bands"])

    return docs.mapInArrow(run, "id long, tie long, n long, set binary, s0 long, s1 long, s2 long, bands array<long>")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (hub, doc) pairs with 100 * intersection >= 75 * union on full shingle sets."""

    def run(batches):
        known: dict = {}
        for batch in batches:
            hub, doc = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked = []
            for i, (a, b, x, y) in enumerate(zip(hub, doc, tokens.rows_of(batch.column(2)), tokens.rows_of(batch.column(3)), strict=True)):
                if a not in known:
                    known = {a: shingles(x)}
                p, q = known[a], shingles(y)
                both = np.intersect1d(p, q, assume_unique=True).size
                if both and 100 * both >= PERCENT * (p.size + q.size - both):
                    linked.append(i)
            if linked:
                yield batch.select([0, 1]).take(pa.array(linked))

    sides = pairs.join(texts.select(F.col("doc"), F.col("body").alias("b")), "doc").join(texts.select(F.col("doc").alias("hub"), F.col("body").alias("a")), "hub")
    return sides.select("hub", "doc", "a", "b").mapInArrow(run, "hub long, doc long")


def _stars(edges: DataFrame) -> bool:
    """Whether each node stands left in one edge at most, and then never right: all edges point to their root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("left"), F.lit(0).alias("right")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("left").alias("left"), F.max("right").alias("right")).filter((F.col("left") > 1) | ((F.col("left") > 0) & (F.col("right") > 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over (u, v) edges, for nodes with an edge; by alternating
    large-star and small-star until only stars are left."""
    now = common.stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    while not _stars(now):
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.stage(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = common.stage(moved.union(least).distinct(), "small")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _apart(pairs: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Pairs whose sides are not known to be in one component."""
    if comp is None:
        return pairs
    of = lambda side: comp.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    roots = pairs.join(of("hub"), "hub", "left").join(of("doc"), "doc", "left")
    return roots.filter(F.coalesce("hub_root", "hub") != F.coalesce("doc_root", "doc")).select("hub", "doc")


def outlier_links(members: DataFrame, comp: DataFrame | None, texts: DataFrame) -> DataFrame:
    """Links (hub, doc) of documents outside the main component of a bucket of three or more, to any document of the
    buckets with that main component; exact, on full sets, a block of outliers against a block of documents."""
    rooted = members.select("bucket", "doc").withColumn("root", F.col("doc"))
    if comp is not None:
        rooted = members.select("bucket", "doc").join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    held = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mains = held.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("size"), F.count("*").alias("roots")).filter("roots > 1 and size > 2").select("bucket", "main")
    group = common.stage(rooted.join(mains, "bucket").select("main", "doc", "root").distinct(), "outliers")
    sets = group.join(texts, "doc").select("main", "doc", "root", "body", (F.octet_length("body") / 6).alias("weight"))
    sets = common.stage(sets, "members")
    sizes = sets.groupBy("main").agg(F.ceil(F.sum("weight") / BLOCK_HASHES).alias("all_blocks"), F.ceil(F.sum(F.when(F.col("root") != F.col("main"), F.col("weight"))) / BLOCK_HASHES).alias("out_blocks"))
    common.release(group)

    def pack(pdf):
        found = [shingles(np.frombuffer(b, np.uint8)) for b in pdf["body"]]
        return pdf[["main", "block", "all_blocks"]].head(1).rename(columns={"all_blocks": "blocks"}).assign(docs=pdf["doc"].to_numpy(np.int64).tobytes(), roots=pdf["root"].to_numpy(np.int64).tobytes(), sizes=np.array([x.size for x in found], np.int64).tobytes(), hashes=np.concatenate(found).tobytes())

    def packed(rows: DataFrame, blocks: str) -> DataFrame:
        block = F.pmod(F.xxhash64("doc"), F.greatest(F.col(blocks), F.lit(1))).alias("block")
        cut = rows.join(sizes, "main").select("main", block, "doc", "root", "body", "all_blocks")
        return cut.repartition("main", "block").groupBy("main", "block").applyInPandas(pack, "main long, block long, blocks long, docs binary, roots binary, sizes binary, hashes binary")

    def compare(batches):
        for batch in batches:
            hub, doc = [], []
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                y_docs, y_roots, y_sizes, m_docs, m_roots, m_sizes = (np.frombuffer(row[c], np.int64) for c in ("docs", "roots", "sizes", "m_docs", "m_roots", "m_sizes"))
                sets, pool = np.split(np.frombuffer(row["hashes"], U), np.cumsum(y_sizes)[:-1]), np.frombuffer(row["m_hashes"], U)
                starts = np.cumsum(m_sizes) - m_sizes
                for key, root, own in zip(y_docs.tolist(), y_roots.tolist(), sets, strict=True):
                    same = own[np.minimum(np.searchsorted(own, pool), own.size - 1)] == pool
                    both = np.add.reduceat(same, starts, dtype=np.int64)
                    linked = (m_roots != root) & (100 * both >= PERCENT * (own.size + m_sizes - both))
                    one_each = np.unique(m_roots[linked], return_index=True)[1]  # a link to a component is enough
                    for other in m_docs[linked][one_each].tolist():
                        hub.append(min(key, other))
                        doc.append(max(key, other))
            yield pa.RecordBatch.from_arrays([pa.array(hub, pa.int64()), pa.array(doc, pa.int64())], names=["hub", "doc"])

    out = common.stage(packed(sets.filter("root <> main"), "out_blocks"), "outlier-blocks")
    every = common.stage(packed(sets, "all_blocks").select("main", F.col("block").alias("m_block"), *[F.col(c).alias(f"m_{c}") for c in ("docs", "roots", "sizes", "hashes")]), "member-blocks")
    # Pairs of blocks, not components, are dealt out: a component of any size is shared by many tasks.
    pairs = out.withColumn("m_block", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("blocks", F.lit(1)) - 1)))
    found = common.stage(pairs.join(every, ["main", "m_block"]).mapInArrow(compare, "hub long, doc long"), "outlier-links")
    common.release(sets, out, every)
    return found


def linked_components(sketches: DataFrame, bands: DataFrame, names: DataFrame, bodies: DataFrame) -> DataFrame | None:
    """(node, root) over all confirmed links of classes; None where there is no link. names: (doc, id, tie), which
    of the (id, tie, body) rows has a node's text."""
    busy = common.stage(bands.groupBy("bucket").agg(F.min("doc").alias("hub"), F.max("doc").alias("far")).filter("hub < far").select("bucket", "hub"), "busy")
    members = common.stage(bands.join(busy, "bucket"), "members")
    wanted = names.join(members.select("doc").distinct(), "doc", "left_semi")
    texts = common.stage(bodies.join(wanted, ["id", "tie"]).select("doc", "body").dropDuplicates(["doc"]), "texts")
    one = common.stage(sketches.join(members.select("doc").distinct(), "doc", "left_semi"), "sketches")
    common.release(busy)
    agree = 192 - reduce(lambda a, b: a + b, [F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))) for i in range(3)]) - (192 - MINIMA)
    links, comp, made = [], None, members.filter("doc > hub").select("hub", "doc").distinct()
    near = made.join(one.select(F.col("doc").alias("hub"), *[F.col(f"s{i}").alias(f"t{i}") for i in range(3)], F.col("n").alias("hub_n")), "hub").join(one, "doc")
    alike = (agree >= LEAST_BITS) & (100 * F.least("n", "hub_n") >= PERCENT * F.greatest("n", "hub_n"))
    turn = F.row_number().over(Window.partitionBy("doc").orderBy("hub"))
    pending = common.stage(near.filter(alike).select("hub", "doc").withColumn("turn", turn), "pairs")
    for chosen in (F.col("turn") == 1, F.col("turn") > 1):
        fresh = common.stage(confirm(_apart(pending.filter(chosen).select("hub", "doc"), comp), texts), "links")
        if not fresh.isEmpty():
            links.append(fresh)
            comp = components(reduce(DataFrame.union, links).toDF("u", "v"))
    rest = outlier_links(members, comp, texts)
    if rest.isEmpty():
        return comp
    return components(reduce(DataFrame.union, [*links, rest]).toDF("u", "v"))


def keys() -> tuple[Column, Column]:
    """(id, tie) of a row: its doc_id, a missing one as NO_ID, and a 64-bit hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NO_ID)), F.xxhash64(common.whole_text())


def near_groups(docs: DataFrame) -> DataFrame:
    """(id, tie, n_shingles, component, stays) of each row: component is the smallest known id of the row's group, and
    stays is true in one row of the group, its first by (id, tie), rows with an id before others."""
    id_, tie = keys()
    keyed = docs.select(id_.alias("id"), tie.alias("tie"), common.whole_text().cast("binary").alias("body"))
    rows = common.stage(features(keyed).withColumn("row", F.monotonically_increasing_id()), "features")
    place = F.struct((F.col("id") == common.NO_ID).alias("unnamed"), "id", "tie", "row")
    sketch = ("n", "s0", "s1", "s2", "bands")  # the same in all rows of a class
    classes = rows.filter("n > 0").groupBy("set").agg(F.min(place).alias("head"), *[F.first(c).alias(c) for c in sketch])
    classes = common.stage(classes.withColumn("doc", F.monotonically_increasing_id()), "classes")
    comp = linked_components(classes.select("doc", *sketch[:-1]), classes.select("doc", F.explode("bands").alias("bucket")), classes.select("doc", "head.id", "head.tie"), keyed)
    heads = classes.select("set", "head")
    if comp is not None:
        rooted = classes.select("set", "doc", "head").join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
        heads = rooted.select("set", "root").join(rooted.groupBy("root").agg(F.min("head").alias("head")), "root").drop("root")
    found = rows.select("id", "tie", "row", "n", "set").join(heads, "set", "left").withColumn("head", F.coalesce("head", place))
    return found.select("id", "tie", F.col("n").alias("n_shingles"), F.col("head.id").alias("component"), (F.col("row") == F.col("head.row")).alias("stays"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """For each row: (doc_id, n_shingles, component_id, kept).

    Words are lower-cased in A-Z; a document's set holds its distinct five-word shingles, with fewer words
    the whole sequence. A document without words is linked with nothing. component_id is the smallest
    doc_id reachable over links of similarity 0.75 or more; missing ones do not count, and a group of rows
    that all miss it has a missing component_id. kept says whether doc_id and component_id are the same, also
    where both are missing; rows that share a group's smallest doc_id are all kept. Each row is a document of
    its own, also among rows with a missing doc_id or with the same one: two such rows are in one group if
    links lead from one text to the other. An empty table gives no rows. Other columns are not read.
    """
    known = lambda c: F.nullif(F.col(c), F.lit(common.NO_ID))
    same = F.col("id") == F.col("component")
    return near_groups(docs).select(known("id").alias("doc_id"), "n_shingles", known("component").alias("component_id"), same.alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of ``docs``, all columns as they are: of those with its smallest doc_id (a missing one
    only where all are missing) the one whose text has the smallest hash.

    Rows equal in doc_id and text differ in other columns only; a hash of these tells which one stays. An
    empty table stays empty.
    """
    id_, tie = keys()
    wordy = common.whole_text().rlike(r"[^\x20\x09-\x0D]")  # rows without words are linked with nothing
    stay = near_groups(docs).filter("stays and n_shingles > 0").select(F.col("id").alias("__id"), F.col("tie").alias("__tie"))
    chosen = docs.filter(wordy).withColumns({"__id": id_, "__tie": tie}).join(stay, ["__id", "__tie"], "left_semi")
    rest = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    turn = F.row_number().over(Window.partitionBy("__id", "__tie").orderBy(F.xxhash64(*rest)))
    return chosen.withColumn("__turn", turn).filter("__turn = 1").select(docs.columns).union(docs.filter(~wordy))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(common.documents(spark, sf_dir))


#: Exact intersections of all shingle sets that share a shingle, and what links reach.
OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{common.WORD}') AS w FROM documents),
x AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[s:s + 4], ' ') AS k FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM x GROUP BY r),
p AS (SELECT a.r AS u, b.r AS v, count(*) AS shared FROM x a JOIN x b USING (k) WHERE a.r < b.r GROUP BY ALL),
l AS MATERIALIZED (SELECT u, v FROM p JOIN n a ON a.r = u JOIN n b ON b.r = v WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
y AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
t AS (SELECT r AS node, r AS other FROM d UNION SELECT node, v FROM t JOIN y ON other = u),
m AS (SELECT node, min(doc_id) AS component_id FROM t JOIN d ON d.r = other GROUP BY node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN m ON node = r LEFT JOIN n USING (r)
"""
