"""Approximate nearest neighbours by robust-pruned graphs (operator 8).

Different vectors are dealt out to shards of bounded size by a hash. Each shard builds its graph; every
query block is beam-searched in each shard, candidates get their exact cosine, and the best of all shards
are kept. Equal vectors are one node that carries the few smallest ids an answer can need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import common, graph_index

TOP = 5
EVERY = 50
SHARD_VECTORS = 10_000
QUERY_BLOCK = 1024
SEARCH_BEAM = 96


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of rows with an id and a vector of finite numbers that are not all 0, as doubles."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column) -> np.ndarray:
    return np.array(column.to_list() if hasattr(column, "to_list") else column.to_pylist(), np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def build_shards(nodes: DataFrame, n_shards: int) -> DataFrame:
    """A row for each shard and dimension: its vectors, the ids of each, the graph and its entry."""

    def run(pdf):
        vectors = _matrix(pdf["v"])
        graph, entry = graph_index.build(_unit(vectors).astype(np.float32))
        ids = np.full((len(pdf), TOP + 1), graph_index.NONE)
        real = np.zeros((len(pdf), TOP + 1), bool)
        for i, x in enumerate(pdf["ids"]):
            ids[i, : len(x)], real[i, : len(x)] = x, True
        return pdf[["shard", "dim"]].head(1).assign(vectors=vectors.tobytes(), ids=ids.tobytes(), held=real.tobytes(), graph=graph.tobytes(), entry=entry)

    shard = F.pmod(F.xxhash64("v"), F.lit(n_shards)).cast("int").alias("shard")
    return nodes.select(shard, F.size("v").alias("dim"), "v", "ids").repartition(n_shards, "shard", "dim").groupBy("shard", "dim").applyInPandas(run, "shard int, dim int, vectors binary, ids binary, held binary, graph binary, entry int")


def _shard(row: dict):
    vectors = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
    n = vectors.shape[0]
    return vectors, _unit(vectors).astype(np.float32), np.frombuffer(row["ids"], np.int64).reshape(n, -1), np.frombuffer(row["held"], bool).reshape(n, -1), np.frombuffer(row["graph"], np.int32).reshape(n, -1), row["entry"]


def search(shards: DataFrame, blocks: DataFrame, n_shards: int, top: int, beam: int) -> DataFrame:
    """(query_id, vec_id, score): each query's ``top`` nearest found in each shard, without its own id.

    Every block goes to every shard by one shuffle, in which a shard's row comes before its blocks: a task loads a shard once
    and takes the blocks as they come. It is no join, for equal blocks look small in files and would be broadcast in full.
    """

    def run(batches):
        at, shard = None, None
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # a row holds a whole shard, or a block
                if row["graph"] is not None:
                    at, shard = (row["shard"], row["dim"]), _shard(row)
                    continue
                if at != (row["shard"], row["dim"]):  # no vectors of this dimension there
                    continue
                vectors, points, ids, held, graph, entry = shard
                asked = np.frombuffer(row["asked"]).reshape(-1, row["dim"])
                query_ids = np.frombuffer(row["query_ids"], np.int64)
                out = []
                for first in range(0, asked.shape[0], graph_index.BATCH):
                    x, own = asked[first : first + graph_index.BATCH], query_ids[first : first + graph_index.BATCH]
                    found, _ = graph_index.beam_search(points, graph, entry, _unit(x).astype(np.float32), beam)
                    for q, f, key in zip(x, found, own.tolist(), strict=True):
                        f = f[f >= 0]
                        near = vectors[f]
                        score = (near * q).sum(axis=1) / (np.sqrt((near * near).sum(axis=1)) * np.sqrt((q * q).sum()))
                        cand, of = ids[f], np.repeat(score, ids.shape[1]).reshape(-1, ids.shape[1])
                        use = held[f] & (cand != key)
                        cand, of = cand[use], of[use]
                        best = np.lexsort((cand, -of))[:top]
                        out.append((np.full(best.size, key), cand[best], of[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    each = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    both = shards.unionByName(each, allowMissingColumns=True).repartition(n_shards, "shard", "dim")
    return both.sortWithinPartitions("shard", "dim", F.col("graph").isNull()).mapInArrow(run, "query_id long, vec_id long, score double")


def query_blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> DataFrame:
    """Queries packed in blocks: the stated query set meets all rows block by block."""

    def run(pdf):
        return pdf[["dim"]].head(1).assign(query_ids=pdf["vec_id"].to_numpy(np.int64).tobytes(), asked=_matrix(pdf["v"]).tobytes())

    n_blocks = max(1, -(-queries.count() // size))
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).alias("block")
    return queries.select("vec_id", "v", F.size("v").alias("dim"), block).groupBy("dim", "block").applyInPandas(run, "dim int, query_ids binary, asked binary")


def nearest(rows: DataFrame, vector: str = "embedding", top: int = TOP, every: int = EVERY, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id ``every`` divides, its ``top`` nearest other rows
    by cosine of the original vectors in double precision, ties to the smaller vec_id.

    Rows without an id, and vectors that are missing, all 0, or hold a missing or non-finite component take
    no part; vectors of another dimension than the query's are no candidates. Rows that repeat a vec_id are
    one candidate, and one query answered by their best candidates. Other columns are not read. An empty
    table gives no rows.
    """
    valid = common.stage(usable(rows, vector).dropDuplicates(["vec_id", "v"]), "vectors")
    turn = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = valid.withColumn("turn", turn).filter(F.col("turn") <= top + 1)
    nodes = common.stage(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "nodes")
    n_shards = max(1, -(-nodes.count() // SHARD_VECTORS))
    shards = common.stage(build_shards(nodes, n_shards), "shards")
    blocks = common.stage(query_blocks(valid.filter(F.col("vec_id") % every == 0)), "blocks")
    found = search(shards, blocks, n_shards, top, beam).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
