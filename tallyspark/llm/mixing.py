"""Mixing sources to target weights by systematic sampling (operator 2). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import common
from tallyspark.llm.numbering import numbered

#: Fixed values of the task: weights of the sources in order, repeating; most copies of a document.
WEIGHTS = (5, 2, 1)
MOST = 3

SEED = "mix-1"
_UNIT = 1 << 28


def size_class(size: Column) -> Column:
    """Eight classes per power of two, so that sizes in a class differ by an eighth at most."""
    bits = F.length(F.bin(size))
    return F.when(size < 8, size).otherwise(bits * 8 + F.expr("shiftright(size, length(bin(size)) - 4) & 7"))


def targets(sizes: DataFrame) -> DataFrame:
    """``target`` for rows (no_source, key, source_size): shares by weight of all words, none above MOST times
    its source; what that leaves over goes to the others by weight.

    With r = MOST * size / weight, sources are full in order of r; the rest share what is left. One row per
    source: both windows run over that small table.
    """
    place = F.row_number().over(Window.orderBy("no_source", "key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", (F.col("source_size") * MOST).cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "no_source", "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    share = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", F.when(share * F.col("weight") <= F.col("most"), share))
    # The first source that its share does not fill sets the level for itself and all after it.
    level = F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("target", F.when(level.isNull(), F.col("most")).otherwise(F.least(level * F.col("weight"), F.col("most")))).drop("weight", "most", "level")


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` (its source's words in the mix) and ``copies``.

    Expected copies of a document are target / source_size of its source. In each source, documents stand
    by size class and in it in pseudo-random order of doc_id; expected copies are summed up, one random
    offset is added, and a document is emitted once for each integer boundary its stretch crosses. Every
    run gives the same copies. Sources come in code-point order, a missing one last and a source of its
    own. A missing text has size 0; rows without a doc_id stand by a hash of their text, and rows equal in
    doc_id, size and text are interchangeable. A column of ``docs`` that is named like a new one is
    replaced, all others stay. An empty table gives no rows.
    """
    base = docs.drop("size", "source_size", "target", "copies")
    base = base.withColumns({"size": common.n_words(), "__no_source": F.col("source").isNull(), "__key": F.coalesce(F.col("source").cast("string"), F.lit(""))})
    base = base.withColumns({"__cell": size_class(F.col("size")), "__fine": common.order_hash(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5(common.whole_text())))})
    by_source = base.groupBy(F.col("__no_source").alias("no_source"), F.col("__key").alias("key")).agg(F.sum("size").alias("source_size"))
    known = common.stage(targets(by_source), "targets")
    ranked = numbered(base, ["__no_source", "__key"], "__cell", "__fine", ["size", F.xxhash64("text")])
    rows = ranked.join(known.withColumnsRenamed({"no_source": "__no_source", "key": "__key"}), ["__no_source", "__key"])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(each)
    part = F.floor((each - whole) * _UNIT).cast("long")
    offset = F.shiftright(common.order_hash(F.lit(seed), F.lit("offset"), F.col("__no_source").cast("string"), F.col("__key")), 32)
    crossed = F.shiftright(offset + (F.col("__rank") + 1) * part, 28) - F.shiftright(offset + F.col("__rank") * part, 28)
    return rows.withColumn("copies", whole + crossed).drop("__no_source", "__key", "__cell", "__fine", "__rank")


def emit(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, columns as they are. An empty table stays empty."""
    own = [c for c in ("doc_id", "source", "text") if c in docs.columns]
    rest = [c for c in docs.columns if c not in own]
    packed = docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__rest") if rest else F.lit(None).alias("__rest"))
    mixed = mix(packed, seed).filter("copies > 0")
    mixed = mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return mixed.select(*[F.col(c) if c in own else F.col(f"__rest.`{c}`").alias(c) for c in docs.columns])


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.documents(spark, sf_dir).select("doc_id", "source", "text")
    return mix(rows).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _hash_sql(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 15))::BIGINT"


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, text FROM documents),
s AS (SELECT no_source, key, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY no_source, key) - 1) % 3 + 1)::INT] AS weight, (source_size * 3)::DOUBLE AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS share
      FROM w WINDOW b AS (ORDER BY most / weight, no_source, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, first_value(CASE WHEN share * weight <= most THEN share END IGNORE NULLS) OVER (ORDER BY most / weight, no_source, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM l),
t AS (SELECT no_source, key, source_size, CASE WHEN level IS NULL THEN most ELSE least(level * weight, most) END AS target FROM v),
h AS (SELECT *, CASE WHEN size < 8 THEN size ELSE length(bin(size)) * 8 + ((size >> (length(bin(size)) - 4)) & 7) END AS cell,
             {_hash_sql(f"'{SEED}'", "coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))")} AS fine FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY no_source, key ORDER BY cell, fine, size) - 1 AS rank FROM h),
j AS (SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS each_,
             ({_hash_sql(f"'{SEED}'", "'offset'", "no_source::VARCHAR", "key")} >> 32) AS start_
      FROM r JOIN t USING (no_source, key)),
c AS (SELECT *, floor(each_)::BIGINT AS whole, floor((each_ - floor(each_)) * {_UNIT})::BIGINT AS part FROM j)
SELECT doc_id, size, source_size, target,
       (whole + ((start_ + (rank + 1) * part) >> 28) - ((start_ + rank * part) >> 28)) * size AS taken FROM c
"""
