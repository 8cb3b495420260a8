"""Views over the given tables that the registered queries share, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Members of one document on average, where a key's members are dealt out to several documents.
PART_ROWS = 10_000


def in_parts(rows: DataFrame, key: str, member: str) -> DataFrame:
    """``rows`` with ``part``: each key's members dealt out by a hash into parts of about PART_ROWS rows."""
    sizes = rows.groupBy(F.col(key).alias("__key")).agg(F.ceil(F.count("*") / PART_ROWS).alias("__parts"))
    return rows.join(sizes, F.col(key).eqNullSafe(F.col("__key"))).withColumn("part", F.pmod(F.xxhash64(member), F.col("__parts"))).drop("__parts", "__key")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inspection deliveries from ``lineitem``: real contradictions and invalid quantities occur."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey").alias("event_id"),
        F.col("l_orderkey").cast("string").alias("inspection_id"),
        F.col("l_linenumber").alias("version"),
        F.col("l_quantity").cast("int").alias("inspected_units"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("defective_units"),
    )


D1 = """d1 AS (SELECT l_orderkey || '-' || l_partkey AS event_id, l_orderkey::VARCHAR AS inspection_id, l_linenumber AS version,
  l_quantity::INT AS inspected_units, floor(l_discount * 100 + 0.5)::INT AS defective_units FROM lineitem)"""


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries with those of even orders sent twice; every business relation must stay the same."""
    once = deliveries(spark, sf_dir)
    return once.unionByName(once.filter(F.col("inspection_id").cast("long") % 2 == 0))


D1R = D1 + ", d1r AS (SELECT * FROM d1 UNION ALL SELECT * FROM d1 WHERE inspection_id::BIGINT % 2 = 0)"

_TOTAL = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries with an arrival number per key and event order: a total order of the source rows in each key."""
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_TOTAL)).cast("long")
    numbered = table(spark, sf_dir, "lineitem").withColumn("arrival_seq", F.col("l_orderkey") * 1000 + seq)
    return numbered.select(
        F.concat_ws("-", "l_orderkey", "l_partkey").alias("event_id"),
        F.col("l_orderkey").cast("string").alias("inspection_id"),
        F.col("l_linenumber").alias("version"),
        F.col("l_quantity").cast("int").alias("inspected_units"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("defective_units"),
        "arrival_seq",
    )


D1A = f"""d1a AS (SELECT l_orderkey || '-' || l_partkey AS event_id, l_orderkey::VARCHAR AS inspection_id, l_linenumber AS version,
  l_quantity::INT AS inspected_units, floor(l_discount * 100 + 0.5)::INT AS defective_units,
  l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_TOTAL)}) AS arrival_seq FROM lineitem)"""


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries without invalid rows or contradictions: versions count the lines of an order."""
    version = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_TOTAL))
    rows = table(spark, sf_dir, "lineitem").withColumn("version", version)
    return rows.select(
        F.concat_ws("-", "l_orderkey", "version").alias("event_id"),
        F.col("l_orderkey").cast("string").alias("inspection_id"),
        "version",
        F.col("l_quantity").cast("int").alias("inspected_units"),
        F.least(F.floor(F.col("l_discount") * 100 + 0.5).cast("int"), F.col("l_quantity").cast("int")).alias("defective_units"),
    )


D1C = f"""d1c AS (SELECT l_orderkey || '-' || version AS event_id, l_orderkey::VARCHAR AS inspection_id, version::INT AS version,
  l_quantity::INT AS inspected_units, least(floor(l_discount * 100 + 0.5)::INT, l_quantity::INT) AS defective_units
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_TOTAL)}) AS version FROM lineitem))"""


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-line events: revisions of (order, line), returned lines as cancellations."""
    revision = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*_TOTAL[1:])).cast("long")
    cancelled = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_linenumber").cast("string").alias("line_id"),
        revision.alias("revision"),
        F.when(cancelled, 0).otherwise(F.col("l_quantity").cast("long")).cast("long").alias("quantity"),
        F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("unit_cents"),
        F.when(cancelled, "cancel").otherwise("upsert").alias("operation"),
    )


D2 = f"""d2 AS (SELECT l_orderkey::VARCHAR AS order_id, l_linenumber::VARCHAR AS line_id,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_TOTAL[1:])}) AS revision,
  CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity::BIGINT END AS quantity, floor(l_extendedprice * 100 + 0.5)::BIGINT AS unit_cents,
  CASE WHEN l_returnflag = 'R' THEN 'cancel' ELSE 'upsert' END AS operation FROM lineitem)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card reviews from ``events``: five cards per learner, ratings by event type; sign-ups are extra practice."""
    card = F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(5))
    rating = F.when(F.col("event_type") == "error", "Again").when(F.col("event_type") == "click", "Hard").when(F.col("event_type") == "view", "Good").when(F.col("event_type") == "purchase", "Easy")
    return table(spark, sf_dir, "events").filter("event_type <> 'signup'").select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").alias("learner_id"), card.alias("card_id"), rating.alias("rating"), F.col("ts").alias("at"))


D3 = """d3 AS (SELECT event_id, user_id AS learner_id, json_extract(props, '$.k')::INT % 5 AS card_id,
  CASE event_type WHEN 'error' THEN 'Again' WHEN 'click' THEN 'Hard' WHEN 'view' THEN 'Good' WHEN 'purchase' THEN 'Easy' END AS rating, ts AS at
  FROM events WHERE event_type <> 'signup')"""
