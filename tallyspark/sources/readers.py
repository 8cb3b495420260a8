"""Readers with explicit schemas, and checks that keep what a reader would lose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIVERY = "event_id string, inspection_id string, version int, inspected_units int, defective_units int"


def json_typed(spark: SparkSession, path: str, schema: str = DELIVERY) -> DataFrame:
    """A JSON array of records under an explicit schema; what does not fit a type is null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_strict(raw: DataFrame, text: str, fields: list[str]) -> DataFrame:
    """Records given as JSON text with the token type of each field (``<field>_type``), so that "1", true, 1 and a
    missing field are told apart: BIGINT, STRING, BOOLEAN, ..., VOID for a JSON null, null where it is missing."""
    parsed = raw.withColumn("__v", F.try_parse_json(text))
    kinds = [F.schema_of_variant(F.try_variant_get("__v", f"$.{f}", "variant")).alias(f"{f}_type") for f in fields]
    return parsed.select(*raw.columns, *kinds)


def json_variants(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Records of JSON-lines files as one VARIANT column ``v``, with the token type of each field as in ``json_strict``; a
    line that is no JSON is kept in ``_corrupt_record``, with ``v`` missing."""
    rows = spark.read.option("singleVariantColumn", "v").schema("v variant, _corrupt_record string").json(path)
    return rows.select("v", *[F.schema_of_variant(F.try_variant_get("v", f"$.{f}", "variant")).alias(f"{f}_type") for f in fields], "_corrupt_record")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw text of JSON-lines files, for ``json_strict``."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def json_batches(spark: SparkSession, path: str, schema: str = DELIVERY) -> DataFrame:
    """A JSON object of named batches as rows with ``batch_id`` and the position in the batch."""
    fields = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in schema.split(", "))
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, array<struct<{fields}>>>").alias("b"))
    named = whole.select(F.explode("b").alias("batch_id", "rows"))
    return named.select("batch_id", F.posexplode("rows").alias("arrival_seq", "r")).select("batch_id", "arrival_seq", "r.*")


def csv_header(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header, all columns as text."""
    return spark.read.option("header", True).schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path)


def files_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of files; a file is one row, so it must fit in memory (the reader stops at 2 GB)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole Markdown files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_tree(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Nested JSON documents of a folder tree, with the file each came from."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path).withColumn("path", F.col("_metadata.file_path"))


def family(documents: DataFrame, state: str, name: str, record: T.StructType) -> DataFrame:
    """One family of exported learner documents: its map of id to record as rows (map_key, record columns)."""
    parsed = documents.select(F.from_json(F.get_json_object(state, f"$.state.{name}"), T.MapType(T.StringType(), record)).alias("m"))
    return parsed.select(F.explode("m").alias("map_key", "r")).select("map_key", "r.*")


def csv_line(line: Column, ddl: str) -> Column:
    """A CSV line held in a column as a struct."""
    return F.from_csv(line, ddl)
