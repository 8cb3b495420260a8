"""Merging of keyed records: guarded upserts, and merges of document families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.resolve import disagree


def upsert_violations(target: DataFrame, source: DataFrame, key: str, version: str, compare: list[str]) -> DataFrame:
    """(rule, key): repeated keys on either side, and equal versions that differ in a compared column."""
    cols = [c for c in compare if c not in (key, version)]
    both = target.select(key, version, *cols, F.lit(True).alias("__old")).unionByName(source.select(key, version, *cols, F.lit(False).alias("__old")))
    differ = disagree(tuple(cols)) if cols else F.lit(False)
    old, new = F.count_if(F.expr("__old")).alias("__olds"), F.count_if(F.expr("not __old")).alias("__news")
    each = both.groupBy(key, version).agg(old, new, differ.alias("__differ"))  # counts and bounds: no row is sorted or joined
    clash = F.expr("__olds > 0 and __news > 0 and __differ") & F.col(key).isNotNull() & F.col(version).isNotNull()
    keys = each.groupBy(key).agg(F.sum("__olds").alias("__olds"), F.sum("__news").alias("__news"), F.bool_or(clash).alias("__clash"))
    found = {"duplicate_target_key": "__olds > 1", "duplicate_source_key": "__news > 1", "equal_version_disagrees": "__clash"}
    rules = F.array_compact(F.array(*[F.when(F.expr(test), F.lit(rule)) for rule, test in found.items()]))
    return keys.select(F.explode(rules).alias("rule"), key)


def guarded_upsert(target: DataFrame, source: DataFrame, key: str, version: str, compare: list[str], strict: bool = True) -> DataFrame:
    """The target with absent keys inserted and rows of strictly higher version replaced; nothing is deleted.

    Older and identical source rows change nothing. Violations are found before anything is built; with
    ``strict`` they raise, otherwise ask ``upsert_violations`` first.
    """
    if strict and (bad := upsert_violations(target, source, key, version, compare).head(1)):
        raise ValueError(f"upsert refused: {bad[0]['rule']} at {bad[0][key]}")
    cols = [c for c in target.columns if c != key]
    t = target.select(key, F.struct(*cols).alias("t"))
    s = source.select(key, F.struct(*cols).alias("s"))
    take = F.col("t").isNull() | (F.col(f"s.{version}") > F.col(f"t.{version}"))
    chosen = F.when(F.coalesce(take & F.col("s").isNotNull(), F.lit(False)), F.col("s")).otherwise(F.col("t"))
    return t.join(s, key, "full_outer").select(key, chosen.alias("r")).select(key, "r.*").select(*target.columns)


def apply_resolved(target: DataFrame, source: DataFrame, key: str, version: str, quantities: list[str], strict: bool = True) -> DataFrame:
    """``guarded_upsert`` of resolved rows: rows of one version agree if their quantities do, whatever else they carry.

    The target's row stays then; ``source`` must have the target's columns.
    """
    return guarded_upsert(target, source, key, version, quantities, strict)


def sequence_conflicts(rows: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Ids of immutable records that come with different payloads."""
    text = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})
    return rows.groupBy(key).agg((F.min(text) < F.max(text)).alias("differs")).filter("differs").select(key)


def merge_immutable(rows: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """The union by id, ids with contradictory payloads left out (``sequence_conflicts`` names them)."""
    return rows.select(key, *payload).distinct().join(sequence_conflicts(rows, key, payload), key, "left_anti")


def merge_latest(rows: DataFrame, key: str, updated: str, payload: list[str]) -> DataFrame:
    """The record last updated for each key; ties go to the larger serialized record."""
    record = F.struct(updated, *payload)
    order = F.struct(F.col(updated), F.to_json(record, {"ignoreNullFields": "false"}))
    return rows.groupBy(key).agg(F.max_by(record, order).alias("r")).select(key, "r.*")


def merge_divergent(rows: DataFrame, key: str, updated: str, text: str) -> DataFrame:
    """(id, text, updated): the newest text keeps the id, every other text stays under an id made from its content.

    Merging the result with the same input again changes nothing.
    """
    newest = rows.groupBy(key, text).agg(F.max(updated).alias(updated))
    top = newest.groupBy(key).agg(F.max(F.struct(updated, text)).alias("top"))
    joined = newest.join(top, key)
    conflict = F.concat(F.col(key).cast("string"), F.lit("-conflict-"), F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 12))
    own = F.col("top").eqNullSafe(F.struct(updated, text))
    return joined.select(F.when(own, F.col(key).cast("string")).otherwise(conflict).alias("id"), F.col(text).alias("text"), F.col(updated).alias("updated"))


def import_preview(families: dict[str, DataFrame], current: dict[str, DataFrame], key: str, text: str, refs: dict[str, list[str]], known: DataFrame) -> DataFrame:
    """(family, rows, divergent, unknown_refs) of an import, before anything is applied."""
    parts = []
    for name, rows in families.items():
        now = current[name].select(key, F.col(text).alias("__now"))
        divergent = rows.join(now, key).agg(F.count_if(~F.col(text).eqNullSafe(F.col("__now"))).alias("divergent"))
        named = [rows.select(F.col(c).cast("string").alias("ref")) for c in refs[name]]
        unknown = reduce(DataFrame.union, named).filter("ref is not null").distinct().join(known.select(F.col("id").cast("string").alias("ref")).distinct(), "ref", "left_anti")
        parts.append(rows.agg(F.lit(name).alias("family"), F.count("*").alias("rows")).crossJoin(divergent).crossJoin(unknown.agg(F.count("*").alias("unknown_refs"))))
    return reduce(DataFrame.unionByName, parts)


def frame_audit(frames: DataFrame, backup: str, part: str, data: str) -> DataFrame:
    """(backup, parts, bytes, status) of framed backups: ok, repeated_part, missing_part."""
    sums = frames.groupBy(backup).agg(F.count("*").alias("parts"), F.count_distinct(part).alias("different"), F.min(part).alias("low"), F.max(part).alias("high"), F.sum(F.octet_length(data)).alias("bytes"))
    status = F.when(F.col("parts") > F.col("different"), "repeated_part").when((F.col("low") != 0) | (F.col("high") != F.col("parts") - 1), "missing_part").otherwise("ok")
    return sums.select(backup, "parts", "bytes", status.alias("status"))


def rejoin_frames(frames: DataFrame, backup: str, part: str, data: str) -> DataFrame:
    """(backup, data): parts joined in order; a backup is one document, its parts fit a row."""
    parts = F.array_sort(F.collect_list(F.struct(part, data)))
    return frames.groupBy(backup).agg(F.array_join(F.transform(parts, lambda p: p[data]), "").alias("data"))


def state_sizes(before: DataFrame, after: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, bytes_before, bytes_after, status) of serialized state: growth above the budget is refused, old size is tolerated."""
    size = lambda df, name: df.groupBy(key).agg(F.sum(F.octet_length(F.to_json(F.struct(*[c for c in df.columns if c != key])))).alias(name))
    both = size(before, "bytes_before").join(size(after, "bytes_after"), key, "full_outer").na.fill(0, ["bytes_before", "bytes_after"])
    status = F.when(F.col("bytes_after") <= budget, "within").when(F.col("bytes_after") <= F.col("bytes_before"), "tolerated").otherwise("refused")
    return both.withColumn("status", status)
