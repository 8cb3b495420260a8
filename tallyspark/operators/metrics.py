"""Metrics with stated denominators, comparisons of runs, and features as of a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tallyspark.functions.iterate import cut

#: Of percentiles of large groups.
ACCURACY = 100_000


def over(order: list[str], by: list[str] | None = None) -> WindowSpec:
    """A window by columns, in an order such as ["a desc", "b"]."""
    keys = [F.desc(c[:-5]) if c.endswith(" desc") else F.asc(c) for c in order]
    return Window.partitionBy(*(by or [])).orderBy(*keys)


def plant_rows(lineitem: DataFrame) -> DataFrame:
    """Inspections with a plant and a business day, from order lines."""
    return lineitem.select(F.col("l_returnflag").alias("plant"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").cast("int").alias("inspected_units"), F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("defective_units"))


def metric_contract(rows: DataFrame) -> DataFrame:
    """Two defect metrics by plant and day, each with its own denominator; undefined (null) where that is 0."""
    units = F.try_divide(F.sum("defective_units").cast("double"), F.sum("inspected_units").cast("double"))
    inspections = F.try_divide(F.count_if(F.col("defective_units") > 0).cast("double"), F.count("*").cast("double"))
    return rows.groupBy("plant", "day").agg(units.alias("unit_defect_rate"), inspections.alias("inspections_with_defect"))


def tail_objective(rows: DataFrame, by: str, value: str, threshold: float, share: float) -> DataFrame:
    """Share under a threshold, median and tail percentile by group, and whether the objective is met.

    Percentiles are values of the group whose rank is off by 1/ACCURACY of the group at most (exact up to
    ACCURACY / 2 rows): a group of any size is summarised in bounded memory, on the map side already.
    """
    under = F.count_if(F.col(value) < threshold).cast("double") / F.count("*").cast("double")
    at = lambda p: F.percentile_approx(value, p, ACCURACY)
    return rows.groupBy(by).agg(under.alias("share_under"), at(0.5).alias("median"), at(share).alias("tail")).withColumn("met", F.col("share_under") >= share)


#: Items that a level of a stored sketch keeps: ranks are off by about 1/SKETCH of a group, and exact up to SKETCH rows.
SKETCH = 4096


def day_sketches(rows: DataFrame, by: str, day: str, value: str, threshold: float) -> DataFrame:
    """(by, day, n, under, sketch): what ``tail_of_days`` needs of a day, to be stored; new days are added to the old."""
    under = F.count_if(F.col(value) < threshold)
    return rows.groupBy(by, day).agg(F.count(value).alias("n"), under.alias("under"), F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH).alias("sketch"))


def tail_of_days(sketches: DataFrame, by: str, share: float) -> DataFrame:
    """The objective of ``tail_objective`` over any choice of stored days: sketches are merged, no row is read again.

    Days without a value count nothing; a group without any has no percentiles.
    """
    merged = sketches.filter("n > 0").groupBy(by).agg(F.sum("n").alias("n"), F.sum("under").alias("under"), F.kll_merge_agg_double("sketch", SKETCH).alias("sketch"))
    at = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    rows = merged.select(by, (F.col("under") / F.col("n")).alias("share_under"), at(0.5).alias("median"), at(share).alias("tail"))
    return rows.withColumn("met", F.col("share_under") >= share)


def latency_attribution(before: DataFrame, after: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """Change of the total between paired runs, split by part, and the part that changed most (ties: the first)."""
    b = before.select(key, *[F.col(p).alias(f"__{p}") for p in parts])
    deltas = after.join(b, key).select(key, *[(F.col(p) - F.col(f"__{p}")).alias(p) for p in parts])
    total = reduce(lambda x, y: x + y, [F.col(p) for p in parts])
    largest = F.greatest(*[F.abs(p) for p in parts])
    mostly = F.coalesce(*[F.when(F.abs(p) == largest, F.lit(p)) for p in parts])
    return deltas.withColumns({"total": total, "mostly": mostly})


def access_matrix(grants: DataFrame, who: str, privileges: list[str]) -> DataFrame:
    """Whether each principal holds all privileges that a read needs, and the first one it lacks."""
    held = grants.groupBy(who).agg(*[F.bool_or(F.col("privilege") == p).alias(p) for p in privileges])
    missing = F.coalesce(*[F.when(~F.col(p), F.lit(p)) for p in privileges])
    return held.withColumns({"allowed": reduce(lambda a, b: a & b, [F.col(p) for p in privileges]), "first_missing": missing})


def value_sensitivity(scenarios: DataFrame, rate: int, most_hours: int, step: int) -> DataFrame:
    """Net value of hours saved a week over a grid of hours, and the hours at which each scenario breaks even."""
    grid = scenarios.withColumn("hours", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most_hours).cast("long"), F.lit(step).cast("long"))))
    even = F.try_divide(F.col("costs").cast("double"), (F.col("weeks") * rate).cast("double"))
    return grid.select("scenario", "hours", (F.col("hours") * F.col("weeks") * rate - F.col("costs")).alias("net"), even.alias("break_even"))


def as_of(rows: DataFrame, publications: DataFrame, snapshot: str, publication: str, version: int) -> DataFrame:
    """Rows of the snapshot that a publication published."""
    return rows.join(publications.filter(F.col(publication) == version), snapshot)


def point_in_time(events: DataFrame, entity: str, at: str, event: str, predict: str, feature: str, outcome: str, horizon: int) -> DataFrame:
    """A row per prediction event: the entity's last feature value known then, and whether the outcome follows in time.

    Timelines are cut into ranges of (entity, time), so one of any length is shared by many tasks. Within a range, the last
    feature at or before an event is a running value, and the first outcome after it one of the range read backward. What
    a range does not know comes from others: the last feature of earlier ranges of the entity, and the first outcome of
    later ones, by one row a range. Equal times of an entity lie in one range.
    """
    kind = F.when(F.col("event_type") == feature, 0).when(F.col("event_type") == predict, 1).when(F.col("event_type") == outcome, 2)
    line = events.select(entity, F.unix_micros(F.col(at).cast("timestamp")).alias(at), event, "event_type", F.col("value").alias("v")).withColumn("kind", kind).filter("kind is not null")
    line = cut(line.repartitionByRange(entity, at).withColumn("range", F.spark_partition_id()))
    feature_value, when_outcome = F.when(F.col("kind") == 0, F.col("v")), F.when(F.col("kind") == 2, F.col(at))
    ends = line.groupBy(entity, "range").agg(F.max_by(feature_value, F.when(feature_value.isNotNull(), F.struct(at, event))).alias("last"), F.min(when_outcome).alias("first"))
    in_order = Window.partitionBy(entity).orderBy("range")
    carried = ends.select(
        F.col(entity).alias("__entity"),
        F.col("range").alias("__range"),
        F.last("last", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("__last"),
        F.min("first").over(in_order.rowsBetween(1, Window.unboundedFollowing)).alias("__first"),
    )
    past = Window.partitionBy(entity, "range").orderBy(at, "kind", event).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(entity, "range").orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, -1)
    known = F.last(feature_value, ignorenulls=True).over(past)
    out = line.withColumns({"known": known, "next": F.min(when_outcome).over(later)}).filter("kind = 1")
    out = out.join(carried, F.col(entity).eqNullSafe(F.col("__entity")) & (F.col("range") == F.col("__range")))
    following = F.coalesce("next", "__first")
    return out.select(event, F.coalesce("known", "__last").alias("feature"), F.coalesce(following <= F.col(at) + horizon * 1_000_000, F.lit(False)).alias("label"))


def temporal_split(rows: DataFrame, entity: str, at: str, cut: str, parts: int) -> DataFrame:
    """Rows with ``part``: held-out entities (one in ``parts``, by hash), the future from ``cut`` on, or train."""
    bucket = F.conv(F.substring(F.md5(F.col(entity).cast("string")), 1, 8), 16, 10).cast("long") % parts
    return rows.withColumn("part", F.when(bucket == 0, "held_out_entity").when(F.col(at) >= F.lit(cut).cast("timestamp"), "future").otherwise("train"))
