"""Joins that keep or multiply grain, checks of both, and comparison of relations."""

from __future__ import annotations

import contextlib
import io
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fanout_audit(facts: DataFrame, dims: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """One row: rows and measure sums of the facts before and after an inner join, and whether the join multiplies.

    The join itself is not made: per-key counts of the dimension side give the same sums.
    """
    per_key = dims.groupBy(key).agg(F.count("*").alias("__n"))
    pairs = facts.join(per_key, key, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    sums = [a for m in measures for a in (F.sum(m).alias(f"{m}_before"), F.sum(F.col(m) * F.col("__n")).alias(f"{m}_after"))]
    out = pairs.agg(F.count("*").alias("rows_before"), F.sum("__n").alias("rows_after"), F.max("__n").alias("most_matches"), *sums)
    return out.withColumn("multiplies", F.coalesce(F.col("most_matches") > 1, F.lit(False)))


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose key ``right`` does not have."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def dual_run(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys that two runs disagree on, with a status: missing (only old), extra (only new), different."""
    o = old.select(*key, F.struct(*values).alias("__old"), F.lit(True).alias("__in_old"))
    n = new.select(*key, F.struct(*values).alias("__new"), F.lit(True).alias("__in_new"))
    status = F.when(F.col("__in_new").isNull(), "missing").when(F.col("__in_old").isNull(), "extra").when(~F.col("__old").eqNullSafe(F.col("__new")), "different")
    return o.join(n, key, "full_outer").select(*key, status.alias("status")).filter(F.col("status").isNotNull())


def relation_equivalence(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether types agree, and how many rows either side has that the other has not (with multiplicity)."""
    return relation_equivalences(a, {"": b}).drop("pair")


def relation_equivalences(a: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """``relation_equivalence`` of one relation with each of several, named in ``pair``; each relation is read and shuffled once."""
    same = {name: b for name, b in others.items() if b.columns == a.columns and [t for _, t in b.dtypes] == [t for _, t in a.dtypes]}
    sides = [a.withColumn("__side", F.lit(-1))] + [b.select(*a.columns).withColumn("__side", F.lit(i)) for i, b in enumerate(same.values())]
    held = lambda side: F.count_if(F.col("__side") == side)
    nets = reduce(DataFrame.unionByName, sides).groupBy(*a.columns).agg(*[(held(-1) - held(i)).alias(f"__{i}") for i in range(len(same))], F.lit(0).alias("__"))
    over = lambda net: F.coalesce(F.sum(F.greatest(net, F.lit(0))), F.lit(0))
    counts = [F.struct(F.lit(True).alias("same_types"), over(F.col(f"__{i}")).alias("only_left"), over(-F.col(f"__{i}")).alias("only_right"), F.lit(name).alias("pair")) for i, name in enumerate(same)]
    unlike = [F.struct(F.lit(False).alias("same_types"), F.lit(None).cast("long").alias("only_left"), F.lit(None).cast("long").alias("only_right"), F.lit(name).alias("pair")) for name in others if name not in same]
    one = nets.agg(F.array(*counts).alias("pairs")).select(F.concat("pairs", F.array(*unlike))) if unlike and counts else nets.agg(F.array(*counts).alias("pairs")) if counts else a.sparkSession.range(1).select(F.array(*unlike).alias("pairs"))
    return one.toDF("pairs").select(F.inline("pairs"))


def plan_text(df: DataFrame) -> str:
    """The formatted plan of a query."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def plan_report(df: DataFrame, operators: tuple[str, ...] = ("Exchange", "BroadcastHashJoin", "SortMergeJoin", "PythonUDF")) -> DataFrame:
    """A row for each operator name: how often the plan names it."""
    text = plan_text(df)
    return df.sparkSession.createDataFrame([(o, text.count(o)) for o in operators], "operator string, occurrences int")
