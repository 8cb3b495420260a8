"""A resolver that keeps its state: a batch is merged into it, retained history is not resolved again.

The state is four tables that grow by batches (``functions.deltas``), each with a fold that may run in any order:

* ``deliveries``: the different deliveries, each in the batch that brought it first;
* ``contradicted``: (event, key) of events that came with different payloads, which never ends;
* ``revisions``: per (key, version) the least and largest of each quantity, whether one was missing and one was there, and
  whether all and any deliveries were valid: minima, maxima, ands and ors;
* ``keys``: what ``resolve`` says of a key, as of the newest batch that touched it.

A batch reads of these tables the rows of its own events and keys (and of the keys that its contradictions reach),
by joins of which the batch is the small side, and writes only those. Batches may come in any order and deliveries
more than once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.deltas import Deltas, newest
from tallyspark.functions.iterate import cut
from tallyspark.functions.rules import nonblank, positive_int, reasons
from tallyspark.operators import resolve as R


@dataclass(frozen=True)
class ResolverState:
    """``quantity_type``, ``version_type``: types of the policy's columns; event and key are strings."""

    spark: SparkSession
    root: str
    policy: R.Policy = R.Policy()
    version_type: str = "int"
    quantity_type: str = "int"

    def _table(self, name: str, schema: str, fold) -> Deltas:
        return Deltas(self.spark, f"{self.root}/{name}", schema, fold)

    def _row(self) -> str:
        p = self.policy
        return ", ".join([f"{p.event} string, {p.key} string, {p.version} {self.version_type}", *[f"{c} {self.quantity_type}" for c in p.quantities]])

    def deliveries(self) -> Deltas:
        return self._table("deliveries", f"{self._row()}, valid boolean", lambda rows: rows)  # a batch adds no delivery that is there

    def contradicted(self) -> Deltas:
        return self._table("contradicted", f"{self.policy.event} string, {self.policy.key} string", newest(self.policy.event, self.policy.key))

    def revisions(self) -> Deltas:
        p = self.policy
        parts = "".join(f", {c}_low {self.quantity_type}, {c} {self.quantity_type}, {c}_missing boolean, {c}_given boolean" for c in p.quantities)
        return self._table("revisions", f"{p.key} string, {p.version} {self.version_type}, all_valid boolean, any_valid boolean{parts}", self._merged)

    def keys(self) -> Deltas:
        p = self.policy
        top = ", ".join(["all_valid: boolean", *[f"{c}: {self.quantity_type}" for c in p.quantities]])
        flags = "known boolean, unordered boolean, contradicted boolean, split_revisions long, invalid_latest boolean, unordered_known boolean, blocked boolean"
        return self._table("keys", f"{p.key} string, latest {self.version_type}, top struct<{top}>, {flags}", newest(p.key))

    def _merged(self, rows: DataFrame) -> DataFrame:
        p, parts = self.policy, []
        for c in p.quantities:
            parts += [F.min(f"{c}_low").alias(f"{c}_low"), F.max(c).alias(c), F.bool_or(f"{c}_missing").alias(f"{c}_missing"), F.bool_or(f"{c}_given").alias(f"{c}_given")]
        return rows.groupBy(p.key, p.version).agg(F.bool_and("all_valid").alias("all_valid"), F.bool_or("any_valid").alias("any_valid"), *parts)

    def _revisions_of(self, rows: DataFrame) -> DataFrame:
        """Deliveries as rows of ``revisions``, one for each (key, version)."""
        p = self.policy
        each = rows.withColumn(p.version, F.when(positive_int(F.col(p.version)), F.col(p.version))).withColumns({"all_valid": F.col("valid"), "any_valid": F.col("valid")})
        for c in p.quantities:
            each = each.withColumns({f"{c}_low": F.col(c), f"{c}_missing": F.col(c).isNull(), f"{c}_given": F.col(c).isNotNull()})
        return self._merged(each)

    def _keys_of(self, revisions: DataFrame, contradicted: DataFrame) -> DataFrame:
        """Rows of ``keys`` from all revisions of some keys and the keys that contradicted events have."""
        p = self.policy
        apart = [(F.col(f"{c}_low") < F.col(c)) | (F.col(f"{c}_missing") & F.col(f"{c}_given")) for c in p.quantities]
        conflict = F.col(p.version).isNotNull() & reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in apart])
        return R.key_states(revisions.withColumn("conflict", conflict), contradicted.select(p.key), p)

    def applied(self) -> int:
        """The number that the next batch gets."""
        return self.keys().applied()

    def apply(self, batch: DataFrame, seq: int | None = None) -> None:
        """Merge a batch, given its number (the next if not said otherwise). A batch that is in the state already changes nothing; one
        that failed midway may run again with its number."""
        p = self.policy
        seq = self.applied() if seq is None else seq
        tables = deliveries, contradicted, revisions, keys = self.deliveries(), self.contradicted(), self.revisions(), self.keys()
        if self.applied() > seq:
            return
        row = [p.event, *p.payload]
        before = deliveries.read(before=seq)
        both = batch.select(*row, F.lit(False).alias("known")).unionByName(before.select(*row, F.lit(True).alias("known")))
        new = both.groupBy(*row).agg(F.bool_or("known").alias("known")).filter("not known").drop("known")
        deliveries.add(new.withColumn("valid", F.size(reasons(p.rules())) == 0), seq)
        fresh = deliveries.batch(seq)
        # Different deliveries of an event differ in payload: two in the batch, or one there and one before it, contradict each other.
        events = fresh.filter(nonblank(F.col(p.event))).groupBy(p.event).agg(F.count("*").alias("n"))
        earlier = cut(before.select(p.event, p.key).join(events.select(p.event), p.event, "left_semi"))
        split = events.filter("n > 1").select(p.event).union(earlier.select(p.event)).distinct()
        contradicted.add(fresh.select(p.event, p.key).join(split, p.event, "left_semi").union(earlier).distinct(), seq)
        revisions.add(self._revisions_of(fresh.filter(nonblank(F.col(p.key)))), seq)
        reached = contradicted.batch(seq).select(p.key).filter(nonblank(F.col(p.key)))
        touched = revisions.batch(seq).select(p.key).union(reached).distinct()
        of_touched = lambda t: t.read(before=seq + 1).join(touched, p.key, "left_semi")
        keys.add(self._keys_of(self._merged(of_touched(revisions)), of_touched(contradicted)), seq)
        for t in tables:
            t.compact()

    def resolution(self, staged: bool = False) -> R.Resolution:
        """The relations of all batches together; ``staged`` keys are folded once for a caller that asks for several relations."""
        p = self.policy
        keys = self.keys().current()
        events = self.contradicted().current().select(p.event).distinct().withColumn("conflict", F.lit(True))
        return R.Resolution(p, self.deliveries().current(), events, self.revisions().current(), cut(keys) if staged else keys)
