"""Reconciliation of versioned records: contradictions, latest revisions, accepted state, publication gate.

Every relation comes from three aggregates with map-side combining, so that a key, event or revision with
many deliveries costs no task more than others:

* ``events``: one row per event id, with a flag for contradictory payloads;
* ``revisions``: one row per (key, version);
* ``keys``: one row per key, all that is needed to accept, exclude or block it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.dealt import dealt
from tallyspark.functions.iterate import cut
from tallyspark.functions.ranked import ranked
from tallyspark.functions.rules import Rule, delivery_rules, nonblank, positive_int, reasons
from tallyspark.functions.scratch import staged as kept


#: Arrivals in a part of the evidence of a contradiction.
EVIDENCE = 1000


@dataclass(frozen=True)
class Policy:
    """Which columns name an event, a key, its revision and the quantities, and the rules of a row."""

    event: str = "event_id"
    key: str = "inspection_id"
    version: str = "version"
    quantities: tuple[str, ...] = ("inspected_units", "defective_units")

    @property
    def payload(self) -> tuple[str, ...]:
        return (self.key, self.version, *self.quantities)

    def rules(self) -> list[Rule]:
        return delivery_rules()


def disagree(cols: tuple[str, ...]) -> Column:
    """Whether a group holds two different tuples of these columns, missing values included."""
    one = [(F.min(c) < F.max(c)) | (F.max(c).isNotNull() & F.bool_or(F.col(c).isNull())) for c in cols]
    return F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), one), F.lit(False))


@dataclass
class Resolution:
    """The named relations of one history. ``rows``: distinct deliveries with ``reasons`` and ``valid``; ``counts``, if they are
    made already: one row (distinct, quarantined, valid) of them."""

    policy: Policy
    rows: DataFrame
    events: DataFrame
    revisions: DataFrame
    keys: DataFrame
    counts: DataFrame | None = None

    def quarantine(self) -> DataFrame:
        return self.rows.filter(~F.col("valid")).drop("valid")

    def event_conflicts(self) -> DataFrame:
        return self.events.filter("conflict").select(self.policy.event, "deliveries")

    def revision_conflicts(self) -> DataFrame:
        """(key, version, payloads): contradicted revisions and how many different quantities they came with."""
        p = self.policy
        split = self.split_revisions()
        return self.rows.join(split, [p.key, p.version], "left_semi").groupBy(p.key, p.version).agg(F.count_distinct(F.struct(*p.quantities)).alias("payloads"))

    def split_revisions(self) -> DataFrame:
        return self.revisions.filter("conflict").select(self.policy.key, self.policy.version)

    def unresolved(self) -> DataFrame:
        return self.keys.filter("blocked").select(self.policy.key)

    def excluded(self) -> DataFrame:
        return self.keys.filter("not known and not blocked").select(self.policy.key)

    def accepted(self) -> DataFrame:
        p = self.policy
        return self.keys.filter("known and not blocked").select(p.key, F.col("latest").alias(p.version), *[F.col(f"top.{c}").alias(c) for c in p.quantities])

    def totals(self) -> DataFrame:
        return weighted_rate(self.accepted(), [])

    def gate(self) -> DataFrame:
        """One row: counts of the three kinds of doubt, and whether the state may be published."""
        events = self.events.agg(F.count_if(F.expr("conflict")).alias("event_conflicts"))
        keys = self.keys.agg(F.coalesce(F.sum("split_revisions"), F.lit(0)).alias("revision_conflicts"), F.count_if(F.expr("blocked")).alias("unresolved_keys"))
        one = events.crossJoin(keys)  # one row each
        return one.withColumn("publication_allowed", F.expr("event_conflicts = 0 and revision_conflicts = 0 and unresolved_keys = 0"))


def distinct_deliveries(raw: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Each different delivery once; columns beside the policy's are dropped."""
    return raw.groupBy(policy.event, *policy.payload).agg(F.lit(True).alias("__one")).drop("__one")  # ``distinct`` would name its columns in another order than SQL


def resolve(raw: DataFrame, policy: Policy = Policy(), staged: bool = False) -> Resolution:
    """The relations of a history; ``staged`` ones are evaluated once for a caller that asks for several of them."""
    p = policy
    once = cut if staged else lambda df: df
    once_each = once(distinct_deliveries(raw, p))
    # Blank events and keys are counted out after the groups are made: a filter before would reach below the distinct deliveries,
    # and the relations would no longer share their shuffle. Numbers and flags alone go through the groups, so none of them is sorted.
    counted = once_each.groupBy(p.event).agg(F.count_if(nonblank(F.col(p.event))).alias("deliveries")).filter("deliveries > 0")
    events = counted.withColumn("conflict", F.col("deliveries") > 1)  # different deliveries of an event differ in payload
    of_split = f"SELECT `{p.key}` FROM {{rows}} WHERE `{p.event}` IN (SELECT `{p.event}` FROM {{split}})"  # the same step as in the SQL form
    doubtful = raw.sparkSession.sql(of_split, rows=once_each if staged else raw, split=events.filter("conflict"))
    rows = once_each.withColumn("reasons", reasons(p.rules())).withColumn("valid", F.size("reasons") == 0)
    by_revision = revision_states(rows, p)
    keys = key_states(by_revision, doubtful, p)
    return Resolution(p, rows, events, by_revision.filter(F.col(p.version).isNotNull()), once(keys))


def resolve_each(raw: DataFrame, names: list[str], policy: Policy = Policy(), of: str = "histories") -> dict[str, Resolution]:
    """The relations of several histories by name, all of them from one shuffle by event and one by key.

    Bit i of the whole number ``of`` says whether a row belongs to the history ``names[i]``. A history's rows, revisions and
    events are only evaluated if they are asked for; its keys and counts are made here.
    """
    p = policy
    member = F.expr(f"filter(sequence(0, {len(names) - 1}), i -> (shiftright(`{of}`, i) & 1) = 1)")

    def each(rows: DataFrame) -> DataFrame:
        return rows.withColumn("history", F.explode(member)).drop(of)

    raw = raw.select(p.event, *p.payload, of)
    by_event = []
    for part in dealt(raw, p.event):
        once_each = each(part).groupBy("history", p.event, *p.payload).agg((F.size(reasons(p.rules())) == 0).alias("valid"))
        by_event.append(once_each.groupBy("history", p.event).agg(F.count("*").alias("distinct"), F.count_if("valid").alias("valid")))
    split = F.when(nonblank(F.col(p.event)) & (F.col("distinct") > 1), F.col(p.event)).alias(p.event)
    events = kept(reduce(DataFrame.unionByName, by_event).groupBy("history", split).agg(F.sum("distinct").alias("distinct"), F.sum("valid").alias("valid")), "events")  # the contradicted ones, and a row for the others
    doubtful = kept(each(raw).join(events.filter(F.col(p.event).isNotNull()), ["history", p.event], "left_semi").select("history", p.key).distinct(), "doubtful")
    narrow = raw.withColumn("valid", F.size(reasons(p.rules())) == 0).drop(p.event)  # repeats change no state of a revision
    by_key = [key_states(revision_states(each(part), p, "history"), doubtful, p, "history") for part in dealt(narrow, p.key)]
    keys = kept(reduce(DataFrame.unionByName, by_key), "keys")
    out = {}
    for i, name in enumerate(names):
        counts = events.filter(F.col("history") == i).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct", "valid")])
        counts = counts.select("distinct", (F.col("distinct") - F.col("valid")).alias("quarantined"), "valid")
        own = raw.filter((F.shiftright(of, i).bitwiseAND(1)) == 1).drop(of)
        out[name] = replace(resolve(own, p), keys=keys.filter(F.col("history") == i).drop("history"), counts=counts)
    return out


def revision_states(rows: DataFrame, policy: Policy = Policy(), *by: str) -> DataFrame:
    """One row per (key, version) of rows with ``valid``: what the state of a key needs of it."""
    p = policy
    ordered = rows.withColumn(p.version, F.when(positive_int(F.col(p.version)), F.col(p.version)))
    by_revision = ordered.groupBy(*by, p.key, p.version).agg(
        disagree(p.quantities).alias("conflict"),
        F.bool_and("valid").alias("all_valid"),
        F.bool_or("valid").alias("any_valid"),
        *[F.max(c).alias(c) for c in p.quantities],
        F.bool_or(nonblank(F.col(p.key))).alias("keyed"),
    )
    return by_revision.filter("keyed").drop("keyed").withColumn("conflict", F.col("conflict") & F.col(p.version).isNotNull())


def key_states(by_revision: DataFrame, doubtful: DataFrame, policy: Policy = Policy(), *by: str) -> DataFrame:
    """One row per key from (key, version) rows and the keys that contradicted events have: what is needed to accept, exclude or block it."""
    p = policy
    keys = by_revision.groupBy(*by, p.key).agg(
        F.max(p.version).alias("latest"),
        F.struct(*[F.max_by(c, p.version).alias(c) for c in ("all_valid", *p.quantities)]).alias("top"),
        F.bool_or("any_valid").alias("known"),
        F.bool_or(F.col(p.version).isNull()).alias("unordered"),
        F.bool_or("conflict").alias("split"),
        F.count_if(F.expr(f"conflict and {p.version} is not null")).alias("split_revisions"),
    )
    keys = keys.join(doubtful.distinct().withColumn("doubted", F.lit(True)), [*by, p.key], "left")
    keys = keys.withColumn("contradicted", F.col("split") | F.coalesce("doubted", F.lit(False))).drop("split", "doubted")
    invalid_latest = F.col("known") & ~F.col("top.all_valid")
    unordered = F.col("known") & F.col("unordered")
    keys = keys.withColumns({"invalid_latest": F.coalesce(invalid_latest, F.lit(False)), "unordered_known": unordered})
    return keys.withColumn("blocked", F.col("contradicted") | F.col("invalid_latest") | F.col("unordered_known"))


def weighted_rate(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums and sum(defective) / sum(inspected) by group; no rate where nothing was inspected."""
    sums = rows.groupBy(*by).agg(F.sum("inspected_units").alias("inspected_units"), F.sum("defective_units").alias("defective_units"))
    return sums.withColumn("defect_rate", F.try_divide(F.col("defective_units").cast("double"), F.col("inspected_units").cast("double")))


def conflict_evidence(raw: DataFrame, policy: Policy = Policy(), arrival: str = "arrival_seq", part: int = EVIDENCE) -> DataFrame:
    """Every arrival of a contradicted event id or (key, version): kind, identity, part, arrival positions in order.

    A contradiction with more than ``part`` arrivals has several parts, 0, 1, ..., of that length but for the last, in the
    order of arrival; its arrivals are numbered, and its parts made, by many tasks.
    """
    rows = ranked(conflict_arrivals(raw, policy, arrival), ["kind", "identity"], [arrival]).withColumn("part", F.floor(F.col("index") / part).cast("long"))
    return rows.groupBy("kind", "identity", "part").agg(F.array_sort(F.collect_list(arrival)).alias("arrivals"))


def quarantined_arrivals(raw: DataFrame, policy: Policy = Policy(), arrival: str = "arrival_seq") -> DataFrame:
    """Every arrival that fails a rule, also a repeated one, with its position and the codes of the rules, in their order."""
    return raw.withColumn("reasons", reasons(policy.rules())).filter(F.size("reasons") > 0).select(arrival, policy.event, *policy.payload, "reasons")


def conflict_arrivals(raw: DataFrame, policy: Policy = Policy(), arrival: str = "arrival_seq") -> DataFrame:
    p = policy
    found = resolve(raw, p)
    event = raw.join(found.event_conflicts().select(p.event), p.event).select(F.lit("event_id").alias("kind"), F.col(p.event).cast("string").alias("identity"), arrival)
    pair = F.concat_ws("@", F.col(p.key), F.col(p.version))
    revision = raw.join(found.split_revisions(), [p.key, p.version]).select(F.lit("key_version").alias("kind"), pair.alias("identity"), arrival)
    return event.unionByName(revision)


def resolve_simple(raw: DataFrame, policy: Policy = Policy(), arrival: str = "arrival_seq") -> DataFrame:
    """The older, weaker contract: the last payload of an event id counts, negative quantities are dropped first,
    the highest remaining version wins. Unlike ``resolve`` it brings back an older revision."""
    p = policy
    row = F.struct(*p.payload)
    last = raw.groupBy(p.event).agg(F.max_by(row, arrival).alias("r")).select("r.*")
    sound = last.filter(reduce(lambda a, b: a & b, [F.col(c) >= 0 for c in p.quantities]))
    return sound.groupBy(p.key).agg(F.max(F.struct(p.version, *p.quantities)).alias("r")).select(p.key, "r.*")


def classify_arrivals(raw: DataFrame, policy: Policy = Policy(), arrival: str = "arrival_seq") -> DataFrame:
    """A label for each arrival against the whole history: what kind of evidence it is.

    identical_delivery: a later repeat of a delivery; conflict: its event id or (key, version) is contradicted;
    unresolved_ordering: no usable version; redundant_evidence: another event already gave this key and version;
    older_revision: the key has a higher version; correction: a version that replaces a lower one; first_evidence.

    Arrivals are shuffled once by event and once by key; windows of a key see the rest. Keys with too many arrivals for a task are
    labelled by aggregates and joins.
    """
    p = policy
    raw = kept(raw.select(p.event, *p.payload, arrival), "arrivals")
    named = raw.select(p.event, *p.payload).filter(nonblank(F.col(p.event)))
    several = [distinct_deliveries(part, p).groupBy(p.event).agg((F.count("*") > 1).alias("ec")).filter("ec") for part in dealt(named, p.event)]
    rows = raw.join(kept(reduce(DataFrame.unionByName, several), "contradicted"), p.event, "left")
    near, *far = dealt(rows, p.key)
    return reduce(DataFrame.unionByName, [_labels_by_windows(near, p, arrival), *[_labels_by_joins(x, p, arrival) for x in far]])


def _label(p: Policy) -> Column:
    """Of the first arrival of a delivery, from ``ec``, ``rc``, ``first_seq``, ``pair_seq``, ``high`` and ``low``."""
    version = F.col(p.version)
    return (
        F.when(F.col("ec") | F.col("rc"), "conflict")
        .when(~positive_int(version), "unresolved_ordering")
        .when(F.col("first_seq") > F.col("pair_seq"), "redundant_evidence")
        .when(version < F.col("high"), "older_revision")
        .when(version > F.col("low"), "correction")
        .otherwise("first_evidence")
    )


def _labels_by_windows(rows: DataFrame, p: Policy, arrival: str) -> DataFrame:
    """Of rows of which a task has all of a key."""
    key, version = F.col(p.key), F.col(p.version)
    pair, whole = Window.partitionBy(p.key, p.version), Window.partitionBy(p.key)
    differ = [(F.min(c).over(pair) < F.max(c).over(pair)) | (F.max(c).over(pair).isNotNull() & F.bool_or(F.col(c).isNull()).over(pair)) for c in p.quantities]
    usable = F.when(key.isNotNull() & positive_int(version), version)
    order = [p.key, p.version, p.event, *p.quantities]  # one sort serves all windows
    seen = rows.sortWithinPartitions(*order).withColumn("first_seq", F.min(arrival).over(Window.partitionBy(*order)))
    seen = seen.withColumn("pair_seq", F.when(key.isNotNull() & version.isNotNull(), F.min("first_seq").over(pair)))
    seen = seen.withColumn("rc", nonblank(key) & positive_int(version) & reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in differ]))
    seen = seen.withColumns({"high": F.max(usable).over(whole), "low": F.min(usable).over(whole)})
    return seen.select(arrival, F.when(F.col(arrival) > F.col("first_seq"), "identical_delivery").otherwise(_label(p)).alias("label"))


def _labels_by_joins(rows: DataFrame, p: Policy, arrival: str) -> DataFrame:
    """Of rows whose keys are too large for a task."""
    key, version = F.col(p.key), F.col(p.version)
    one = cut(rows.groupBy(p.event, *p.payload).agg(F.min(arrival).alias("first_seq"), F.bool_or("ec").alias("ec")))  # the different deliveries
    pairs = one.groupBy(p.key, p.version).agg(F.min("first_seq").alias("pair_seq"), (nonblank(key) & positive_int(version) & disagree(p.quantities)).alias("rc"))
    spread = pairs.filter(positive_int(version)).groupBy(p.key).agg(F.max(p.version).alias("high"), F.min(p.version).alias("low"))
    labelled = one.join(pairs, [p.key, p.version], "left").join(spread, p.key, "left")
    delivery = F.struct(p.event, *p.payload).alias("delivery")  # as one value, missing parts are equal
    found = rows.select(delivery, arrival).join(labelled.select(delivery, "first_seq", _label(p).alias("label")), "delivery")
    return found.select(arrival, F.when(F.col(arrival) > F.col("first_seq"), "identical_delivery").otherwise(F.col("label")).alias("label"))


def coverage(found: Resolution, raw: DataFrame | None = None) -> DataFrame:
    """One row: arrivals (if ``raw`` is given), distinct deliveries, quarantined, valid, accepted, excluded and withheld keys."""
    counts = [
        *([raw.agg(F.count("*").alias("raw"))] if raw is not None else []),
        found.counts if found.counts is not None else found.rows.agg(F.count("*").alias("distinct"), F.count_if(~F.col("valid")).alias("quarantined"), F.count_if(F.expr("valid")).alias("valid")),
        found.keys.agg(F.count_if(F.expr("known and not blocked")).alias("accepted"), F.count_if(F.expr("not known and not blocked")).alias("excluded"), F.count_if(F.expr("blocked")).alias("withheld")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), counts)
