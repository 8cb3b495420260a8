"""Row rules: predicates with reason codes, and what to do with rows that fail."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT_MAX = 2147483647


@dataclass(frozen=True)
class Rule:
    """``code`` is the reason given where ``fails`` is true; a rule that cannot be decided does not fail."""

    code: str
    fails: Column


def nonblank(col: Column) -> Column:
    """Present, and holding something other than (Unicode) white space."""
    return F.coalesce(col.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def positive_int(col: Column) -> Column:
    return F.coalesce(col.between(1, INT_MAX), F.lit(False))


def reasons(rules: list[Rule]) -> Column:
    """Codes of all failing rules, in rule order."""
    return F.array_compact(F.array(*[F.when(r.fails, F.lit(r.code)) for r in rules]))


def flag(condition: Column) -> Column:
    """A three-valued condition as a boolean: undecided is false."""
    return F.coalesce(condition, F.lit(False))


def violations(df: DataFrame, kind: str, key: str, rules: list[Rule]) -> DataFrame:
    """A row (rule, entity_kind, entity_id) for each rule that a row fails."""
    return df.select(F.explode(reasons(rules)).alias("rule"), F.lit(kind).alias("entity_kind"), F.col(key).cast("string").alias("entity_id"))


def delivery_rules() -> list[Rule]:
    """Rules of an inspection delivery, in the order in which reasons are given."""
    inspected, defective = F.col("inspected_units"), F.col("defective_units")
    return [
        Rule("missing_event_id", ~nonblank(F.col("event_id"))),
        Rule("missing_inspection_id", ~nonblank(F.col("inspection_id"))),
        Rule("invalid_version", ~positive_int(F.col("version"))),
        Rule("missing_inspected_units", inspected.isNull()),
        Rule("invalid_inspected_units", inspected < 0),
        Rule("missing_defective_units", defective.isNull()),
        Rule("invalid_defective_units", defective < 0),
        Rule("defective_exceeds_inspected", defective > inspected),
    ]


def units_text(col: Column, missing: str, malformed: str, negative: str) -> tuple[Column, Column]:
    """(value, reason) of a quantity given as text: digits with an optional sign, white space around them ignored."""
    text = F.trim(col)
    value = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))
    reason = F.when(col.isNull() | (text == ""), missing).when(value.isNull(), malformed).when(value < 0, negative)
    return F.when(reason.isNull(), value), reason
