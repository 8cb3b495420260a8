"""Order lines with revisions and cancellations, in integer cents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.rules import Rule, reasons

KEY = ["order_id", "line_id"]


def order_rules() -> list[Rule]:
    return [
        Rule("invalid_revision", F.coalesce(F.col("revision") < 1, F.lit(True))),
        Rule("invalid_quantity", F.coalesce(F.col("quantity") < 0, F.lit(True))),
        Rule("invalid_unit_cents", F.coalesce(F.col("unit_cents") < 0, F.lit(True))),
        Rule("unknown_operation", ~F.coalesce(F.col("operation").isin("upsert", "cancel"), F.lit(False))),
        Rule("cancel_with_quantity", (F.col("operation") == "cancel") & (F.col("quantity") != 0)),
    ]


def order_violations(events: DataFrame) -> DataFrame:
    return events.select(*KEY, "revision", F.explode(reasons(order_rules())).alias("rule"))


def current_lines(events: DataFrame) -> DataFrame:
    """(order, line, revision, quantity, unit_cents, operation, payloads): the highest revision of each line.

    ``payloads`` above 1 means that the current revision itself is contradicted; older disagreement is harmless.
    A cancellation is a current line with operation cancel.
    """
    payload = F.struct("quantity", "unit_cents", "operation")
    by_revision = events.groupBy(*KEY, "revision").agg(F.count_distinct(payload).alias("payloads"), F.max(payload).alias("p"))
    top = by_revision.groupBy(*KEY).agg(F.max_by(F.struct("revision", "p", "payloads"), "revision").alias("r"))
    return top.select(*KEY, "r.revision", "r.p.*", "r.payloads")


def order_totals(lines: DataFrame) -> DataFrame:
    """Cents of each order over its active lines; an order whose lines are all cancelled has no row."""
    active = lines.filter("operation <> 'cancel'")
    return active.groupBy("order_id").agg(F.sum(F.col("quantity") * F.col("unit_cents")).alias("order_cents"))


def order_summary(lines: DataFrame) -> DataFrame:
    """One row: total cents, current, active and cancelled lines, contradicted lines."""
    cents = F.when(F.col("operation") != "cancel", F.col("quantity") * F.col("unit_cents"))
    return lines.agg(F.coalesce(F.sum(cents), F.lit(0)).alias("total_cents"), F.count("*").alias("current_lines"), F.count_if(F.col("operation") != "cancel").alias("active_lines"), F.count_if(F.col("operation") == "cancel").alias("cancelled_lines"), F.count_if(F.col("payloads") > 1).alias("ambiguous_lines"))
