"""Queries of joins, grain, metrics, upserts, merges and order lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scratch import scratch
from tallyspark.operators import grain as G
from tallyspark.operators import merge as M
from tallyspark.operators import metrics as X
from tallyspark.operators import orders as O
from tallyspark.operators import resolve as R
from tallyspark.plans import views as V
from tallyspark.plans.register import registry
from tallyspark.plans.resolver_queries import RESOLVE_SQL
from tallyspark.plans.resolver_queries import SQL as RESOLVER_SQL
from tallyspark.plans.views import table

QUERIES, SQL, query = registry()


@query("join_inner_equi", "SELECT o_orderpriority, count(*) AS rows, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def join_inner_equi(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(l, o.o_orderkey == l.l_orderkey).groupBy("o_orderpriority").agg(F.count("*").alias("rows"), F.sum("l_quantity").alias("quantity"))


@query("join_left_semi", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def join_left_semi(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(returned, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("join_exists", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_exists(spark, sf_dir):
    return spark.sql("SELECT c_custkey, c_mktsegment FROM {c} AS c WHERE EXISTS (SELECT 1 FROM {o} AS o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')", c=table(spark, sf_dir, "customer"), o=table(spark, sf_dir, "orders"))


@query("join_left_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def join_left_anti(spark, sf_dir):
    return G.unmatched(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("join_cross_scalar", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lines, (SELECT count(*) FROM customer) AS customers")
def join_cross_scalar(spark, sf_dir):
    one = lambda name, alias: table(spark, sf_dir, name).agg(F.count("*").alias(alias))
    return one("orders", "orders").crossJoin(one("lineitem", "lines")).crossJoin(one("customer", "customers"))


@query("fanout_audit", "WITH j AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS cents, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders) SELECT count(*) AS rows_before, sum(n)::BIGINT AS rows_after, max(n) AS most_matches, sum(cents)::BIGINT AS cents_before, sum(cents * n)::BIGINT AS cents_after, max(n) > 1 AS multiplies FROM j")
def fanout_audit(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("cents"))
    return G.fanout_audit(facts, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", ["cents"])


@query("mean_vs_weighted", f"WITH {V.D1} SELECT version, sum(floor(1000000 * (defective_units::DOUBLE / inspected_units::DOUBLE) + 0.5)) / count(*) AS mean_of_ratios, sum(defective_units)::DOUBLE / sum(inspected_units)::DOUBLE AS weighted FROM d1 WHERE inspected_units > 0 GROUP BY 1")
def mean_vs_weighted(spark, sf_dir):
    rows = V.deliveries(spark, sf_dir).filter("inspected_units > 0")
    ratio = F.floor(F.lit(1000000) * (F.col("defective_units").cast("double") / F.col("inspected_units").cast("double")) + 0.5)  # millionths, so that the sum does not depend on order
    return rows.groupBy("version").agg((F.sum(ratio) / F.count("*")).alias("mean_of_ratios"), (F.sum("defective_units").cast("double") / F.sum("inspected_units").cast("double")).alias("weighted"))


@query("group_weighted_rate", "SELECT l_returnflag AS plant, sum(l_quantity::INT)::BIGINT AS inspected_units, sum(floor(l_discount * 100 + 0.5)::INT)::BIGINT AS defective_units, sum(floor(l_discount * 100 + 0.5)::INT)::DOUBLE / sum(l_quantity::INT)::DOUBLE AS defect_rate FROM lineitem GROUP BY 1")
def group_weighted_rate(spark, sf_dir):
    return R.weighted_rate(X.plant_rows(table(spark, sf_dir, "lineitem")), ["plant"])


@query("global_agg", f"WITH {V.D1} SELECT count(*) AS rows, sum(inspected_units)::BIGINT AS inspected_units, sum(defective_units)::BIGINT AS defective_units FROM d1")
def global_agg(spark, sf_dir):
    return V.deliveries(spark, sf_dir).agg(F.count("*").alias("rows"), F.sum("inspected_units").alias("inspected_units"), F.sum("defective_units").alias("defective_units"))


@query("distinct_count_struct", f"WITH {V.D1} SELECT version, count(DISTINCT (inspected_units, CASE WHEN defective_units > 0 THEN defective_units END)) AS payloads FROM d1 GROUP BY 1")
def distinct_count_struct(spark, sf_dir):
    seen = F.struct("inspected_units", F.when(F.col("defective_units") > 0, F.col("defective_units")).alias("defective"))
    return V.deliveries(spark, sf_dir).groupBy("version").agg(F.count_distinct(seen).alias("payloads"))


@query("order_deterministic", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def order_deterministic(spark, sf_dir):
    top = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)
    order = X.over(["o_totalprice desc", "o_orderkey"])
    return top.select("o_orderkey", F.row_number().over(order).cast("long").alias("place"))


_TARGET = "t AS (SELECT inspection_id, max(version) AS version, arg_max(inspected_units, version) AS inspected_units, arg_max(defective_units, version) AS defective_units FROM d1c WHERE version <= 2 GROUP BY 1), s AS (SELECT inspection_id, max(version) AS version, arg_max(inspected_units, version) AS inspected_units, arg_max(defective_units, version) AS defective_units FROM d1c WHERE version <> 3 GROUP BY 1)"
_QUANTITIES = ["inspected_units", "defective_units"]


def _sides(spark, sf_dir):
    rows = V.clean(spark, sf_dir)
    top = lambda df: df.groupBy("inspection_id").agg(F.max("version").alias("version"), *[F.max_by(c, "version").alias(c) for c in _QUANTITIES])
    return top(rows.filter("version <= 2")), top(rows.filter("version <> 3"))


@query("guarded_upsert", f"WITH {V.D1C}, {_TARGET} SELECT coalesce(t.inspection_id, s.inspection_id) AS inspection_id, CASE WHEN t.version IS NULL OR s.version > t.version THEN s.version ELSE t.version END AS version, CASE WHEN t.version IS NULL OR s.version > t.version THEN s.inspected_units ELSE t.inspected_units END AS inspected_units, CASE WHEN t.version IS NULL OR s.version > t.version THEN s.defective_units ELSE t.defective_units END AS defective_units FROM t FULL JOIN s ON t.inspection_id = s.inspection_id")
def guarded_upsert(spark, sf_dir):
    return M.guarded_upsert(*_sides(spark, sf_dir), "inspection_id", "version", _QUANTITIES)


@query("apply_resolved", f"WITH {V.D1C}, {_TARGET} SELECT coalesce(t.inspection_id, s.inspection_id) AS inspection_id, CASE WHEN t.version IS NULL OR s.version > t.version THEN s.version ELSE t.version END AS version, CASE WHEN t.version IS NULL OR s.version > t.version THEN s.inspected_units ELSE t.inspected_units END AS inspected_units, CASE WHEN t.version IS NULL OR s.version > t.version THEN s.defective_units ELSE t.defective_units END AS defective_units, CASE WHEN t.version IS NULL OR s.version > t.version THEN 'second' ELSE 'first' END AS loaded FROM t FULL JOIN s ON t.inspection_id = s.inspection_id")
def apply_resolved(spark, sf_dir):
    """Resolved rows applied to a target that also says which load a row is from; equal versions agree in quantities."""
    target, source = _sides(spark, sf_dir)
    return M.apply_resolved(target.withColumn("loaded", F.lit("first")), source.withColumn("loaded", F.lit("second")), "inspection_id", "version", _QUANTITIES)


_V_RAW = f"WITH {V.D1}, s AS (SELECT DISTINCT inspection_id, version, inspected_units, defective_units FROM d1 WHERE version <= 2), t AS (SELECT DISTINCT inspection_id, version, inspected_units + 1 AS inspected_units, defective_units FROM d1 WHERE version = 1) "


@query("upsert_violations", _V_RAW + "SELECT 'duplicate_target_key' AS rule, inspection_id FROM t GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'duplicate_source_key', inspection_id FROM s GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'equal_version_disagrees', t.inspection_id FROM t JOIN s USING (inspection_id, version) WHERE (t.inspected_units, t.defective_units) <> (s.inspected_units, s.defective_units)")
def upsert_violations(spark, sf_dir):
    rows = V.deliveries(spark, sf_dir).select("inspection_id", "version", *_QUANTITIES).distinct()
    target = rows.filter("version = 1").withColumn("inspected_units", F.col("inspected_units") + 1)
    return M.upsert_violations(target, rows.filter("version <= 2"), "inspection_id", "version", _QUANTITIES)


@query("merge_sql_form", SQL["guarded_upsert"])
def merge_sql_form(spark, sf_dir):
    """The upsert as one SQL statement: update when newer, insert when absent, never delete by source."""
    target, source = _sides(spark, sf_dir)
    pick = ", ".join(f"CASE WHEN t.version IS NULL OR s.version > t.version THEN s.{c} ELSE t.{c} END AS {c}" for c in ("version", *_QUANTITIES))
    return spark.sql(f"SELECT coalesce(t.inspection_id, s.inspection_id) AS inspection_id, {pick} FROM {{target}} AS t FULL JOIN {{source}} AS s ON t.inspection_id = s.inspection_id", target=target, source=source)


_LINES = f"WITH {V.D2}, c AS (SELECT * FROM d2 QUALIFY revision = max(revision) OVER (PARTITION BY order_id, line_id)) "


@query("order_line_current", _LINES + "SELECT *, 1::BIGINT AS payloads FROM c")
def order_line_current(spark, sf_dir):
    return O.current_lines(V.order_events(spark, sf_dir))


@query("order_totals", _LINES + "SELECT order_id, sum(quantity * unit_cents)::BIGINT AS order_cents FROM c WHERE operation <> 'cancel' GROUP BY 1")
def order_totals(spark, sf_dir):
    return O.order_totals(O.current_lines(V.order_events(spark, sf_dir)))


@query("order_summary", _LINES + "SELECT sum(CASE WHEN operation <> 'cancel' THEN quantity * unit_cents ELSE 0 END)::BIGINT AS total_cents, count(*) AS current_lines, count(*) FILTER (WHERE operation <> 'cancel') AS active_lines, count(*) FILTER (WHERE operation = 'cancel') AS cancelled_lines, 0::BIGINT AS ambiguous_lines FROM c")
def order_summary(spark, sf_dir):
    return O.order_summary(O.current_lines(V.order_events(spark, sf_dir)))


@query("order_event_rules", f"WITH {V.D2}, e AS (SELECT order_id, line_id, revision - 1 AS revision, quantity - 1 AS quantity, unit_cents, operation FROM d2) SELECT order_id, line_id, revision, 'invalid_revision' AS rule FROM e WHERE revision < 1 UNION ALL SELECT order_id, line_id, revision, 'invalid_quantity' FROM e WHERE quantity < 0 UNION ALL SELECT order_id, line_id, revision, 'cancel_with_quantity' FROM e WHERE operation = 'cancel' AND quantity <> 0")
def order_event_rules(spark, sf_dir):
    events = V.order_events(spark, sf_dir).withColumns({"revision": F.col("revision") - 1, "quantity": F.col("quantity") - 1})
    return O.order_violations(events)


_OLD = "old AS (SELECT o_orderkey AS k, o_orderstatus AS status, floor(o_totalprice)::BIGINT AS amount FROM orders), new AS (SELECT CASE WHEN k % 11 = 0 THEN -k - 1 ELSE k END AS k, status, CASE WHEN k % 7 = 0 THEN amount + 1 ELSE amount END AS amount FROM old)"


def _runs(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.floor("o_totalprice").alias("amount"))
    moved = F.when(F.col("k") % 11 == 0, -F.col("k") - 1).otherwise(F.col("k"))
    return old, old.select(moved.alias("k"), "status", F.when(F.col("k") % 7 == 0, F.col("amount") + 1).otherwise(F.col("amount")).alias("amount"))


_STATUS = f"WITH {_OLD}, f AS (SELECT coalesce(old.k, new.k) AS k, CASE WHEN new.k IS NULL THEN 'missing' WHEN old.k IS NULL THEN 'extra' WHEN (old.status, old.amount) IS DISTINCT FROM (new.status, new.amount) THEN 'different' END AS status FROM old FULL JOIN new ON old.k = new.k) "


@query("dual_run_reconcile", _STATUS + "SELECT k, status FROM f WHERE status IS NOT NULL")
def dual_run_reconcile(spark, sf_dir):
    return G.dual_run(*_runs(spark, sf_dir), ["k"], ["status", "amount"])


@query("readout_status", _STATUS + "SELECT coalesce(status, 'pass') AS status, count(*) AS keys, coalesce(status, 'pass') = 'pass' AS passes FROM f GROUP BY 1")
def readout_status(spark, sf_dir):
    old, new = _runs(spark, sf_dir)
    tried = old.select("k").union(new.select("k")).distinct().join(G.dual_run(old, new, ["k"], ["status", "amount"]), "k", "left")
    return tried.groupBy(F.coalesce("status", F.lit("pass")).alias("status")).agg(F.count("*").alias("keys")).withColumn("passes", F.col("status") == "pass")


_SAME = "SELECT '{pair}' AS pair, true AS same_types, (SELECT count(*) FROM (({a}) EXCEPT ALL ({b}))) AS only_left, (SELECT count(*) FROM (({b}) EXCEPT ALL ({a}))) AS only_right"


@query("relation_equivalence", " UNION ALL ".join(_SAME.format(pair=pair, a=RESOLVER_SQL["accepted_state"], b=RESOLVER_SQL[other]) for pair, other in (("sql", "accepted_state"), ("simple", "resolve_simple"))))
def relation_equivalence(spark, sf_dir):
    """The accepted state against its SQL form (the same) and against the weaker contract (not the same)."""
    raw = V.deliveries(spark, sf_dir)
    accepted = R.resolve(raw).accepted()
    return G.relation_equivalences(accepted, {"sql": spark.sql(RESOLVE_SQL["accepted"], raw=raw), "simple": R.resolve_simple(V.arrivals(spark, sf_dir))})


@query("plan_report")
def plan_report(spark, sf_dir):
    return G.plan_report(join_left_semi(spark, sf_dir))


@query("metric_contract", "SELECT l_returnflag AS plant, l_shipdate::DATE AS day, sum(floor(l_discount * 100 + 0.5)::INT)::DOUBLE / nullif(sum(l_quantity::INT), 0)::DOUBLE AS unit_defect_rate, count(*) FILTER (WHERE floor(l_discount * 100 + 0.5)::INT > 0)::DOUBLE / count(*)::DOUBLE AS inspections_with_defect FROM lineitem GROUP BY 1, 2")
def metric_contract(spark, sf_dir):
    return X.metric_contract(X.plant_rows(table(spark, sf_dir, "lineitem")))


@query("tail_objective", "SELECT event_type, count(*) FILTER (WHERE value < 15)::DOUBLE / count(*)::DOUBLE AS share_under, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS tail, count(*) FILTER (WHERE value < 15)::DOUBLE / count(*)::DOUBLE >= 0.95 AS met FROM events GROUP BY 1")
def tail_objective(spark, sf_dir):
    return X.tail_objective(table(spark, sf_dir, "events"), "event_type", "value", 15, 0.95)


@query("latency_attribution", "WITH r AS (SELECT user_id, sum(CASE WHEN event_type = 'view' THEN floor(value * 100)::BIGINT ELSE 0 END)::BIGINT AS queue, sum(CASE WHEN event_type = 'click' THEN floor(value * 100)::BIGINT ELSE 0 END)::BIGINT AS execution, sum(CASE WHEN event_type = 'purchase' THEN floor(value * 100)::BIGINT ELSE 0 END)::BIGINT AS transfer FROM events GROUP BY 1) SELECT b.user_id, (b.queue + b.execution + b.transfer) - (a.queue + a.execution + a.transfer) AS total, b.queue - a.queue AS queue, b.execution - a.execution AS execution, b.transfer - a.transfer AS transfer, CASE WHEN abs(b.queue - a.queue) >= abs(b.execution - a.execution) AND abs(b.queue - a.queue) >= abs(b.transfer - a.transfer) THEN 'queue' WHEN abs(b.execution - a.execution) >= abs(b.transfer - a.transfer) THEN 'execution' ELSE 'transfer' END AS mostly FROM r a JOIN r b ON b.user_id = a.user_id + 1")
def latency_attribution(spark, sf_dir):
    part = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.floor(F.col("value") * 100)).otherwise(0)).alias
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(part("view")("queue"), part("click")("execution"), part("purchase")("transfer"))
    before = runs.withColumn("user_id", F.col("user_id") + 1)
    return X.latency_attribution(before, runs, "user_id", ["queue", "execution", "transfer"])


@query("access_matrix", "WITH g AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS use_catalog, bool_or(o_orderstatus = 'O') AS use_schema, bool_or(o_orderstatus = 'P') AS can_select FROM orders GROUP BY 1) SELECT *, use_catalog AND use_schema AND can_select AS allowed, CASE WHEN NOT use_catalog THEN 'use_catalog' WHEN NOT use_schema THEN 'use_schema' WHEN NOT can_select THEN 'can_select' END AS first_missing FROM g")
def access_matrix(spark, sf_dir):
    privilege = F.when(F.col("o_orderstatus") == "F", "use_catalog").when(F.col("o_orderstatus") == "O", "use_schema").when(F.col("o_orderstatus") == "P", "can_select")
    return X.access_matrix(table(spark, sf_dir, "orders").select("o_custkey", privilege.alias("privilege")), "o_custkey", ["use_catalog", "use_schema", "can_select"])


@query("value_sensitivity", "WITH s AS (SELECT c_mktsegment AS scenario, count(*) AS weeks, sum(floor(c_acctbal)::BIGINT)::BIGINT AS costs FROM customer GROUP BY 1), h AS (SELECT unnest(generate_series(0, 40, 5)) AS hours), n AS (SELECT scenario, hours, hours * weeks * 60 - costs AS net FROM s, h) SELECT n.*, costs::DOUBLE / (weeks * 60)::DOUBLE AS break_even FROM n JOIN s USING (scenario)")
def value_sensitivity(spark, sf_dir):
    scenarios = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("scenario")).agg(F.count("*").alias("weeks"), F.sum(F.floor("c_acctbal")).alias("costs"))
    return X.value_sensitivity(scenarios, 60, 40, 5)


@query("published_as_of", "WITH p AS (SELECT o_orderdate::DATE AS day, row_number() OVER (ORDER BY o_orderdate::DATE) - 1 AS publication FROM orders GROUP BY 1) SELECT publication, count(*) AS rows, sum(floor(o_totalprice)::BIGINT)::BIGINT AS amount FROM orders JOIN p ON p.day = o_orderdate::DATE WHERE publication = 2 GROUP BY 1")
def published_as_of(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("snapshot_id"), F.floor("o_totalprice").alias("amount"))
    publications = rows.select("snapshot_id").distinct().withColumn("publication", (F.row_number().over(X.over(["snapshot_id"])) - 1).cast("long"))
    return X.as_of(rows, publications, "snapshot_id", "publication", 2).groupBy("publication").agg(F.count("*").alias("rows"), F.sum("amount").alias("amount"))


_SLICES = "a AS (SELECT doc_id AS id, n_chars AS updated, lang, text AS text FROM documents), b AS (SELECT doc_id AS id, n_chars + doc_id % 3 AS updated, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 4 = 0 THEN 'new ' || text ELSE text END AS text FROM documents WHERE doc_id % 2 = 0), ab AS (SELECT * FROM a UNION ALL SELECT * FROM b)"


def _slices(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a = d.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("updated"), "lang", "text")
    even = d.filter("doc_id % 2 = 0")
    b = even.select(F.col("doc_id").alias("id"), (F.col("n_chars") + F.col("doc_id") % 3).alias("updated"), F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("new "), "text")).otherwise(F.col("text")).alias("text"))
    return a, b


@query("merge_immutable", f"WITH {_SLICES}, c AS (SELECT id FROM (SELECT DISTINCT id, lang, text FROM ab) GROUP BY 1 HAVING count(*) > 1) SELECT DISTINCT id, lang, text FROM ab WHERE id NOT IN (SELECT id FROM c)")
def merge_immutable(spark, sf_dir):
    a, b = _slices(spark, sf_dir)
    return M.merge_immutable(a.unionByName(b), "id", ["lang", "text"])


@query("merge_immutable_conflicts", f"WITH {_SLICES} SELECT id FROM (SELECT DISTINCT id, lang, text FROM ab) GROUP BY 1 HAVING count(*) > 1")
def merge_immutable_conflicts(spark, sf_dir):
    a, b = _slices(spark, sf_dir)
    return M.sequence_conflicts(a.unionByName(b), "id", ["lang", "text"])


@query("merge_lww", f"WITH {_SLICES} SELECT id, max(updated) AS updated, max(lang) FILTER (WHERE updated = m) AS lang FROM (SELECT *, max(updated) OVER (PARTITION BY id) AS m FROM ab) GROUP BY 1")
def merge_lww(spark, sf_dir):
    a, b = _slices(spark, sf_dir)
    return M.merge_latest(a.unionByName(b), "id", "updated", ["lang"])


@query("merge_divergent_text", f"WITH {_SLICES}, n AS (SELECT id, text, max(updated) AS updated FROM ab GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated DESC, text DESC) AS place FROM n) SELECT CASE WHEN place = 1 THEN id::VARCHAR ELSE id || '-conflict-' || substr(sha256(coalesce(text, '')), 1, 12) END AS id, text, updated FROM r")
def merge_divergent_text(spark, sf_dir):
    a, b = _slices(spark, sf_dir)
    return M.merge_divergent(a.unionByName(b), "id", "updated", "text")


@query("merge_or_flag", "SELECT user_id, bool_or(event_type = 'signup') AS accepted FROM events GROUP BY 1")
def merge_or_flag(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "signup").alias("accepted"))


@query("import_preview", f"WITH {_SLICES} SELECT 'notes' AS family, (SELECT count(*) FROM b) AS rows, (SELECT count(*) FROM a JOIN b USING (id) WHERE a.text IS DISTINCT FROM b.text) AS divergent, (SELECT count(DISTINCT lang) FROM b WHERE lang NOT IN (SELECT lang FROM a WHERE lang IS NOT NULL)) AS unknown_refs")
def import_preview(spark, sf_dir):
    a, b = _slices(spark, sf_dir)
    return M.import_preview({"notes": b}, {"notes": a}, "id", "text", {"notes": ["lang"]}, a.select(F.col("lang").alias("id")))


@query("preview_basis_check", f"WITH {_SLICES} SELECT 1 AS preview, NOT EXISTS ((SELECT * FROM a ORDER BY id DESC) EXCEPT ALL (SELECT * FROM a)) AS unchanged UNION ALL SELECT 2, NOT EXISTS ((SELECT * FROM ab) EXCEPT ALL (SELECT * FROM a))")
def preview_basis_check(spark, sf_dir):
    """An import applies only to the state that was previewed: the same rows in another order pass, changed ones do not."""
    from tallyspark.plans.publish import content_id

    a, b = _slices(spark, sf_dir)
    basis = content_id(a)
    same = content_id(a.orderBy(F.desc("id"))).withColumn("preview", F.lit(1))
    other = content_id(a.unionByName(b)).withColumn("preview", F.lit(2))
    return same.unionByName(other).crossJoin(basis.withColumnRenamed("content_id", "basis")).select("preview", (F.col("content_id") == F.col("basis")).alias("unchanged"))


@query("family_counts", f"WITH {_SLICES} SELECT 'local' AS family, count(*) AS rows FROM a UNION ALL SELECT 'incoming', count(*) FROM b")
def family_counts(spark, sf_dir):
    a, b = _slices(spark, sf_dir)
    return a.withColumn("family", F.lit("local")).unionByName(b.withColumn("family", F.lit("incoming"))).groupBy("family").agg(F.count("*").alias("rows"))


@query("backup_frames", "WITH f AS (SELECT * FROM conversations WHERE NOT (conv_id % 3 = 0 AND turn = 1)) SELECT conv_id, count(*) AS parts, sum(strlen(text))::BIGINT AS bytes, CASE WHEN count(*) > count(DISTINCT turn) THEN 'repeated_part' WHEN min(turn) <> 0 OR max(turn) <> count(*) - 1 THEN 'missing_part' ELSE 'ok' END AS status FROM f GROUP BY 1")
def backup_frames(spark, sf_dir):
    frames = table(spark, sf_dir, "conversations").filter(~((F.col("conv_id") % 3 == 0) & (F.col("turn") == 1)))
    return M.frame_audit(frames, "conv_id", "turn", "text")


@query("backup_rejoin", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS data FROM conversations GROUP BY 1")
def backup_rejoin(spark, sf_dir):
    return M.rejoin_frames(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("state_size_budget", "WITH s AS (SELECT conv_id, sum(strlen('{\"turn\":' || turn || '}')) FILTER (WHERE turn > 0) AS bytes_before, sum(strlen('{\"turn\":' || turn || '}')) AS bytes_after FROM conversations GROUP BY 1) SELECT conv_id, coalesce(bytes_before, 0)::BIGINT AS bytes_before, bytes_after::BIGINT AS bytes_after, CASE WHEN bytes_after <= 30 THEN 'within' WHEN bytes_after <= coalesce(bytes_before, 0) THEN 'tolerated' ELSE 'refused' END AS status FROM s")
def state_size_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return M.state_sizes(rows.filter("turn > 0"), rows, "conv_id", 30)


@query("tail_of_days", "SELECT event_type, count(*) FILTER (WHERE value < 15)::DOUBLE / count(*) AS share_under, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS tail, count(*) FILTER (WHERE value < 15)::DOUBLE / count(*) >= 0.95 AS met FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1")
def tail_of_days(spark, sf_dir):
    """A range of days out of stored day sketches."""
    path = scratch(spark, "day-sketches")
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    X.day_sketches(events, "event_type", "day", "value", 15).write.partitionBy("day").parquet(path)
    return X.tail_of_days(spark.read.parquet(path).filter("day between '2024-01-05' and '2024-01-20'"), "event_type", 0.95)


@query("point_in_time_features", "WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT p.event_id, arg_max(e.value, (e.ts, e.event_id)) AS feature FROM p JOIN events e ON e.user_id = p.user_id AND e.event_type = 'view' AND e.ts <= p.ts GROUP BY 1), l AS (SELECT DISTINCT p.event_id FROM p JOIN events e ON e.user_id = p.user_id AND e.event_type = 'error' AND e.ts > p.ts AND e.ts <= p.ts + INTERVAL 24 HOUR) SELECT p.event_id, v.feature, l.event_id IS NOT NULL AS label FROM p LEFT JOIN v USING (event_id) LEFT JOIN l USING (event_id)")
def point_in_time_features(spark, sf_dir):
    return X.point_in_time(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "purchase", "view", "error", 24 * 3600)


@query("temporal_split", "SELECT event_id, CASE WHEN ('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 10 = 0 THEN 'held_out_entity' WHEN ts >= TIMESTAMP '2024-01-20' THEN 'future' ELSE 'train' END AS part FROM events")
def temporal_split(spark, sf_dir):
    return X.temporal_split(table(spark, sf_dir, "events"), "user_id", "ts", "2024-01-20 00:00:00", 10).select("event_id", "part")
