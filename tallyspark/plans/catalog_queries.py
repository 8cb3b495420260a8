"""Queries of catalog integrity, with the star schema as a catalog of entities and references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import rules
from tallyspark.operators import catalog as C
from tallyspark.plans.register import registry
from tallyspark.plans import views as V
from tallyspark.plans.views import table

QUERIES, SQL, query = registry()

_KEYS = {"order": ("orders", "o_orderkey"), "part": ("part", "p_partkey"), "supplier": ("supplier", "s_suppkey"), "customer": ("customer", "c_custkey"), "nation": ("nation", "n_nationkey"), "region": ("region", "r_regionkey")}


def entities(spark, sf_dir, but: str = "part") -> DataFrame:
    """All entities; of one kind every seventh is left out, so that references to it break."""
    parts = [table(spark, sf_dir, t).select(F.lit(kind).alias("kind"), F.col(c).cast("long").alias("id")).filter((F.lit(kind) != but) | (F.col("id") % 7 != 0)) for kind, (t, c) in _KEYS.items()]
    return reduce(DataFrame.unionByName, parts)


_EDGES = (("line_order", "lineitem", "l_orderkey", "order", "l_orderkey"), ("line_part", "lineitem", "l_orderkey", "part", "l_partkey"), ("line_supplier", "lineitem", "l_orderkey", "supplier", "l_suppkey"), ("order_customer", "orders", "o_orderkey", "customer", "o_custkey"), ("customer_nation", "customer", "c_custkey", "nation", "c_nationkey"), ("nation_region", "nation", "n_nationkey", "region", "n_regionkey"))


def edges(spark, sf_dir) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(k).alias("kind"), F.col(a).cast("long").alias("from_id"), F.lit(to).alias("to_kind"), F.col(b).cast("long").alias("to_id")) for k, t, a, to, b in _EDGES]
    return reduce(DataFrame.unionByName, parts)


_ENT = "ent AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {c}::BIGINT AS id FROM {t}" + (f" WHERE {c} % 7 <> 0" if k == "part" else "") for k, (t, c) in _KEYS.items()) + ")"
_EDG = "edg AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {a}::BIGINT AS from_id, '{to}' AS to_kind, {b}::BIGINT AS to_id FROM {t}" for k, t, a, to, b in _EDGES) + ")"


@query("ref_integrity", f"WITH {_ENT}, {_EDG} SELECT kind, from_id, to_id FROM edg WHERE NOT EXISTS (SELECT 1 FROM ent WHERE ent.kind = to_kind AND ent.id = to_id)")
def ref_integrity(spark, sf_dir):
    return C.ref_integrity(edges(spark, sf_dir), entities(spark, sf_dir))


@query("composite_ref_integrity", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE (l_partkey % 100, l_suppkey % 10) NOT IN (SELECT (p_partkey % 100, p_size % 10) FROM part)")
def composite_ref_integrity(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("a"), (F.col("p_size") % 10).cast("long").alias("b")).distinct()
    lines = table(spark, sf_dir, "lineitem").withColumns({"a": F.col("l_partkey") % 100, "b": F.col("l_suppkey") % 10})
    return lines.join(pairs, ["a", "b"], "left_anti").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("claim_sources", "SELECT DISTINCT l_orderkey, s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def claim_sources(spark, sf_dir):
    """Distinct sources (nations) that an item's (order's) claims (lines) cite."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("claims"))
    claims = items.select("l_orderkey", F.explode("claims").alias("s_suppkey"))
    return claims.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").select("l_orderkey", "s_nationkey").distinct()


@query("card_teaching_lookup", "WITH core AS (SELECT l_partkey AS k, min(l_orderkey) AS beat FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), ext AS (SELECT l_partkey AS k, max(l_orderkey) AS beat FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) SELECT p_partkey, coalesce(core.beat, ext.beat) AS beat, CASE WHEN core.beat IS NOT NULL THEN 'core' WHEN ext.beat IS NOT NULL THEN 'extension' END AS via FROM part LEFT JOIN core ON core.k = p_partkey LEFT JOIN ext ON ext.k = p_partkey")
def card_teaching_lookup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    core = lines.filter("l_linenumber = 1").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_orderkey").alias("core"))
    ext = lines.filter("l_linenumber = 2").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_orderkey").alias("ext"))
    both = table(spark, sf_dir, "part").select("p_partkey").join(core, "p_partkey", "left").join(ext, "p_partkey", "left")
    via = F.when(F.col("core").isNotNull(), "core").when(F.col("ext").isNotNull(), "extension")
    return both.select("p_partkey", F.coalesce("core", "ext").alias("beat"), via.alias("via"))


@query("teaching_target", "WITH q AS (SELECT l_orderkey AS id, min(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS owner, max(l_linenumber) AS last FROM lineitem GROUP BY 1) SELECT o_orderkey AS id, coalesce(owner, last, 0) AS target, CASE WHEN owner IS NOT NULL THEN 'owner' WHEN last IS NOT NULL THEN 'last' ELSE 'module' END AS via FROM orders LEFT JOIN q ON q.id = o_orderkey")
def teaching_target(spark, sf_dir):
    beats = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("owner"), F.max("l_linenumber").alias("last"))
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(beats, "id", "left")
    via = F.when(F.col("owner").isNotNull(), "owner").when(F.col("last").isNotNull(), "last").otherwise("module")
    return found.select("id", F.coalesce("owner", "last", F.lit(0)).alias("target"), via.alias("via"))


@query("catalog_counts", "SELECT n_regionkey AS course, n_nationkey AS module, count(DISTINCT c_custkey) AS lessons, count(o_orderkey) AS cards, count(DISTINCT o_orderpriority) AS diagrams FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY GROUPING SETS ((n_regionkey, n_nationkey), (n_regionkey))")
def catalog_counts(spark, sf_dir):
    n, c, o = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    rows = n.join(c, n.n_nationkey == c.c_nationkey).join(o, o.o_custkey == c.c_custkey, "left").select(F.col("n_regionkey").alias("course"), F.col("n_nationkey").alias("module"), "c_custkey", "o_orderkey", "o_orderpriority")
    return spark.sql("SELECT course, module, count(DISTINCT c_custkey) AS lessons, count(o_orderkey) AS cards, count(DISTINCT o_orderpriority) AS diagrams FROM {rows} GROUP BY GROUPING SETS ((course, module), (course))", rows=rows)


@query("contract_minimums", "WITH c AS (SELECT l_orderkey, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1) SELECT l_orderkey, 'lines' AS measure, lines AS count, 3::BIGINT AS minimum FROM c WHERE lines < 3 UNION ALL SELECT l_orderkey, 'suppliers', suppliers, 2::BIGINT FROM c WHERE suppliers < 2")
def contract_minimums(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_distinct("l_suppkey").alias("suppliers"))
    return C.contract_minimums(counts, {"lines": 3, "suppliers": 2})


@query("duplicate_ids", "SELECT id, count(*) AS times FROM (SELECT c_custkey AS id FROM customer UNION ALL SELECT s_suppkey FROM supplier UNION ALL SELECT p_partkey FROM part) GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("id")) for t, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))]
    return C.duplicate_ids(reduce(DataFrame.unionByName, parts), ["id"])


@query("duplicate_in_group", "SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_in_group(spark, sf_dir):
    return C.duplicate_ids(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("set_equality", "SELECT o_orderkey AS id, 'left' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') UNION ALL SELECT DISTINCT l_orderkey, 'right' FROM lineitem WHERE l_linestatus = 'F' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def set_equality(spark, sf_dir):
    shipped = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("id"))
    return C.set_difference(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), shipped, ["id"])


@query("unmapped_members", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 5)")
def unmapped_members(spark, sf_dir):
    mapped = table(spark, sf_dir, "lineitem").filter("l_linenumber = 5").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(mapped, "p_partkey", "left_anti")


@query("required_members", "WITH h AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'N') AS n, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) SELECT l_orderkey, concat_ws(',', CASE WHEN NOT a THEN 'A' END, CASE WHEN NOT n THEN 'N' END, CASE WHEN NOT r THEN 'R' END) AS missing FROM h WHERE NOT (a AND n AND r)")
def required_members(spark, sf_dir):
    return C.required_members(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"])


@query("answer_set_rule", "WITH o AS (SELECT l_orderkey, list(l_suppkey) AS options, max(l_partkey) % 50 AS answer FROM lineitem GROUP BY 1) SELECT l_orderkey, len(list_distinct(options)) < len(options) AS repeated, NOT list_contains(options, answer) AS no_answer FROM o WHERE len(list_distinct(options)) < len(options) OR NOT list_contains(options, answer)")
def answer_set_rule(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("options"), (F.max("l_partkey") % 50).alias("answer"))
    repeated, lost = F.size(F.array_distinct("options")) < F.size("options"), ~F.array_contains("options", F.col("answer"))
    return sets.filter(repeated | lost).select("l_orderkey", repeated.alias("repeated"), lost.alias("no_answer"))


@query("preserved_ids", "SELECT 'line' AS family, l_orderkey AS parent, l_linenumber AS id FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_returnflag <> 'N')")
def preserved_ids(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    ids = lambda df: df.select(F.lit("line").alias("family"), F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("id")).distinct()
    return ids(lines).join(ids(lines.filter("l_returnflag <> 'N'")), ["family", "parent", "id"], "left_anti")


@query("documented_claims", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def documented_claims(spark, sf_dir):
    cited = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("sources"))
    claims = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey").join(cited, "o_orderkey", "left")
    return claims.filter(F.coalesce(F.size("sources"), F.lit(0)) <= 0).select("o_orderkey")


@query("unknown_refs", "WITH r AS (SELECT DISTINCT unnest([l_partkey, l_suppkey, l_orderkey])::VARCHAR AS ref FROM lineitem) SELECT ref FROM r WHERE ref NOT IN (SELECT p_partkey::VARCHAR FROM part UNION SELECT s_suppkey::VARCHAR FROM supplier)")
def unknown_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").selectExpr("stack(3, l_partkey, l_suppkey, l_orderkey) AS ref").select(F.col("ref").cast("string").alias("ref")).distinct()
    known = C.known_ids([table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "supplier").select("s_suppkey")])
    return refs.join(known.withColumnRenamed("id", "ref"), "ref", "left_anti")


@query("known_ids", "SELECT p_partkey::VARCHAR AS id FROM part UNION SELECT s_suppkey::VARCHAR FROM supplier UNION SELECT n_name FROM nation UNION SELECT r_name FROM region")
def known_ids(spark, sf_dir):
    return C.known_ids([table(spark, sf_dir, t).select(c) for t, c in (("part", "p_partkey"), ("supplier", "s_suppkey"), ("nation", "n_name"), ("region", "r_name"))])


@query("collect_all_ids", "SELECT 'region' AS kind, r_regionkey::VARCHAR AS id FROM region UNION SELECT 'nation', n_nationkey::VARCHAR FROM nation UNION SELECT 'customer', c_custkey::VARCHAR FROM customer")
def collect_all_ids(spark, sf_dir):
    """Ids at every depth of nested region documents (region, its nations, their customers), several for a nation of many."""
    customers = V.in_parts(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey")
    c = customers.groupBy(F.col("c_nationkey").alias("n_nationkey"), "part").agg(F.collect_list(F.struct(F.col("c_custkey").cast("string").alias("id"))).alias("customers"))
    n = table(spark, sf_dir, "nation").join(c, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey"), "part").agg(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("id"), "customers")).alias("nations"))
    docs = table(spark, sf_dir, "region").join(n, "r_regionkey", "left")
    whole = docs.select(F.to_json(F.struct(F.col("r_regionkey").cast("string").alias("id"), "nations")).alias("doc"))
    kind = F.when(F.col("path") == "", "region").when(F.col("path") == "nations", "nation").when(F.col("path") == "nations.customers", "customer")
    return C.all_ids(whole, "doc").select(kind.alias("kind"), "id")


@query("source_register", "WITH u AS (SELECT l_suppkey AS source, 'line' AS use, l_orderkey AS claim FROM lineitem UNION ALL SELECT s_suppkey, 'supplier', s_nationkey FROM supplier) SELECT source, use, count(DISTINCT claim) AS claims, bool_or(s_acctbal > 0) AS reachable FROM u LEFT JOIN supplier ON s_suppkey = source GROUP BY 1, 2")
def source_register(spark, sf_dir):
    """Uses of each source with their claims; reachability comes from a table of probe results (positive balance)."""
    s = table(spark, sf_dir, "supplier")
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.lit("line").alias("use"), F.col("l_orderkey").alias("claim")).unionByName(s.select(F.col("s_suppkey").alias("source"), F.lit("supplier").alias("use"), F.col("s_nationkey").cast("long").alias("claim")))
    probes = s.select(F.col("s_suppkey").alias("source"), (F.col("s_acctbal") > 0).alias("reachable"))
    register = uses.groupBy("source", "use").agg(F.count_distinct("claim").alias("claims"))
    return register.join(probes, "source", "left")


_STEPS = "g AS (SELECT l_orderkey AS path, l_linenumber AS group_pos, l_partkey AS lesson_pos, min(l_suppkey) AS lesson FROM lineitem GROUP BY 1, 2, 3), st AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY group_pos, lesson_pos)::INT AS place, lesson FROM g)"


def _groups(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("group_pos"), F.col("l_partkey").alias("lesson_pos"), F.col("l_suppkey").alias("lesson"))
    return C.least_lessons(rows)


def _steps(spark, sf_dir):
    return C.path_steps(_groups(spark, sf_dir))


@query("path_order", f"WITH {_STEPS} SELECT * FROM st")
def path_order(spark, sf_dir):
    return _steps(spark, sf_dir)


@query("path_neighbors", f"WITH {_STEPS}, b AS (SELECT o_orderkey AS path, -1::BIGINT AS lesson, arg_min(st.lesson, st.place) AS next FROM orders JOIN st ON st.path = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1) SELECT path, lesson, lag(lesson) OVER w AS previous, lead(lesson) OVER w AS next FROM st WINDOW w AS (PARTITION BY path ORDER BY place) UNION ALL SELECT path, lesson, NULL, next FROM b")
def path_neighbors(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("path"), F.lit(-1).cast("long").alias("lesson"))
    return C.path_neighbours(_groups(spark, sf_dir), urgent)


@query("path_membership", f"WITH {_STEPS} SELECT DISTINCT lesson, min(path) OVER (PARTITION BY lesson) AS path FROM st")
def path_membership(spark, sf_dir):
    return _steps(spark, sf_dir).groupBy("lesson").agg(F.min("path").alias("path"))


@query("path_topic_count", "SELECT l_orderkey AS path, count(DISTINCT l_linenumber) AS groups, count(*) AS lessons FROM lineitem GROUP BY 1")
def path_topic_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.count_distinct("l_linenumber").alias("groups"), F.count("*").alias("lessons"))


@query("path_rules", f"WITH {_STEPS}, d AS (SELECT path, lesson, count(*) AS n FROM st GROUP BY 1, 2) SELECT 'duplicate_lesson' AS rule, path, lesson FROM d WHERE n > 1 UNION ALL SELECT 'bridge_also_required', o_orderkey, o_custkey % 10 FROM orders WHERE (o_orderkey, o_custkey % 10) IN (SELECT (path, lesson) FROM d) UNION ALL SELECT 'prerequisite_outside_path', o_orderkey, o_custkey % 10 FROM orders WHERE o_orderkey IN (SELECT path FROM d) AND (o_orderkey, o_custkey % 10) NOT IN (SELECT (path, lesson) FROM d)")
def path_rules(spark, sf_dir):
    steps = _steps(spark, sf_dir)
    held = steps.select("path", "lesson").distinct()
    named = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 10).alias("lesson"))
    twice = C.duplicate_ids(steps, ["path", "lesson"]).select(F.lit("duplicate_lesson").alias("rule"), "path", "lesson")
    both = named.join(held, ["path", "lesson"], "left_semi").select(F.lit("bridge_also_required").alias("rule"), "path", "lesson")
    outside = named.join(held.select("path").distinct(), "path", "left_semi").join(held, ["path", "lesson"], "left_anti").select(F.lit("prerequisite_outside_path").alias("rule"), "path", "lesson")
    return twice.unionByName(both).unionByName(outside)


@query("playbook_target_rules", "WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS scenario, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 7 END AS lesson, CASE WHEN o_orderkey % 5 = 0 THEN 1 END AS section FROM orders) SELECT id, CASE WHEN scenario IS NOT NULL AND lesson IS NOT NULL THEN 'scenario_and_lesson' WHEN section IS NOT NULL AND lesson IS NULL THEN 'section_without_lesson' WHEN scenario IS NULL AND lesson IS NULL THEN 'no_target' ELSE 'unknown_target' END AS rule FROM t WHERE (scenario IS NOT NULL AND lesson IS NOT NULL) OR (section IS NOT NULL AND lesson IS NULL) OR (scenario IS NULL AND lesson IS NULL) OR coalesce(scenario, lesson) NOT IN (SELECT c_custkey FROM customer)")
def playbook_target_rules(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    targets = table(spark, sf_dir, "orders").select(key.alias("id"), F.when(key % 3 == 0, cust).alias("scenario"), F.when(key % 2 == 0, cust + 7).alias("lesson"), F.when(key % 5 == 0, 1).alias("section"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target"), F.lit(True).alias("found"))
    rows = targets.withColumn("target", F.coalesce("scenario", "lesson")).join(known, "target", "left")
    has = lambda c: F.col(c).isNotNull()
    rule = F.when(has("scenario") & has("lesson"), "scenario_and_lesson").when(has("section") & ~has("lesson"), "section_without_lesson").when(~has("target"), "no_target").when(~has("found"), "unknown_target")
    return rows.withColumn("rule", rule).filter("rule is not null").select("id", "rule")


@query("card_filter", "SELECT l_orderkey AS module, l_partkey AS card, min(CASE WHEN l_linenumber <= 3 THEN 'core' ELSE 'extension' END) AS scope FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2")
def card_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("module"), F.col("l_partkey").alias("card"), F.array("l_returnflag").alias("concepts"), "l_linenumber")
    scoped = lines.filter("l_linenumber <= 3").withColumn("scope", F.lit("core")).unionByName(lines.filter("l_linenumber > 3").withColumn("scope", F.lit("extension")))
    wanted = scoped.filter(F.array_contains("concepts", F.lit("A")) | F.array_contains("concepts", F.lit("R")))
    return wanted.groupBy("module", "card").agg(F.min("scope").alias("scope"))


_PRE = "pre AS (SELECT s_suppkey AS src, (s_suppkey * 7) % (SELECT count(*) FROM supplier) AS dst FROM supplier WHERE s_suppkey % 4 <> 3)"


def _prerequisites(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.crossJoin(s.agg(F.count("*").alias("n"))).filter("s_suppkey % 4 <> 3").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") * 7 % F.col("n")).alias("dst"))


@query("prereq_resolve", f"WITH {_PRE} SELECT src, dst FROM pre WHERE dst NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def prereq_resolve(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("dst"))
    return _prerequisites(spark, sf_dir).join(known, "dst", "left_anti").select("src", "dst")


@query("prereq_cycles", "WITH RECURSIVE " + _PRE + ", r AS (SELECT src, dst FROM pre UNION SELECT r.src, pre.dst FROM r JOIN pre ON pre.src = r.dst) SELECT DISTINCT src AS id FROM r WHERE src = dst")
def prereq_cycles(spark, sf_dir):
    return C.cycle_nodes(_prerequisites(spark, sf_dir))


@query("graph_edge_rules", "SELECT l_orderkey AS stage, l_linenumber AS from_node, l_linenumber + 1 AS to_node FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)")
def graph_edge_rules(spark, sf_dir):
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stage"), F.col("l_linenumber").alias("to_node"))
    links = nodes.select("stage", F.col("to_node").alias("from_node"), (F.col("to_node") + 1).alias("to_node"))
    return links.join(nodes.distinct(), ["stage", "to_node"], "left_anti").select("stage", "from_node", "to_node")


@query("id_format_rule", "SELECT CASE WHEN NOT regexp_matches(p_name, '^[a-z]+ [a-z]{3,4}$') THEN 'id_format' END AS rule, 'part' AS entity_kind, p_partkey::VARCHAR AS entity_id FROM part WHERE NOT regexp_matches(p_name, '^[a-z]+ [a-z]{3,4}$') UNION ALL SELECT 'size_range', 'part', p_partkey::VARCHAR FROM part WHERE NOT p_size BETWEEN 5 AND 40 UNION ALL SELECT 'type_enum', 'part', p_partkey::VARCHAR FROM part WHERE p_type NOT IN ('ECONOMY', 'STANDARD')")
def id_format_rule(spark, sf_dir):
    checks = [rules.Rule("id_format", ~F.col("p_name").rlike("^[a-z]+ [a-z]{3,4}$")), rules.Rule("size_range", ~F.col("p_size").between(5, 40)), rules.Rule("type_enum", ~F.col("p_type").isin("ECONOMY", "STANDARD"))]
    return rules.violations(table(spark, sf_dir, "part"), "part", "p_partkey", checks)


@query("media_segment_rule", "SELECT event_id, concat_ws(',', CASE WHEN value >= 40 THEN 'start_after_duration' END, CASE WHEN event_id % 60 <= value THEN 'end_before_start' END, CASE WHEN event_id % 60 > 40 THEN 'end_after_duration' END, CASE WHEN event_type = 'view' AND user_id % 2 = 0 THEN 'verified_without_player' END) AS reasons FROM events")
def media_segment_rule(spark, sf_dir):
    player = F.when(F.col("user_id") % 2 != 0, F.lit("player"))
    why = C.media_reasons(F.col("value"), (F.col("event_id") % 60).cast("double"), F.lit(40.0), F.col("event_type") == "view", player)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(why, ",").alias("reasons"))


@query("payload_bound", "SELECT doc_id, strlen(text) AS bytes FROM documents WHERE strlen(text) > 5000")
def payload_bound(spark, sf_dir):
    size = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").filter(size > 5000).select("doc_id", size.alias("bytes"))


@query("table_shape_rule", "SELECT l_orderkey, count(*) AS rows FROM lineitem GROUP BY 1 HAVING bool_or(l_linenumber > 5)")
def table_shape_rule(spark, sf_dir):
    """Tables (orders) with a row (line) of more cells than the five columns."""
    cells = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(5), F.col("l_linenumber"))), lambda i: i.cast("string"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.size(cells) != 5).alias("wrong"))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("rows"), F.bool_or("wrong").alias("wrong")).filter("wrong").drop("wrong")


@query("section_assignment_audit", "WITH m AS (SELECT conv_id, turn % 3 AS section FROM conversations), d AS (SELECT DISTINCT conv_id, unnest([0, 1]) AS section FROM conversations), u AS (SELECT conv_id, section, 'repeated_marker' AS problem FROM m GROUP BY 1, 2 HAVING count(*) > 1) SELECT * FROM u UNION ALL SELECT DISTINCT conv_id, section, 'undeclared_section' FROM m WHERE (conv_id, section) NOT IN (SELECT (conv_id, section) FROM d) UNION ALL SELECT conv_id, section, 'missing_marker' FROM d WHERE (conv_id, section) NOT IN (SELECT (conv_id, section) FROM m)")
def section_assignment_audit(spark, sf_dir):
    markers = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") % 3).alias("section"))
    declared = markers.select("conv_id").distinct().withColumn("section", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    twice = C.duplicate_ids(markers, ["conv_id", "section"]).select("conv_id", "section", F.lit("repeated_marker").alias("problem"))
    sides = C.set_difference(markers, declared, ["conv_id", "section"])
    return twice.unionByName(sides.select("conv_id", "section", F.when(F.col("side") == "left", "undeclared_section").otherwise("missing_marker").alias("problem")))
