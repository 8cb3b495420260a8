"""Queries of record reconciliation over the ``lineitem`` deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import rules
from tallyspark.functions.scratch import scratch
from tallyspark.operators import resolve as R
from tallyspark.operators.resolve_state import ResolverState
from tallyspark.plans import views as V
from tallyspark.plans.register import registry

QUERIES, SQL, query = registry()

#: The same relations as plain SQL: flags over the distinct deliveries by windows; each relation is then one filter.
_BASE = """, u AS (SELECT DISTINCT * FROM {src}),
flagged AS (SELECT *,
  coalesce(regexp_matches(event_id, '[^ \\t\\r\\n]'), false) AS named, coalesce(regexp_matches(inspection_id, '[^ \\t\\r\\n]'), false) AS keyed, coalesce(version > 0, false) AS ordered,
  coalesce(inspected_units >= 0 AND defective_units BETWEEN 0 AND inspected_units, false) AS counted, {'i': inspected_units, 'd': defective_units}::VARCHAR AS quantities FROM u),
marked AS (SELECT *, named AND keyed AND ordered AND counted AS valid, named AND count(*) OVER (PARTITION BY event_id) > 1 AS doubted,
  ordered AND min(quantities) OVER revision < max(quantities) OVER revision AS split, max(version) FILTER (ordered) OVER key AS top, bool_or(named AND keyed AND ordered AND counted) OVER key AS known
  FROM flagged WINDOW revision AS (PARTITION BY inspection_id, version), key AS (PARTITION BY inspection_id)),
judged AS (SELECT *, bool_or(doubted OR split OR known AND NOT ordered OR known AND version = top AND NOT valid) OVER (PARTITION BY inspection_id) AS blocked FROM marked),
k AS (SELECT event_id, inspection_id, version, inspected_units, defective_units, valid FROM judged),
ec AS (SELECT event_id, count(*) AS deliveries FROM judged WHERE doubted GROUP BY 1),
rc AS (SELECT inspection_id, version, count(DISTINCT quantities) AS payloads FROM judged WHERE split GROUP BY 1, 2),
un AS (SELECT DISTINCT inspection_id FROM judged WHERE blocked),
ex AS (SELECT DISTINCT inspection_id FROM judged WHERE NOT known AND NOT blocked),
ac AS (SELECT DISTINCT inspection_id, version, inspected_units, defective_units FROM judged WHERE valid AND version = top AND NOT blocked),
tt AS (SELECT sum(inspected_units)::BIGINT AS inspected_units, sum(defective_units)::BIGINT AS defective_units,
  sum(defective_units)::DOUBLE / nullif(sum(inspected_units), 0)::DOUBLE AS defect_rate FROM ac),
gt AS (SELECT (SELECT count(*) FROM ec) AS event_conflicts, (SELECT count(*) FROM rc) AS revision_conflicts, (SELECT count(*) FROM un) AS unresolved_keys)
"""


def _sql(tail: str, view: str = V.D1, src: str = "d1") -> str:
    return "WITH " + view + _BASE.replace("{src}", src) + tail


def _found(spark, sf_dir, view=V.deliveries):
    return R.resolve(view(spark, sf_dir))


@query("project_derive", f"WITH {V.D1} SELECT inspection_id, inspected_units - defective_units AS sound_units, inspected_units::DOUBLE AS inspected FROM d1 WHERE inspected_units >= 0 AND defective_units BETWEEN 0 AND inspected_units")
def project_derive(spark, sf_dir):
    valid = filter_valid(V.deliveries(spark, sf_dir))
    return valid.select("inspection_id", (F.col("inspected_units") - F.col("defective_units")).alias("sound_units"), F.col("inspected_units").cast("double").alias("inspected"))


def filter_valid(rows):
    inspected, defective = F.col("inspected_units"), F.col("defective_units")
    return rows.filter(inspected.isNotNull() & defective.isNotNull() & (inspected >= 0) & (defective >= 0) & (defective <= inspected))


@query("filter_valid_quantity", f"WITH {V.D1} SELECT * FROM d1 WHERE inspected_units >= 0 AND defective_units BETWEEN 0 AND inspected_units")
def filter_valid_quantity(spark, sf_dir):
    return filter_valid(V.deliveries(spark, sf_dir))


@query("null_predicate", "SELECT count(*) FILTER (WHERE v = NULL) AS equals_null, count(*) FILTER (WHERE v IS NULL) AS is_null, count(*) FILTER (WHERE v IS NOT DISTINCT FROM NULL) AS null_safe FROM (SELECT nullif(event_type, 'error') AS v FROM events)")
def null_predicate(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events").select(F.nullif("event_type", F.lit("error")).alias("v"))
    null = F.lit(None).cast("string")
    return rows.agg(F.count_if(F.col("v") == null).alias("equals_null"), F.count_if(F.col("v").isNull()).alias("is_null"), F.count_if(F.col("v").eqNullSafe(null)).alias("null_safe"))


@query("safe_cast", "SELECT p_brand, count(try_cast(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INT)) AS numbers, count(*) FILTER (WHERE try_cast(p_brand AS INT) IS NULL) AS rejected FROM part GROUP BY 1")
def safe_cast(spark, sf_dir):
    digits = F.regexp_replace("p_brand", "[^0-9]", "").try_cast("int")
    return V.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(digits).alias("numbers"), F.count_if(F.col("p_brand").try_cast("int").isNull()).alias("rejected"))


_BLANK = "\\t\\n\\x0b\\x0c\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


@query("nonblank_key", f"SELECT doc_id, regexp_matches(coalesce(text, ''), '[^{_BLANK}]') AS keyed FROM documents UNION ALL SELECT doc_id, false FROM documents WHERE text IS NOT NULL")
def nonblank_key(spark, sf_dir):
    """Whole texts, and the white space of each text alone, as keys."""
    docs = V.table(spark, sf_dir, "documents")
    blank = F.regexp_replace("text", r"(?U)[^\s\x1c-\x1f]", "")
    return docs.select("doc_id", rules.nonblank(F.col("text")).alias("keyed")).unionByName(docs.filter("text is not null").select("doc_id", rules.nonblank(blank).alias("keyed")))


@query("positive_revision", "SELECT l_orderkey, l_linenumber, (l_linenumber - 2) BETWEEN 1 AND 2147483647 AS usable FROM lineitem")
def positive_revision(spark, sf_dir):
    return V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rules.positive_int(F.col("l_linenumber") - 2).alias("usable"))


@query("validity_flag", _sql("SELECT event_id, inspection_id, version, inspected_units, defective_units, valid FROM k"))
def validity_flag(spark, sf_dir):
    return _found(spark, sf_dir).rows.select("event_id", *R.Policy().payload, "valid")


@query("row_reasons", f"WITH {V.D1} SELECT DISTINCT event_id, inspection_id, version, inspected_units, defective_units, array_to_string(list_filter([CASE WHEN version - 1 < 1 THEN 'invalid_version' END, CASE WHEN defective_units > inspected_units THEN 'defective_exceeds_inspected' END], lambda x: x IS NOT NULL), ',') AS reasons FROM d1")
def row_reasons(spark, sf_dir):
    rows = V.deliveries(spark, sf_dir).distinct()
    why = rows.withColumn("version", F.col("version") - 1).withColumn("reasons", F.array_join(rules.reasons(rules.delivery_rules()), ","))
    return why.withColumn("version", F.col("version") + 1)


@query("quarantine_split", _sql("SELECT valid, count(*) AS rows FROM k GROUP BY 1"))
def quarantine_split(spark, sf_dir):
    found = _found(spark, sf_dir)
    kept = found.rows.filter("valid").agg(F.lit(True).alias("valid"), F.count("*").alias("rows"))
    return kept.unionByName(found.quarantine().agg(F.lit(False).alias("valid"), F.count("*").alias("rows")))


@query("coverage_gap", _sql("SELECT (SELECT count(*) FROM d1) AS raw, (SELECT count(*) FROM u) AS distinct, (SELECT count(*) FROM k WHERE NOT valid) AS quarantined, (SELECT count(*) FROM k WHERE valid) AS valid, (SELECT count(*) FROM ac) AS accepted, (SELECT count(*) FROM ex) AS excluded, (SELECT count(*) FROM un) AS withheld"))
def coverage_gap(spark, sf_dir):
    raw = V.deliveries(spark, sf_dir)
    return R.coverage(R.resolve(raw), raw)


@query("stage_counts", _sql("SELECT (SELECT count(*) FROM d1r) AS raw, (SELECT count(*) FROM u) AS distinct, (SELECT count(*) FROM k WHERE NOT valid) AS quarantined, (SELECT count(*) FROM k WHERE valid) AS valid, (SELECT count(*) FROM ac) AS accepted", V.D1R, "d1r"))
def stage_counts(spark, sf_dir):
    raw = V.replayed(spark, sf_dir)
    return R.coverage(R.resolve(raw), raw).drop("excluded", "withheld")


@query("distinct_delivery", f"WITH {V.D1R} SELECT DISTINCT * FROM d1r")
def distinct_delivery(spark, sf_dir):
    return R.distinct_deliveries(V.replayed(spark, sf_dir))


@query("event_conflicts", _sql("SELECT event_id, deliveries FROM ec"))
def event_conflicts(spark, sf_dir):
    return _found(spark, sf_dir).event_conflicts()


@query("revision_conflicts", _sql("SELECT inspection_id, version, payloads FROM rc"))
def revision_conflicts(spark, sf_dir):
    return _found(spark, sf_dir).revision_conflicts()


_EVIDENCE = """, x AS (SELECT 'event_id' AS kind, event_id AS identity, arrival_seq FROM d1a WHERE event_id IN (SELECT event_id FROM ec)
  UNION ALL SELECT 'key_version', inspection_id || '@' || version, arrival_seq FROM d1a JOIN rc USING (inspection_id, version)),
y AS (SELECT *, (row_number() OVER (PARTITION BY kind, identity ORDER BY arrival_seq) - 1) // 1000 AS part FROM x)
SELECT kind, identity, part, array_to_string(list(arrival_seq ORDER BY arrival_seq), ',') AS arrivals FROM y GROUP BY ALL"""


@query("conflict_evidence", "WITH " + V.D1A + _BASE.replace("{src}", "(SELECT event_id, inspection_id, version, inspected_units, defective_units FROM d1a)") + _EVIDENCE)
def conflict_evidence(spark, sf_dir):
    rows = R.conflict_evidence(V.arrivals(spark, sf_dir))
    return rows.withColumn("arrivals", F.array_join(F.col("arrivals").cast("array<string>"), ","))


@query("quarantined_arrivals", f"WITH {V.D1A} SELECT arrival_seq, event_id, 'defective_exceeds_inspected' AS reasons FROM d1a WHERE defective_units > inspected_units")
def quarantined_arrivals(spark, sf_dir):
    """Quarantined arrivals with their position; the given deliveries fail no other rule."""
    rows = R.quarantined_arrivals(V.arrivals(spark, sf_dir))
    return rows.select("arrival_seq", "event_id", F.array_join("reasons", ",").alias("reasons"))


@query("latest_revision", _sql("SELECT DISTINCT inspection_id, top AS version FROM judged WHERE top IS NOT NULL"))
def latest_revision(spark, sf_dir):
    return _found(spark, sf_dir).keys.filter("latest is not null").select("inspection_id", F.col("latest").alias("version"))


@query("current_rows", _sql("SELECT event_id, inspection_id, version, inspected_units, defective_units, valid FROM judged WHERE version = top"))
def current_rows(spark, sf_dir):
    found = _found(spark, sf_dir)
    latest = found.keys.select("inspection_id", F.col("latest").alias("version"))
    return found.rows.join(latest, ["inspection_id", "version"], "left_semi").select("event_id", *R.Policy().payload, "valid")


@query("known_valid_keys", _sql("SELECT DISTINCT inspection_id FROM judged WHERE known"))
def known_valid_keys(spark, sf_dir):
    return _found(spark, sf_dir).keys.filter("known").select("inspection_id")


@query("invalid_latest", _sql("SELECT DISTINCT inspection_id FROM judged WHERE known AND version = top AND NOT valid"))
def invalid_latest(spark, sf_dir):
    return _found(spark, sf_dir).keys.filter("invalid_latest").select("inspection_id")


_UNORDERED = "d1u AS (SELECT event_id, inspection_id, CASE WHEN version = 7 THEN NULL ELSE version END AS version, inspected_units, defective_units FROM d1)"


def _unordered(spark, sf_dir):
    return V.deliveries(spark, sf_dir).withColumn("version", F.when(F.col("version") != 7, F.col("version")))


@query("unordered_known", _sql("SELECT DISTINCT inspection_id FROM judged WHERE known AND NOT ordered", V.D1 + ", " + _UNORDERED, "d1u"))
def unordered_known(spark, sf_dir):
    return R.resolve(_unordered(spark, sf_dir)).keys.filter("unordered_known").select("inspection_id")


@query("unresolved_keys", _sql("SELECT inspection_id FROM un", V.D1 + ", " + _UNORDERED, "d1u"))
def unresolved_keys(spark, sf_dir):
    return R.resolve(_unordered(spark, sf_dir)).unresolved()


@query("excluded_keys", _sql("SELECT inspection_id FROM ex"))
def excluded_keys(spark, sf_dir):
    return _found(spark, sf_dir).excluded()


@query("accepted_state", _sql("SELECT * FROM ac"))
def accepted_state(spark, sf_dir):
    return _found(spark, sf_dir).accepted()


@query("accepted_state_replay", _sql("SELECT * FROM ac", V.D1R, "d1r"))
def accepted_state_replay(spark, sf_dir):
    return R.resolve(V.replayed(spark, sf_dir)).accepted()


@query("publication_gate", _sql("SELECT *, event_conflicts = 0 AND revision_conflicts = 0 AND unresolved_keys = 0 AS publication_allowed FROM gt"))
def publication_gate(spark, sf_dir):
    return _found(spark, sf_dir).gate()


@query("publication_gate_clean", _sql("SELECT *, event_conflicts = 0 AND revision_conflicts = 0 AND unresolved_keys = 0 AS publication_allowed FROM gt", V.D1C, "d1c"))
def publication_gate_clean(spark, sf_dir):
    return _found(spark, sf_dir, V.clean).gate()


@query("weighted_totals", _sql("SELECT * FROM tt"))
def weighted_totals(spark, sf_dir):
    return _found(spark, sf_dir).totals()


@query("resolve_history", _sql("SELECT 'accepted' AS relation, count(*) AS rows FROM ac UNION ALL SELECT 'quarantine', count(*) FROM k WHERE NOT valid UNION ALL SELECT 'event_conflicts', count(*) FROM ec UNION ALL SELECT 'revision_conflicts', count(*) FROM rc UNION ALL SELECT 'unresolved', count(*) FROM un"))
def resolve_history(spark, sf_dir):
    found = _found(spark, sf_dir)
    parts = {"accepted": found.accepted(), "quarantine": found.quarantine(), "event_conflicts": found.event_conflicts(), "revision_conflicts": found.revision_conflicts(), "unresolved": found.unresolved()}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.lit(name).alias("relation"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


#: The resolution as Spark SQL: one statement for each relation over the same common table expressions.
_NONBLANK = "coalesce({} RLIKE r'(?U)[^\\s\\x1c-\\x1f]', false)"
_RESOLVE_SQL = f"""
WITH u AS (SELECT DISTINCT event_id, inspection_id, version, inspected_units, defective_units FROM {{raw}}),
k AS (SELECT *, {_NONBLANK.format("event_id")} AND {_NONBLANK.format("inspection_id")} AND coalesce(version > 0, false)
  AND coalesce(inspected_units >= 0 AND defective_units >= 0 AND defective_units <= inspected_units, false) AS valid FROM u),
e AS (SELECT event_id, count_if({_NONBLANK.format("event_id")}) AS deliveries FROM u GROUP BY event_id HAVING deliveries > 1),
d AS (SELECT DISTINCT inspection_id AS doubted FROM {{raw}} WHERE event_id IN (SELECT event_id FROM e)),
v AS (SELECT inspection_id, CASE WHEN version > 0 THEN version END AS version, bool_and(valid) AS sound, bool_or(valid) AS known, max(version) > 0
  AND (min(inspected_units) < max(inspected_units) OR min(defective_units) < max(defective_units) OR bool_or(inspected_units IS NULL) AND max(inspected_units) IS NOT NULL
  OR bool_or(defective_units IS NULL) AND max(defective_units) IS NOT NULL) AS split, max(inspected_units) AS inspected_units, max(defective_units) AS defective_units
  FROM k GROUP BY 1, 2 HAVING bool_or({_NONBLANK.format("inspection_id")})),
s AS (SELECT inspection_id, max(version) AS version, max_by(sound, version) AS sound, max_by(inspected_units, version) AS inspected_units, max_by(defective_units, version) AS defective_units,
  bool_or(known) AS known, count_if(split) AS splits, bool_or(version IS NULL) AS unordered FROM v GROUP BY 1),
j AS (SELECT s.*, doubted IS NOT NULL OR splits > 0 OR known AND (unordered OR NOT coalesce(sound, false)) AS blocked FROM s LEFT JOIN d ON inspection_id = doubted),
a AS (SELECT inspection_id, version, inspected_units, defective_units FROM j WHERE known AND NOT blocked)
"""
_TOTALS = "sum(inspected_units){only} AS inspected_units, sum(defective_units){only} AS defective_units, try_divide(CAST(sum(defective_units){only} AS DOUBLE), CAST(sum(inspected_units){only} AS DOUBLE)) AS defect_rate"
_GATE = ", g AS (SELECT * FROM (SELECT count(*) AS event_conflicts FROM e) CROSS JOIN (SELECT coalesce(sum(splits), 0) AS revision_conflicts, count_if(blocked) AS unresolved_keys{more} FROM j)) "
_ALLOWED = "event_conflicts = 0 AND revision_conflicts = 0 AND unresolved_keys = 0 AS publication_allowed"
RESOLVE_SQL = {
    "accepted": _RESOLVE_SQL + "SELECT * FROM a",
    "unresolved": _RESOLVE_SQL + "SELECT inspection_id FROM j WHERE blocked",
    "event_conflicts": _RESOLVE_SQL + "SELECT event_id, deliveries FROM e",
    "revision_conflicts": _RESOLVE_SQL + "SELECT inspection_id, version, count(DISTINCT struct(inspected_units, defective_units)) AS payloads FROM k LEFT SEMI JOIN (SELECT * FROM v WHERE split) USING (inspection_id, version) GROUP BY 1, 2",
    "totals": _RESOLVE_SQL + f"SELECT {_TOTALS.format(only='')} FROM a",
    "gate": _RESOLVE_SQL + _GATE.format(more="") + f"SELECT *, {_ALLOWED} FROM g",
    # the gate and the totals of one pass
    "gate_totals": _RESOLVE_SQL + _GATE.format(more=", " + _TOTALS.format(only=" FILTER (WHERE known AND NOT blocked)")) + f"SELECT event_conflicts, revision_conflicts, unresolved_keys, {_ALLOWED}, inspected_units, defective_units, defect_rate FROM g",
}


@query("resolve_sql", _sql("SELECT * FROM ac"))
def resolve_sql(spark, sf_dir):
    return spark.sql(RESOLVE_SQL["accepted"], raw=V.deliveries(spark, sf_dir))


@query("resolve_sql_unresolved", _sql("SELECT inspection_id FROM un"))
def resolve_sql_unresolved(spark, sf_dir):
    return spark.sql(RESOLVE_SQL["unresolved"], raw=V.deliveries(spark, sf_dir))


@query("resolve_sql_conflicts", _sql("SELECT 'event_id' AS kind, event_id AS identity, deliveries AS times FROM ec UNION ALL SELECT 'key_version', inspection_id || '@' || version, payloads FROM rc"))
def resolve_sql_conflicts(spark, sf_dir):
    raw = V.deliveries(spark, sf_dir)
    events = spark.sql(RESOLVE_SQL["event_conflicts"], raw=raw).select(F.lit("event_id").alias("kind"), F.col("event_id").alias("identity"), F.col("deliveries").alias("times"))
    return events.unionByName(spark.sql(RESOLVE_SQL["revision_conflicts"], raw=raw).select(F.lit("key_version").alias("kind"), F.concat_ws("@", "inspection_id", "version").alias("identity"), F.col("payloads").alias("times")))


@query("resolve_sql_gate", _sql("SELECT gt.*, event_conflicts = 0 AND revision_conflicts = 0 AND unresolved_keys = 0 AS publication_allowed, tt.* FROM gt, tt"))
def resolve_sql_gate(spark, sf_dir):
    return spark.sql(RESOLVE_SQL["gate_totals"], raw=V.deliveries(spark, sf_dir))


@query("resolve_simple", f"WITH {V.D1A}, l AS (SELECT * FROM d1a QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival_seq DESC) = 1) SELECT inspection_id, version, inspected_units, defective_units FROM l WHERE inspected_units >= 0 AND defective_units >= 0 QUALIFY row_number() OVER (PARTITION BY inspection_id ORDER BY version DESC, inspected_units DESC, defective_units DESC) = 1")
def resolve_simple(spark, sf_dir):
    return R.resolve_simple(V.arrivals(spark, sf_dir))


_ARRIVALS_R = "d1b AS (SELECT * FROM d1a UNION ALL SELECT event_id, inspection_id, version, inspected_units, defective_units, arrival_seq + 500 FROM d1a WHERE inspection_id::BIGINT % 2 = 0)"


@query("classify_arrival", "WITH " + V.D1A + ", " + _ARRIVALS_R + _BASE.replace("{src}", "(SELECT event_id, inspection_id, version, inspected_units, defective_units FROM d1b)") + """, a AS (
SELECT *, min(arrival_seq) OVER (PARTITION BY event_id, inspection_id, version, inspected_units, defective_units) AS first_seq,
  min(arrival_seq) OVER (PARTITION BY inspection_id, version) AS pair_seq, max(version) OVER (PARTITION BY inspection_id) AS high, min(version) OVER (PARTITION BY inspection_id) AS low FROM d1b)
SELECT arrival_seq, CASE WHEN arrival_seq > first_seq THEN 'identical_delivery' WHEN event_id IN (SELECT event_id FROM ec) OR (inspection_id, version) IN (SELECT (inspection_id, version) FROM rc) THEN 'conflict'
  WHEN NOT version > 0 THEN 'unresolved_ordering' WHEN first_seq > pair_seq THEN 'redundant_evidence' WHEN version < high THEN 'older_revision' WHEN version > low THEN 'correction' ELSE 'first_evidence' END AS label FROM a""")
def classify_arrival(spark, sf_dir):
    once = V.arrivals(spark, sf_dir)  # and those of even orders again, beside them: the positions are made once
    times = F.when(F.col("inspection_id").cast("long") % 2 == 0, F.array(F.lit(0), F.lit(500))).otherwise(F.array(F.lit(0)))
    return R.classify_arrivals(once.withColumn("later", F.explode(times)).withColumn("arrival_seq", F.col("arrival_seq") + F.col("later")).drop("later"))


@query("incremental_resolve", _sql("SELECT * FROM ac"))
def incremental_resolve(spark, sf_dir):
    """Two batches merged into kept state: the second one reads and writes what its events and keys have there."""
    raw = V.deliveries(spark, sf_dir)
    state = ResolverState(spark, scratch(spark, "resolver-state"))
    for batch in (raw.filter("version <= 4"), raw.filter("version > 4")):
        state.apply(batch)
    return state.resolution().accepted()
