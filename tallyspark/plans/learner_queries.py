"""Queries of learner events over ``events``, with cards and lessons from the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.operators import learner as L
from tallyspark.plans import views as V
from tallyspark.plans.register import registry
from tallyspark.plans.views import table

QUERIES, SQL, query = registry()

_NEXT = "CASE {r} WHEN 'Again' THEN 0 WHEN 'Hard' THEN least(365, greatest(1, ceil({p} * 6 / 5.0)::INT)) WHEN 'Good' THEN CASE WHEN {p} = 0 THEN 3 ELSE least(365, {p} * 2) END WHEN 'Easy' THEN CASE WHEN {p} = 0 THEN 7 ELSE least(365, {p} * 3) END END"
_CODE = "CASE rating WHEN 'Again' THEN 1 WHEN 'Hard' THEN 2 WHEN 'Good' THEN 3 WHEN 'Easy' THEN 4 END"
_STEP = "lambda a, r: CASE r WHEN 1 THEN 0 WHEN 2 THEN least(365, greatest(1, ceil(a * 6 / 5.0)::INT)) WHEN 3 THEN CASE WHEN a = 0 THEN 3 ELSE least(365, a * 2) END ELSE CASE WHEN a = 0 THEN 7 ELSE least(365, a * 3) END END"
_LOG = f"""{V.D3}, w AS (SELECT *, list_reduce(list_prepend(0, coalesce(list({_CODE}) OVER (PARTITION BY learner_id, card_id ORDER BY "at", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []::INT[])), {_STEP}) AS before_interval FROM d3),
log AS (SELECT *, ({_NEXT.format(r='rating', p='before_interval')})::INT AS interval_days FROM w),
logd AS (SELECT *, "at" + CASE WHEN rating = 'Again' THEN INTERVAL 600 SECOND ELSE to_days(interval_days) END AS due_at FROM log),
sch AS (SELECT * FROM logd QUALIFY row_number() OVER (PARTITION BY learner_id, card_id ORDER BY "at" DESC, event_id DESC) = 1)"""


def _log(spark, sf_dir):
    return L.review_log(V.reviews(spark, sf_dir))


def _plain(column: str):
    """Timestamps without a time zone, as the SQL side has them."""
    return F.col(column).cast("timestamp_ntz").alias(column)


@query("schedule_rating", f"WITH {V.D3}, p AS (SELECT unnest([0, 1, 4, 200, 364, 365]) AS previous) SELECT event_id, previous, ({_NEXT.format(r='rating', p='previous')})::INT AS interval_days FROM d3, p")
def schedule_rating(spark, sf_dir):
    rows = V.reviews(spark, sf_dir).withColumn("previous", F.explode(F.array(*[F.lit(x) for x in (0, 1, 4, 200, 364, 365)])))
    return rows.select("event_id", "previous", L.next_interval(F.col("previous"), F.col("rating")).alias("interval_days"))


@query("schedule_fold", f"WITH {_LOG} SELECT learner_id, card_id, interval_days, due_at, event_id AS last_event_id, \"at\" AS updated_at FROM sch")
def schedule_fold(spark, sf_dir):
    return L.schedule_fold(V.reviews(spark, sf_dir)).select("learner_id", "card_id", "interval_days", _plain("due_at"), "last_event_id", _plain("updated_at"))


@query("schedule_rebuild", f"WITH {_LOG} SELECT learner_id, card_id, interval_days, due_at, event_id AS last_event_id FROM sch")
def schedule_rebuild(spark, sf_dir):
    return L.schedule_rebuild(_log(spark, sf_dir)).withColumn("due_at", F.col("due_at").cast("timestamp_ntz"))


@query("review_audit", f"WITH {_LOG} SELECT event_id, interval_days + 1 AS interval_days, interval_days AS expected_days FROM logd WHERE event_id % 97 = 0")
def review_audit(spark, sf_dir):
    return L.review_audit(_log(spark, sf_dir).withColumn("interval_days", F.col("interval_days") + (F.col("event_id") % 97 == 0).cast("int")))


@query("schedule_audit", f"WITH {_LOG} SELECT learner_id, card_id, CASE WHEN event_id % 3 = 0 THEN 'missing_event' ELSE 'interval_differs' END AS reason FROM sch WHERE event_id % 3 < 2")
def schedule_audit(spark, sf_dir):
    log = _log(spark, sf_dir)
    stored = L.schedule_rebuild(log).withColumn("interval_days", F.col("interval_days") + (F.col("last_event_id") % 3 == 1).cast("int"))
    return L.schedule_audit(stored, log.filter("event_id % 3 <> 0"))


@query("attempt_audit", f"WITH {V.D3}, a AS (SELECT event_id AS attempt_id, substr('abcd', (event_id % 4 + 1)::INT, 1) AS chosen, substr('abc', card_id + 1, 1) AS answer, event_id % 5 = 0 AS correct FROM d3) SELECT attempt_id, CASE WHEN chosen = 'd' THEN 'unknown_choice' WHEN answer = '' THEN 'unknown_answer' ELSE 'wrong_flag' END AS reason FROM a WHERE chosen = 'd' OR answer = '' OR correct <> (chosen = answer)")
def attempt_audit(spark, sf_dir):
    rows = V.reviews(spark, sf_dir)
    chosen = F.substring(F.lit("abcd"), (F.col("event_id") % 4 + 1).cast("int"), F.lit(1))
    answer = F.substring(F.lit("abc"), F.col("card_id") + 1, F.lit(1))
    return L.attempt_audit(rows.select(F.col("event_id").alias("attempt_id"), chosen.alias("chosen"), answer.alias("answer"), (F.col("event_id") % 5 == 0).alias("correct"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("options")))


@query("key_audit", "SELECT event_id AS map_key, event_id + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS record_id FROM events WHERE event_id % 50 = 0")
def key_audit(spark, sf_dir):
    record = F.struct((F.col("event_id") + (F.col("event_id") % 50 == 0).cast("int")).alias("id"))
    state = table(spark, sf_dir, "events").select(F.create_map("event_id", record).alias("m"))
    return state.select(F.explode("m").alias("map_key", "r")).select("map_key", F.col("r.id").alias("record_id")).filter("not map_key <=> record_id")


_CARDS = "c AS (SELECT unnest([0, 1, 2, 3, 4]) AS card_id, unnest([0, 1, 0, 1, 0]) AS revision)"


def _schedules(spark, sf_dir):
    return L.schedule_fold(V.reviews(spark, sf_dir)).withColumn("revision", (F.col("last_event_id") % 2).cast("int"))


@query("due_queue", f"WITH {_LOG}, {_CARDS} SELECT learner_id, row_number() OVER (PARTITION BY learner_id ORDER BY due_at, card_id)::INT AS place, card_id FROM sch JOIN c USING (card_id) WHERE due_at <= TIMESTAMP '2024-02-01' OR sch.event_id % 2 <> c.revision QUALIFY place <= 3")
def due_queue(spark, sf_dir):
    cards = table(spark, sf_dir, "events").select(F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(5)).alias("card_id")).distinct().withColumn("revision", F.col("card_id") % 2)
    return L.due_queue(_schedules(spark, sf_dir), cards, F.lit("2024-02-01 00:00:00").cast("timestamp"), 3)


_POOL = "o AS (SELECT c_custkey AS learner_id, c_nationkey AS lesson_id FROM customer), k AS (SELECT s_suppkey AS card_id, s_nationkey AS lesson_id FROM supplier), s AS (SELECT DISTINCT o_custkey AS learner_id, l_suppkey AS card_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _pools(spark, sf_dir):
    opened = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("learner_id"), F.col("c_nationkey").alias("lesson_id"))
    cards = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("card_id"), F.col("s_nationkey").alias("lesson_id"))
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    seen = o.join(l, o.o_orderkey == l.l_orderkey).select(F.col("o_custkey").alias("learner_id"), F.col("l_suppkey").alias("card_id"))
    return opened, cards, seen


@query("new_card_pool", f"WITH {_POOL} SELECT learner_id, row_number() OVER (PARTITION BY learner_id ORDER BY card_id)::INT AS place, card_id FROM o JOIN k USING (lesson_id) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.learner_id = o.learner_id AND s.card_id = k.card_id) QUALIFY place <= 3")
def new_card_pool(spark, sf_dir):
    return L.card_pool(*_pools(spark, sf_dir), limit=3, scheduled=False)


@query("extra_pool", f"WITH {_POOL} SELECT learner_id, row_number() OVER (PARTITION BY learner_id ORDER BY card_id)::INT AS place, card_id FROM o JOIN k USING (lesson_id) WHERE EXISTS (SELECT 1 FROM s WHERE s.learner_id = o.learner_id AND s.card_id = k.card_id) QUALIFY place <= 2")
def extra_pool(spark, sf_dir):
    return L.card_pool(*_pools(spark, sf_dir), limit=2, scheduled=True)


@query("schedule_listing", f"WITH {_LOG} SELECT learner_id, row_number() OVER (PARTITION BY learner_id ORDER BY due_at, card_id)::INT AS place, card_id, CASE WHEN card_id = 4 THEN 'Removed card 4' ELSE 'Card ' || card_id END AS label FROM sch")
def schedule_listing(spark, sf_dir):
    rows = _schedules(spark, sf_dir)
    labels = rows.select("card_id").distinct().filter("card_id <> 4").withColumn("label", F.concat(F.lit("Card "), "card_id"))
    place = F.row_number().over(Window.partitionBy("learner_id").orderBy("due_at", "card_id"))
    named = F.coalesce("label", F.concat(F.lit("Removed card "), "card_id"))
    return rows.withColumn("place", place).join(labels, "card_id", "left").select("learner_id", "place", "card_id", named.alias("label"))


@query("optional_dim_label", "SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(s_name, 'Removed supplier ' || l_suppkey) AS label FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 > 0) ON l_suppkey = s_suppkey")
def optional_dim_label(spark, sf_dir):
    kept = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    label = F.coalesce("s_name", F.concat(F.lit("Removed supplier "), "l_suppkey"))
    return table(spark, sf_dir, "lineitem").join(kept, "l_suppkey", "left").select("l_orderkey", "l_linenumber", "l_suppkey", label.alias("label"))


_RECENT = "r AS (SELECT user_id, event_type AS module, arg_max(event_id, (ts, event_id)) AS position FROM events GROUP BY 1, 2)"


def _recent(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("module")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("position"))


@query("latest_position", f"WITH {_RECENT} SELECT * FROM r")
def latest_position(spark, sf_dir):
    return _recent(spark, sf_dir)


@query("resume_fallback", f"WITH {_RECENT}, u AS (SELECT DISTINCT user_id FROM events) SELECT user_id, coalesce(a.position, b.position, 0) AS position, CASE WHEN a.position IS NOT NULL THEN 'saved' WHEN b.position IS NOT NULL THEN 'recent' ELSE 'first' END AS chosen FROM u LEFT JOIN (SELECT user_id, position FROM r WHERE module = 'signup' AND user_id % 2 = 0) a USING (user_id) LEFT JOIN (SELECT user_id, position FROM r WHERE module = 'purchase' AND user_id % 3 > 0) b USING (user_id)")
def resume_fallback(spark, sf_dir):
    recent = _recent(spark, sf_dir)
    saved = recent.filter("module = 'signup' and user_id % 2 = 0").select("user_id", F.col("position").alias("a"))
    last = recent.filter("module = 'purchase' and user_id % 3 > 0").select("user_id", F.col("position").alias("b"))
    chosen = F.when(F.col("a").isNotNull(), "saved").when(F.col("b").isNotNull(), "recent").otherwise("first")
    return recent.select("user_id").distinct().join(saved, "user_id", "left").join(last, "user_id", "left").select("user_id", F.coalesce("a", "b", F.lit(0)).alias("position"), chosen.alias("chosen"))


@query("attempt_summary", f"WITH {V.D3} SELECT learner_id, card_id, count(*) AS attempts, count(*) FILTER (WHERE rating IN ('Good', 'Easy')) AS correct, arg_max(event_id % 2, (\"at\", event_id)) = card_id % 2 AS current_revision FROM d3 GROUP BY 1, 2")
def attempt_summary(spark, sf_dir):
    last = F.max_by(F.col("event_id") % 2, F.struct("at", "event_id"))
    return V.reviews(spark, sf_dir).groupBy("learner_id", "card_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("rating").isin("Good", "Easy")).alias("correct"), (last == F.col("card_id") % 2).alias("current_revision"))


_DONE = "b AS (SELECT p_brand AS module, p_partkey AS beat, p_size % 3 AS version FROM part), d AS (SELECT DISTINCT l_partkey AS beat, l_linenumber % 3 AS version FROM lineitem WHERE l_returnflag = 'R')"


def _beats(spark, sf_dir):
    beats = table(spark, sf_dir, "part").select(F.col("p_brand").alias("module"), F.col("p_partkey").alias("beat"), (F.col("p_size") % 3).alias("version"))
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("beat"), (F.col("l_linenumber") % 3).alias("version")).distinct()
    return beats, done


@query("module_progress", f"WITH {_DONE} SELECT module, count(d.beat) AS completed, count(*) AS total FROM b LEFT JOIN d USING (beat, version) GROUP BY 1")
def module_progress(spark, sf_dir):
    beats, done = _beats(spark, sf_dir)
    return beats.join(done.withColumn("done", F.lit(1)), ["beat", "version"], "left").groupBy("module").agg(F.count("done").alias("completed"), F.count("*").alias("total"))


@query("completion_label", f"WITH {_DONE} SELECT b.beat, CASE WHEN bool_or(coalesce(d.version = b.version, false)) THEN 'complete' WHEN count(d.version) > 0 THEN 'revised' ELSE 'ready' END AS label FROM b LEFT JOIN d ON d.beat = b.beat GROUP BY 1")
def completion_label(spark, sf_dir):
    beats, done = _beats(spark, sf_dir)
    pairs = beats.join(done.withColumnRenamed("version", "seen"), "beat", "left")
    label = F.when(F.bool_or(F.coalesce(F.col("seen") == F.col("version"), F.lit(False))), "complete").when(F.count("seen") > 0, "revised").otherwise("ready")
    return pairs.groupBy("beat").agg(label.alias("label"))


@query("next_incomplete", f"WITH {_DONE} SELECT module, min(b.beat) AS next_beat FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.beat = b.beat AND d.version = b.version) GROUP BY 1")
def next_incomplete(spark, sf_dir):
    beats, done = _beats(spark, sf_dir)
    return beats.join(done, ["beat", "version"], "left_anti").groupBy("module").agg(F.min("beat").alias("next_beat"))


@query("draft_status", "SELECT DISTINCT c.conv_id, CASE WHEN d.conv_id IS NOT NULL THEN 'draft' ELSE 'empty' END AS status FROM conversations c LEFT JOIN (SELECT DISTINCT conv_id FROM conversations WHERE turn = 3 AND regexp_matches(text, '[^ \\t\\r\\n]')) d USING (conv_id)")
def draft_status(spark, sf_dir):
    from tallyspark.functions.rules import nonblank

    rows = table(spark, sf_dir, "conversations")
    drafts = rows.filter((F.col("turn") == 3) & nonblank(F.col("text"))).select("conv_id").distinct().withColumn("has", F.lit(True))
    return rows.select("conv_id").distinct().join(drafts, "conv_id", "left").select("conv_id", F.when(F.col("has"), "draft").otherwise("empty").alias("status"))


@query("assessment_rows", "SELECT l_orderkey, l_linenumber, 'flag' AS criterion, l_returnflag AS rating FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'status', l_linestatus FROM lineitem")
def assessment_rows(spark, sf_dir):
    ratings = F.create_map(F.lit("flag"), "l_returnflag", F.lit("status"), "l_linestatus")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(ratings).alias("criterion", "rating"))


@query("state_migrate", "SELECT doc_id AS id, 4 AS schema_version, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS extra_practice, CASE WHEN doc_id % 4 < 2 THEN NULL ELSE lang END AS path_id, CASE WHEN doc_id % 4 < 3 THEN true ELSE n_chars > 1000 END AS show_extra FROM documents")
def state_migrate(spark, sf_dir):
    version = (F.col("doc_id") % 4 + 1).cast("int")
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), version.alias("schema_version"), F.array("source").alias("extra_practice"), F.col("lang").alias("path_id"), (F.col("n_chars") > 1000).alias("show_extra"))
    return L.migrate(old).withColumn("extra_practice", F.array_join("extra_practice", ","))
