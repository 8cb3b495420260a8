"""Learner events: review schedules, queues, pools, audits, progress, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.ranked import ranked

#: Fixed values of the scheduling rule: longest interval in days, delay after "Again", seconds in a day.
LONGEST, AGAIN_SECONDS, DAY_SECONDS = 365, 600, 86_400
RATINGS = ("Again", "Hard", "Good", "Easy")

#: From any interval, so many ratings other than Again reach LONGEST (27, all Hard from 0), and Again forgets
#: what was before: an interval depends on no more than this many last reviews.
MEMORY = 28


def next_interval(previous: Column, rating: Column) -> Column:
    """Days until a card is due again; 0 for Again. Null for a previous interval out of range or an unknown rating."""
    hard = F.least(F.lit(LONGEST), F.greatest(F.lit(1), F.ceil(previous * 6 / 5).cast("int")))
    good = F.when(previous == 0, 3).otherwise(F.least(F.lit(LONGEST), previous * 2))
    easy = F.when(previous == 0, 7).otherwise(F.least(F.lit(LONGEST), previous * 3))
    days = F.when(rating == "Again", 0).when(rating == "Hard", hard).when(rating == "Good", good).when(rating == "Easy", easy)
    return F.when(previous.between(0, LONGEST), days).cast("int")


def due_at(at: Column, interval: Column, rating: Column) -> Column:
    """A day is 24 hours of elapsed time; a card rated Again is due after ten minutes."""
    seconds = F.when(rating == "Again", AGAIN_SECONDS).otherwise(interval.cast("long") * DAY_SECONDS)
    return F.timestamp_micros(F.unix_micros(at.cast("timestamp")) + seconds * 1_000_000)


def fold(ratings: Column) -> Column:
    """The interval after a list of ratings in order, from 0."""
    return F.aggregate(ratings, F.lit(0), lambda days, r: F.coalesce(next_interval(days, r), days))


def schedule_fold(reviews: DataFrame) -> DataFrame:
    """(learner_id, card_id, interval_days, due_at, last_event_id, updated_at): a schedule from all reviews of a card.

    Reviews count in order of (at, event_id); repeated event ids count once. Only the last MEMORY reviews of a
    card can matter, and Spark keeps no more of a group while it reads: a card with very many reviews is no
    burden to a task.
    """
    once = reviews.dropDuplicates(["event_id"])
    turn = F.row_number().over(Window.partitionBy("learner_id", "card_id").orderBy(F.desc("at"), F.desc("event_id")))
    tail = once.withColumn("turn", turn).filter(F.col("turn") <= MEMORY)
    lists = tail.groupBy("learner_id", "card_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_id", "rating"))).alias("r"))
    last = F.element_at("r", -1)
    days = fold(F.transform("r", lambda x: x["rating"]))
    rows = lists.select("learner_id", "card_id", days.alias("interval_days"), last.alias("last"))
    return rows.select("learner_id", "card_id", "interval_days", due_at(F.col("last.at"), F.col("interval_days"), F.col("last.rating")).alias("due_at"), F.col("last.event_id").alias("last_event_id"), F.col("last.at").cast("timestamp").alias("updated_at"))


def review_log(reviews: DataFrame) -> DataFrame:
    """Each review with the intervals before and after it."""
    ordered = Window.partitionBy("learner_id", "card_id").orderBy("at", "event_id")
    recent = F.collect_list("rating").over(ordered.rowsBetween(-MEMORY, -1))
    rows = reviews.withColumn("before_interval", fold(recent))
    rows = rows.withColumn("interval_days", next_interval(F.col("before_interval"), F.col("rating")))
    return rows.withColumn("due_at", due_at(F.col("at"), F.col("interval_days"), F.col("rating")))


def schedule_rebuild(log: DataFrame) -> DataFrame:
    """Schedules as the latest logged review of each card says; ties in time go to the larger event id."""
    order = F.struct("at", "event_id")
    top = log.groupBy("learner_id", "card_id").agg(F.max_by(F.struct("interval_days", "due_at", "event_id"), order).alias("r"))
    return top.select("learner_id", "card_id", "r.interval_days", "r.due_at", F.col("r.event_id").alias("last_event_id"))


def review_audit(log: DataFrame) -> DataFrame:
    """Logged reviews whose stored interval or due time is not what the rule gives."""
    days = next_interval(F.col("before_interval"), F.col("rating"))
    wrong = ~F.col("interval_days").eqNullSafe(days) | ~F.col("due_at").eqNullSafe(due_at(F.col("at"), days, F.col("rating")))
    return log.filter(wrong).select("event_id", "interval_days", days.alias("expected_days"))


def schedule_audit(schedules: DataFrame, log: DataFrame) -> DataFrame:
    """Schedules that do not match their last event, with the reason."""
    event = log.select(F.col("event_id").alias("last_event_id"), F.col("card_id").alias("e_card"), F.col("interval_days").alias("e_days"), F.col("due_at").alias("e_due"))
    both = schedules.join(event, "last_event_id", "left")
    reason = F.when(F.col("e_card").isNull(), "missing_event").when(F.col("e_card") != F.col("card_id"), "other_card").when(~F.col("e_days").eqNullSafe(F.col("interval_days")), "interval_differs").when(~F.col("e_due").eqNullSafe(F.col("due_at")), "due_differs")
    return both.withColumn("reason", reason).filter("reason is not null").select("learner_id", "card_id", "reason")


def due_queue(schedules: DataFrame, cards: DataFrame, at: Column, limit: int) -> DataFrame:
    """(learner_id, place, card_id): scheduled cards that are due or whose revision changed, by due time and id."""
    open_ = schedules.join(cards.select("card_id", F.col("revision").alias("now")), "card_id").filter((F.col("due_at") <= at) | (F.col("revision") != F.col("now")))
    place = F.row_number().over(Window.partitionBy("learner_id").orderBy("due_at", "card_id"))
    return open_.withColumn("place", place).filter(F.col("place") <= limit).select("learner_id", "place", "card_id")


def card_pool(opened: DataFrame, cards: DataFrame, schedules: DataFrame, limit: int, scheduled: bool) -> DataFrame:
    """(learner_id, place, card_id): cards of opened lessons, not yet scheduled ones (new) or scheduled ones (extra practice).

    Learners and cards of a lesson are never paired: cards are numbered within their lesson, and new ones are the first
    numbers that a learner's scheduled cards leave free. The work grows with the schedules and the rows that come out.
    """
    placed = ranked(cards.select("lesson_id", "card_id").filter("lesson_id is not null"), ["lesson_id"], ["card_id"])
    ours = opened.select("learner_id", "lesson_id").filter("lesson_id is not null").distinct()
    seen = schedules.select("learner_id", "card_id").join(placed, "card_id").join(ours, ["learner_id", "lesson_id"], "left_semi").distinct()
    side = seen if scheduled else _free(ours, seen, limit).join(placed, ["lesson_id", "index"])
    place = F.row_number().over(Window.partitionBy("learner_id").orderBy("card_id"))
    return side.withColumn("place", place).filter(F.col("place") <= limit).select("learner_id", "place", "card_id")


def _free(ours: DataFrame, seen: DataFrame, limit: int) -> DataFrame:
    """(learner_id, lesson_id, index): the first ``limit`` numbers, or some more, of a lesson that the learner has not seen."""
    turn = Window.partitionBy("learner_id", "lesson_id").orderBy("index")
    marks = ours.withColumn("index", F.lit(-1).cast("long")).unionByName(seen.select("learner_id", "lesson_id", "index"))
    marks = marks.withColumns({"free_before": F.col("index") + 2 - F.row_number().over(turn), "next": F.lead("index").over(turn)})
    last = F.least(F.col("next") - 1, F.col("index") + limit)  # the least of those that are there
    runs = marks.withColumns({"first": F.col("index") + 1, "last": last}).filter((F.col("free_before") < limit) & (F.col("first") <= F.col("last")))
    return runs.select("learner_id", "lesson_id", F.explode(F.sequence("first", "last")).alias("index"))


def attempt_audit(attempts: DataFrame) -> DataFrame:
    """(attempt_id, reason): chosen or correct option not among the options shown, or a wrong ``correct`` flag."""
    has = lambda c: F.exists("options", lambda o: o == F.col(c))
    reason = F.when(~has("chosen"), "unknown_choice").when(~has("answer"), "unknown_answer").when(F.col("correct") != (F.col("chosen") == F.col("answer")), "wrong_flag")
    return attempts.withColumn("reason", reason).filter("reason is not null").select("attempt_id", "reason")


def migrate(documents: DataFrame) -> DataFrame:
    """State documents of versions 1 to 4 at version 4: missing families are empty, declared defaults fill, nothing is invented."""
    by = lambda v: documents.filter(F.col("schema_version") == v)
    none = F.array().cast("array<string>")
    one = by(1).withColumn("extra_practice", none).withColumn("path_id", F.lit(None).cast("string")).withColumn("show_extra", F.lit(True))
    two = by(2).withColumn("path_id", F.lit(None).cast("string")).withColumn("show_extra", F.lit(True))
    three = by(3).withColumn("show_extra", F.lit(True))
    full = one.unionByName(two, allowMissingColumns=True).unionByName(three, allowMissingColumns=True).unionByName(by(4), allowMissingColumns=True)
    return full.withColumn("schema_version", F.lit(4))
