"""Ordered-event operators: islands, next-over-aggregate, login days, last and first values, ordered lists, interval joins."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from revisio.scan import Segments, numbered


def by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def islands(events, gap_seconds):
    """Runs of a user's events no more than a gap apart; a user's events may lie on many partitions."""
    s = Segments(events.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    late = F.col("ts") > F.col("before") + F.make_dt_interval(secs=F.lit(gap_seconds))
    e = s.previous(s.rows, before="ts").withColumn("new", F.coalesce(late, F.lit(True)).cast("long"))
    return s.total(e, island="new").groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def next_first(events):
    """Each user's types by first event, with the first event of the type that follows (a window over an aggregate)."""
    g = events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    return g.select("user_id", "event_type", F.col("at.event_id").alias("first_id"), F.lead("at.event_id").over(Window.partitionBy("user_id").orderBy("at")).alias("next_id"))


def login_days(events):
    return events.groupBy("user_id").agg(F.countDistinct(F.to_date("ts")).alias("days"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


def keep_ends(events):
    """Five values of each user's first and last event."""
    at = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(*[f(c, at).alias(f"{n}_{c}") for n, f in (("first", F.min_by), ("last", F.max_by)) for c in ("event_id", "event_type", "value", "props", "ts")])


def participant(rows, key, flag_a, flag_b):
    """What a key's rows hold: both flags, one, or neither."""
    a, b = F.bool_or(flag_a), F.bool_or(flag_b)
    return rows.groupBy(key).agg(F.when(a & b, "Both").when(a, "HEALTHY").when(b, "CONDITION").alias("participant_type"))


def by_study():
    return Window.partitionBy("study").orderBy("start", "id")


def before_completion(attempts):
    """Completed attempts with counts of earlier attempts of the study and its author: one window each instead of a correlated count."""
    w = by_study().rowsBetween(Window.unboundedPreceding, -1)
    a = attempts.select("*", F.count("*").over(w).alias("n_before"), F.sum((F.col("mode") == "AI").cast("long")).over(w).alias("ai_before"),
                        F.last(F.when(F.col("result") == "AI_ERROR", F.col("id")), True).over(w).alias("last_error"))
    return a.where("result = 'COMPLETE'").select("id", "study", "n_before", F.coalesce("ai_before", F.lit(0)).alias("ai_before"), "last_error")


def dates(attempts):
    """First and last starts of each study by result, as conditional extremes."""
    at = {"complete": F.col("result") == "COMPLETE", "dropped": F.col("result") == "USER_DROPPED"}
    return attempts.groupBy("study").agg(*[f(F.when(c, F.col("start"))).cast("string").alias(f"{n}_{k}") for k, c in at.items() for n, f in (("first", F.min), ("last", F.max))])


def latest(rows, key, order):
    """Each key's row that comes last by the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where("__n = 1").drop("__n")


def listed(events, sep):
    """Each user's types, distinct, in order, as one string."""
    return events.groupBy("user_id").agg(F.concat_ws(sep, F.array_sort(F.collect_set("event_type"))).alias("types"))


def listed_in_order(events, sep, block=4096):
    """Each user's types by time, repeats kept, as one string: blocks of numbered rows are joined first, so that no task holds the rows of a user."""
    n = numbered(events.select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    b = n.groupBy("user_id", F.floor((F.col("nth") - 1) / block).alias("b")).agg(F.count("event_type").alias("n"), F.expr(f"listagg(event_type, '{sep}') WITHIN GROUP (ORDER BY nth)").alias("t"))
    return b.groupBy("user_id").agg(F.sum("n").alias("n"), F.expr(f"listagg(t, '{sep}') WITHIN GROUP (ORDER BY b)").alias("types"))


def within(facts, spans):
    """Facts (key, at) in spans (key, lo, hi), both ends included: an equi-join with a range residual."""
    return facts.alias("f").join(spans.alias("s"), (F.col("f.key") == F.col("s.key")) & F.col("f.at").between(F.col("s.lo"), F.col("s.hi")))
