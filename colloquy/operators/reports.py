"""One-row and per-stage reports over the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.operators.fold import latest_judgment


def inside(at: str, since: str | None, until: str | None) -> Column:
    """since <= at < until as instants; an open end has no bound."""
    ok = F.lit(True)
    if since:
        ok = ok & (F.col(at) >= F.lit(since).cast("timestamp_ntz"))
    if until:
        ok = ok & (F.col(at) < F.lit(until).cast("timestamp_ntz"))
    return ok


def weekly(log: DataFrame, since: str | None, until: str | None) -> DataFrame:
    """One row. A flag counts where it was first recorded, with its status as of now; the rest are in-window events.

    Every source is aggregated to a flag or to one row before they meet.
    """
    window = inside("occurred_at", since, until)
    flags = log.where("event_type = 'encounter_recorded'").groupBy("key").agg(F.min("event_id").alias("first"), F.min_by("occurred_at", "event_id").alias("occurred_at"), F.min_by("k", "event_id").alias("k"))
    flags = flags.where(inside("occurred_at", since, until)).join(latest_judgment(log), "key", "left")
    explained = log.where("event_type = 'session_analysed' and k < 10").select("key").distinct().withColumn("explained", F.lit(True))
    manual = F.col("k") % 10 == 0
    judged = F.col("judgment").isNotNull() & ~manual
    one = flags.join(explained, "key", "left").agg(
        F.count(F.lit(1)).alias("flags"), F.count_if(manual).alias("manual"), F.count_if(judged | F.coalesce("explained", F.lit(False))).alias("engaged"),
        F.count_if(judged).alias("judged"), F.count_if(judged & (F.col("judgment") == "dismissed")).alias("dismissed_now"),
    )
    last = log.where("event_type = 'session_analysed'").where(window).groupBy("key").agg(F.max_by("k", "event_id").alias("k"))
    clean = last.agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("k") % 4 == 0).alias("sessions_clean"))
    events = log.where(window).agg(*[F.count_if(F.col("event_type") == t).alias(n) for t, n in (("encounter_confirmed", "confirms"), ("encounter_dismissed", "dismissals"), ("encounter_judgment_retracted", "undos"))])
    rate = F.try_divide(F.col("dismissed_now").cast("double"), F.col("judged"))
    return one.join(clean).join(events).withColumn("dismissal_rate", rate)  # one row each


def funnel(log: DataFrame, since: str | None, until: str | None) -> DataFrame:
    """sessions -> found -> gaps -> judged -> filed -> answered, from each session's latest run in the window."""
    window = inside("occurred_at", since, until)
    runs = log.where("event_type = 'session_analysed'").where(window).groupBy("key").agg(F.max_by("k", "event_id").alias("found"))
    records = log.where("event_type = 'encounter_recorded'").where(window).groupBy("key").agg(F.count(F.lit(1)).alias("filed"))
    per = runs.join(records, "key", "left").join(latest_judgment(log), "key", "left")
    gaps = F.floor(F.col("found") / 2)
    return per.agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("found").alias("found"), F.sum(gaps).alias("gaps"), F.sum(F.least(gaps, F.coalesce("filed", F.lit(0)))).alias("judged"),
        F.greatest(F.sum(gaps) - F.sum(F.coalesce("filed", F.lit(0))), F.lit(0)).alias("not_judged"), F.sum(F.coalesce("filed", F.lit(0))).alias("filed"), F.count_if(F.col("judgment").isNotNull()).alias("answered"),
    )


def surface_state(sessions: Column, analysed: Column, fixtures: Column, opened: Column, waiting: Column) -> Column:
    return (
        F.when(sessions == 0, "not_captured").when((analysed == 0) & (fixtures == 0), "not_analysed").when(opened > 0, "gaps")
        .when(waiting > 0, "not_analysed").when(analysed < 3, "cold_start").otherwise("clean")
    )


def surface(sessions: DataFrame, analysed: DataFrame, states: DataFrame) -> DataFrame:
    """One row: counts and the surface state. sessions, analysed: session_id; states: bucket."""
    n = F.count(F.lit(1))
    row = sessions.agg(n.alias("sessions")).join(analysed.agg(n.alias("analysed"))).join(states.agg(F.count_if(F.col("bucket") == "open").alias("opened")))
    row = row.join(sessions.join(analysed, "session_id", "left_anti").agg(n.alias("waiting")))
    return row.withColumn("state", surface_state(F.col("sessions"), F.col("analysed"), F.lit(0), F.col("opened"), F.col("waiting")))


def capture_stats(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("session_id").alias("sessions"), F.max("line_no").alias("last_line"), F.count_if("is_meta").alias("meta"))


def populated(states: DataFrame, order: tuple[str, ...] = ("open", "learning", "closed", "hidden")) -> DataFrame:
    """Buckets that hold anything, in their fixed order."""
    fixed = states.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, order))).alias("place", "bucket"))
    return fixed.join(states.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket").select(F.col("place").cast("long").alias("place"), "bucket", "n")


def newest_concepts(states: DataFrame, most: int) -> DataFrame:
    return states.orderBy(F.desc_nulls_last("last_seen"), "key").limit(most)


def notify_select(flags: DataFrame, notified: DataFrame) -> DataFrame:
    """The first unjudged flag of each open concept that was not notified yet."""
    new = flags.where("judgment is null").join(notified, "key", "left_anti")
    first = new.groupBy("key").agg(F.min("event_id").alias("event_id"))
    return first
