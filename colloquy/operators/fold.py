"""Folds of the append-only log: latest wins, first wins, ordered alias sets, and the state derived from them.

Everything is an aggregate over the total order of event ids, so arrival order never matters and partial results are
combined before the shuffle. References to things that may be logged later are joins by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

JUDGED = ("encounter_confirmed", "encounter_dismissed", "encounter_judgment_retracted")


def latest(rows: DataFrame, key: list[str], value: Column, order: Column, name: str = "latest") -> DataFrame:
    """The value of the last row of each key; a null value that is last counts."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(value.alias("v")), order)["v"].alias(name))


def first_seen(log: DataFrame, key: str, at: str = "occurred_at", order: str = "event_id") -> DataFrame:
    return log.groupBy(key).agg(F.min_by(at, order).alias("first_at"), F.min(order).alias("first_event"))


def latest_judgment(log: DataFrame) -> DataFrame:
    """Judgment now in force of each encounter; a retraction that came last leaves none."""
    judged = log.where(F.col("event_type").isin(*JUDGED))
    value = F.when(F.col("event_type") == "encounter_confirmed", "confirmed").when(F.col("event_type") == "encounter_dismissed", "dismissed")
    last = judged.groupBy("key").agg(F.max_by(F.struct(value.alias("judgment"), F.when(value.isNotNull(), F.col("occurred_at")).alias("judged_at")), "event_id").alias("l"))
    return last.select("key", "l.judgment", "l.judged_at")


def superseded(log: DataFrame) -> DataFrame:
    """Of each encounter its last record: superseded if there was one before and it says that it supersedes (odd k)."""
    rec = log.where("event_type = 'encounter_recorded'")
    return rec.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("event_id"), F.max_by("k", "event_id").alias("k")).select("key", "event_id", ((F.col("n") > 1) & (F.col("k") % 2 == 1)).alias("superseded"))


def concept_rollup(log: DataFrame) -> DataFrame:
    """Encounters by concept (k): how many, distinct keys, first and last seen, and the last value."""
    rec = log.where("event_type = 'encounter_recorded' and k is not null")
    return rec.groupBy("k").agg(F.count(F.lit(1)).alias("encounter_count"), F.countDistinct("key").alias("n_keys"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"), F.max_by("value", "event_id").alias("last_value"))


def level_of(value: Column) -> Column:
    """A grade from a score; one that is not in the catalogue counts as isolated."""
    return F.when(value >= 150, "causal").when(value >= 75, "listed").otherwise("isolated")


def derive_state(n_encounters: Column, level: Column, judgment: Column, exposed: Column) -> Column:
    """referenced, known, exposed or gap, in that order of precedence."""
    return (
        F.when(F.coalesce(n_encounters, F.lit(0)) == 0, "referenced").when(F.coalesce(level == "causal", F.lit(False)), "known").when(F.coalesce(judgment == "dismissed", F.lit(False)), "known")
        .when(F.coalesce(exposed, F.lit(False)), "exposed").otherwise("gap")
    )


def bucket_for(state: Column, n_encounters: Column, judged: Column, explained: Column) -> Column:
    return F.when((state == "referenced") | (n_encounters == 0), "hidden").when(state == "known", "closed").when(judged | explained, "learning").otherwise("open")


def concept_state(log: DataFrame) -> DataFrame:
    """One row a concept (key): state and bucket from encounters, last grade, last judgment and delivered material."""
    rec = log.groupBy("key").agg(
        F.count_if(F.col("event_type") == "encounter_recorded").alias("n_encounters"),
        F.max_by(F.when(F.col("event_type") == "session_analysed", level_of(F.col("value"))), F.when(F.col("event_type") == "session_analysed", F.col("event_id"))).alias("level"),
        F.bool_or((F.col("event_type") == "session_analysed") & (F.col("k") > 90)).alias("exposed"), F.bool_or((F.col("event_type") == "session_analysed") & (F.col("k") < 10)).alias("explained"),
    )
    joined = rec.join(latest_judgment(log), "key", "left")
    state = derive_state(F.col("n_encounters"), F.col("level"), F.col("judgment"), F.col("exposed"))
    staged = joined.withColumn("state", state)
    return staged.withColumn("bucket", bucket_for(F.col("state"), F.col("n_encounters"), F.col("judgment").isNotNull(), F.col("explained"))).select("key", "n_encounters", "level", "judgment", "exposed", "state", "bucket")


def state_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("state", "bucket").agg(F.count(F.lit(1)).alias("n"))


def alias_fold(ops: DataFrame) -> DataFrame:
    """Ordered alias set of each concept. ops: key, event_id, op (add or remove), alias.

    Within one (concept, alias) only the last operation counts, and an alias stands where the add that opened its
    present run put it: so the fold is two aggregates, and only the surviving aliases of a concept are gathered.
    """
    w = Window.partitionBy("key", "alias").orderBy("event_id")
    opened = ops.withColumn("_before", F.coalesce(F.lag("op").over(w), F.lit("remove"))).where((F.col("op") == "remove") | (F.col("_before") == "remove"))
    last = opened.groupBy("key", "alias").agg(F.max_by("op", "event_id").alias("op"), F.max("event_id").alias("at")).where("op = 'add'")
    return last.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"].cast("string")), ",").alias("aliases"), F.count(F.lit(1)).alias("n_aliases"))


def occasions(events: DataFrame, key: str, at: str, order: str, gap_seconds: int) -> DataFrame:
    """Occasion number of each event: a new one when the gap to the event before is over the threshold."""
    w = Window.partitionBy(key).orderBy(at, order)
    since = F.timestamp_diff("MICROSECOND", F.lag(at).over(w), F.col(at))
    marked = events.withColumn("_new", F.when(since.isNull() | (since > gap_seconds * 1_000_000), 1).otherwise(0))
    return marked.withColumn("occasion", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def exposed_set(materials: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Concepts named by material that was delivered."""
    return materials.join(deliveries.select("material_id").distinct(), "material_id", "left_semi").select("concept_id").distinct()


def compile_meta(log: DataFrame) -> DataFrame:
    """The watermark of a compile: last event and how many there were."""
    return log.agg(F.max("event_id").alias("compiled_through"), F.count(F.lit(1)).alias("event_count"))
