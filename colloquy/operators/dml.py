"""Writes as set operations: validated appends, upserts, deletes by anti join, wipes.

Plain Parquet has no merge, so each function returns the table as it is to be after the change; the caller writes it
(partition overwrite) or appends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Event types with the payload keys that each has to have, and ids that can be the subject, in order.
CATALOGUE = {
    "concept_created": ("concept_id", "canonical_name"), "alias_added": ("concept_id", "alias"), "alias_removed": ("concept_id", "alias"), "concept_merged": ("from_concept_id", "into_concept_id"),
    "resolver_judgment": ("decision",), "encounter_recorded": ("encounter_id", "concept_id", "source", "paraphrase"), "session_analysed": ("session_id",), "encounter_confirmed": ("encounter_id",),
    "encounter_dismissed": ("encounter_id",), "encounter_judgment_retracted": ("encounter_id",), "explanation_submitted": ("concept_id", "raw_text", "prompt_text", "prompt_version"),
    "resolver_judgment_corrected": ("target",), "familiarity_judged": ("verdict",), "explanation_graded": ("explanation_id", "rubric", "level"), "material_generated": ("material_id", "format", "covers_concept_ids"),
    "material_delivered": ("material_id",), "model_called": ("purpose",), "detector_ran": ("session_id", "candidates"), "material_refused": ("concept_id",),
}
USER_ACTOR = ("encounter_confirmed", "encounter_dismissed", "encounter_judgment_retracted", "explanation_submitted", "resolver_judgment_corrected")
SUBJECTS = ("concept_id", "encounter_id", "explanation_id", "material_id", "session_id")
LEVELS = ("isolated", "listed", "causal")


def validated(events: DataFrame) -> DataFrame:
    """Adds actor, subject and error (null: fit to append). events: event_type, payload (map of strings)."""
    missing = F.lit(None).cast("array<string>")
    for kind, keys in CATALOGUE.items():
        missing = F.when(F.col("event_type") == kind, F.array_except(F.array(*map(F.lit, keys)), F.map_keys("payload"))).otherwise(missing)
    level = F.try_element_at("payload", F.lit("level"))
    error = (
        F.when(~F.col("event_type").isin(*CATALOGUE), "unknown type").when(F.size("_missing") > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort("_missing"), ",")))
        .when((F.col("event_type") == "explanation_graded") & ~level.isin(*LEVELS), "unknown level")
    )
    subject = F.coalesce(*[F.when(F.map_contains_key("payload", k), F.coalesce(F.try_element_at("payload", F.lit(k)), F.lit(""))) for k in SUBJECTS])
    actor = F.when(F.col("event_type").isin(*USER_ACTOR), "user").otherwise("system")
    return events.withColumn("_missing", missing).withColumns({"error": error, "actor": actor, "subject": subject}).drop("_missing")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same key; of equal keys in new the last by _order counts."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_order")))).where("_n = 1").drop("_n", "_order")
    return old.join(last, keys, "left_anti").unionByName(last)


def upsert_first(old: DataFrame, new: DataFrame, key: str, keep: list[str], add: list[str]) -> DataFrame:
    """Metadata stays as first known, counters add up."""
    a, b = old.alias("a"), new.alias("b")
    held = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in keep]
    sums = [(F.coalesce(f"a.{c}", F.lit(0)) + F.coalesce(f"b.{c}", F.lit(0))).alias(c) for c in add]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *held, *sums)


def without(rows: DataFrame, gone: DataFrame, key: str | list[str]) -> DataFrame:
    return rows.join(gone, key, "left_anti")


def drop_stale(derived: DataFrame, sessions: DataFrame, protected: DataFrame) -> DataFrame:
    """Derived encounters of the sessions go, unless protected; a null id counts as ''."""
    keyed = derived.withColumn("_id", F.coalesce(F.col("encounter_id").cast("string"), F.lit("")))
    stale = keyed.join(sessions, "session_id", "left_semi").join(protected.select(F.col("encounter_id").cast("string").alias("_id")), "_id", "left_anti").select("_id").distinct()
    return keyed.join(stale, "_id", "left_anti").drop("_id")


def wiped(events: DataFrame, kinds: tuple[str, ...], judged: DataFrame, key: str, discard_user_input: bool = False) -> DataFrame:
    """The log without events of these types; what a person judged stays unless that is given up too."""
    hit: Column = F.col("event_type").isin(*kinds)
    if discard_user_input:
        return events.where(~hit)
    kept = judged.select(key).distinct().withColumn("_kept", F.lit(True))
    return events.join(kept, key, "left").where(~hit | F.coalesce("_kept", F.lit(False))).drop("_kept")
