"""Repairs of the concept graph as events: merges, corrections of judgments, splits.

A repair never edits: it yields the events to append, whole batches at once, and what it refuses with the reason.
What the events mean is settled by the fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions import names as N


def event(rows: DataFrame, kind: str, supersedes: Column | None = None, occurred_at: Column | None = None, **payload: Column) -> DataFrame:
    """One event of a kind for each row: origin, event_type, payload (without nulls), supersedes and occurred_at (null: now)."""
    held = F.map_filter(F.create_map(*[x for name, value in payload.items() for x in (F.lit(name), value.cast("string"))]), lambda k, v: v.isNotNull())
    none = F.lit(None)
    return rows.select(
        F.col("origin"), F.lit(kind).alias("event_type"), held.alias("payload"), (none if supersedes is None else supersedes).cast("string").alias("supersedes"), (none if occurred_at is None else occurred_at).cast("timestamp").alias("occurred_at"),
    )


def merge(pairs: DataFrame) -> DataFrame:
    """Events that fold concepts into others. pairs: origin, from_concept_id, into_concept_id, reasoning; a concept is never folded into itself."""
    return event(pairs.where("from_concept_id <> into_concept_id"), "concept_merged", from_concept_id=F.col("from_concept_id"), into_concept_id=F.col("into_concept_id"), reasoning=F.col("reasoning"))


def correct(corrections: DataFrame, judgments: DataFrame, encounters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of the corrections that can be made, and (origin, error) of the others.

    corrections: origin, target, reasoning, merge_into, split_out (an encounter); judgments: target, concept_id, decision,
    alias, input_text; encounters: encounter_id, at_concept, source, paraphrase, session_id, met_at, event_id. A split
    gives the encounter a concept of its own, named for what was submitted, and takes a wrong alias back.
    """
    known = judgments.withColumn("_known", F.lit(True))
    joined = corrections.join(known, "target", "left").join(encounters.withColumnRenamed("encounter_id", "split_out").withColumn("_met", F.lit(True)), "split_out", "left")
    error = (
        F.when(F.col("merge_into").isNotNull() & F.col("split_out").isNotNull(), "merge and split").when(F.col("_known").isNull(), "no judgment")
        .when(F.col("split_out").isNotNull() & F.col("_met").isNull(), "no encounter").when(F.col("split_out").isNotNull() & ~F.col("at_concept").eqNullSafe(F.col("concept_id")), "not under that concept")
    )
    name = F.coalesce(F.nullif(F.trim(F.coalesce("input_text", F.lit(""))), F.lit("")), F.lit("untitled"))
    new_id = F.concat(N.slug(name), F.lit("-"), F.left(F.sha2(F.concat("target", name), 256), F.lit(6)))
    staged = joined.withColumns({"error": error, "name": name, "new_id": new_id})
    good = staged.where("error is null")
    split, merged = good.where("split_out is not null"), good.where("merge_into is not null and concept_id is not null")
    events = event(good, "resolver_judgment_corrected", supersedes=F.col("target"), target=F.col("target"), reasoning=F.col("reasoning"))
    events = events.unionByName(merge(merged.select("origin", F.col("concept_id").alias("from_concept_id"), F.col("merge_into").alias("into_concept_id"), F.concat(F.lit("Corrected by hand: "), "reasoning").alias("reasoning"))))
    events = events.unionByName(event(split, "concept_created", concept_id=F.col("new_id"), canonical_name=F.col("name")))
    events = events.unionByName(event(split.where("decision = 'alias'"), "alias_removed", concept_id=F.col("concept_id"), alias=F.coalesce("alias", "name")))
    moved = event(split, "encounter_recorded", supersedes=F.col("event_id"), occurred_at=F.col("met_at"), encounter_id=F.col("split_out"), concept_id=F.col("new_id"), source=F.col("source"), paraphrase=F.col("paraphrase"), session_id=F.col("session_id"))
    return events.unionByName(moved), staged.where("error is not null").select("origin", "error")
