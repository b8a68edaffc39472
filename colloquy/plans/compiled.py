"""The whole fold: from the typed event log to current state, and from a session's turns to filed candidates.

Everything that a later event may refer to is joined by id after its own fold, so replays and disorder change nothing.
Merged concepts are resolved once, before any fold, by the chain of merges.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.functions import injected
from colloquy.functions.renders import ordered_block
from colloquy.operators import exchange as X, fold as D, graph as G, resolve as R, triage as T


def key(name: str) -> Column:
    """A payload value, null if it is missing."""
    return F.try_element_at("payload", F.lit(name))


@dataclass
class Compiled:
    """Current state: a frame a kind of thing, and the watermark."""

    concepts: DataFrame
    encounters: DataFrame
    explanations: DataFrame
    materials: DataFrame
    sessions: DataFrame
    meta: DataFrame


def last(log: DataFrame, kinds: tuple[str, ...], by: Column, **fields: Column) -> DataFrame:
    """Of each id the fields of its last event of these types."""
    rows = log.where(F.col("event_type").isin(*kinds)).select(by.alias("id"), "event_id", F.struct(*[c.alias(n) for n, c in fields.items()]).alias("_f"))
    return rows.where("id is not null").groupBy("id").agg(F.max_by("_f", "event_id").alias("_f"), F.count(F.lit(1)).alias("_n")).select("id", "_f.*", "_n")


def compile_state(log: DataFrame) -> Compiled:
    """log: event_id (sortable), occurred_at, event_type, payload (map of strings), supersedes."""
    merges = last(log, ("concept_merged",), key("from_concept_id"), dst=key("into_concept_id")).select(F.col("id").alias("src"), "dst")
    ends = G.merge_chain(merges).select(F.col("src").alias("_src"), F.col("dst").alias("_dst"))

    def resolved(df: DataFrame, name: str) -> DataFrame:
        return df.join(ends, F.col(name) == F.col("_src"), "left").withColumn(name, F.coalesce("_dst", name)).drop("_src", "_dst")

    created = last(log, ("concept_created",), key("concept_id"), canonical_name=key("canonical_name")).drop("_n")
    names = created.select(F.col("id").alias("_gone"), "canonical_name")
    alias = resolved(log.where("event_type in ('alias_added', 'alias_removed')").select(key("concept_id").alias("key"), "event_id", F.when(F.col("event_type") == "alias_added", "add").otherwise("remove").alias("op"), key("alias").alias("alias")), "key")
    folded = log.where("event_type = 'concept_merged'").select(key("from_concept_id").alias("_gone"), "event_id").join(names, "_gone")
    folded = resolved(folded.select(F.col("_gone").alias("key"), "event_id", F.lit("add").alias("op"), F.col("canonical_name").alias("alias")), "key")
    folded = folded.join(created.select(F.col("id").alias("key"), F.col("canonical_name").alias("_own")), "key").where("alias <> _own").drop("_own")
    aliases = D.alias_fold(alias.unionByName(folded)).select(F.col("key").alias("id"), "aliases")

    judged = last(log, ("encounter_confirmed", "encounter_dismissed", "encounter_judgment_retracted"), key("encounter_id"), judgment=F.when(F.col("event_type") == "encounter_confirmed", "confirmed").when(F.col("event_type") == "encounter_dismissed", "dismissed"), judged_at=F.when(F.col("event_type") != "encounter_judgment_retracted", F.col("occurred_at"))).drop("_n")
    spots = log.where("event_type = 'familiarity_judged'").where(key("verdict") == "spot_check").select(key("encounter_id").alias("id")).distinct().withColumn("spot_check", F.lit(True))
    met = last(log, ("encounter_recorded",), key("encounter_id"), concept_id=key("concept_id"), source=key("source"), paraphrase=key("paraphrase"), session_id=key("session_id"), occurred_at=F.col("occurred_at"), event_id=F.col("event_id"), supersedes=F.col("supersedes"))
    met = resolved(met, "concept_id").join(judged, "id", "left").join(spots, "id", "left")
    encounters = met.select(F.col("id").alias("encounter_id"), "concept_id", "source", "paraphrase", "session_id", "occurred_at", "event_id", "judgment", "judged_at", F.coalesce("spot_check", F.lit(False)).alias("spot_check"), ((F.col("_n") > 1) & F.col("supersedes").isNotNull()).alias("superseded"))

    told = log.where("event_type = 'explanation_submitted'").select(F.col("event_id").alias("id"), key("concept_id").alias("concept_id"), key("raw_text").alias("raw_text"), F.col("occurred_at").alias("submitted_at"))
    grades = last(log, ("explanation_graded",), key("explanation_id"), level=key("level"), rubric=key("rubric"), graded_at=F.col("occurred_at")).drop("_n")
    explanations = resolved(told, "concept_id").join(grades, "id", "left").withColumnRenamed("id", "explanation_id")

    made = last(log, ("material_generated",), key("material_id"), format=key("format"), covers=F.split(key("covers_concept_ids"), ","), generated_at=F.col("occurred_at")).drop("_n")
    delivered = last(log, ("material_delivered",), key("material_id"), delivered_at=F.col("occurred_at")).drop("_n")
    materials = made.join(delivered, "id", "left").withColumnRenamed("id", "material_id")
    shown = resolved(materials.where("delivered_at is not null").select(F.explode("covers").alias("concept_id")), "concept_id").distinct().withColumn("exposed", F.lit(True))

    rolled = encounters.groupBy("concept_id").agg(
        F.count(F.lit(1)).alias("encounter_count"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"),
        F.max_by("judgment", F.when(F.col("judgment").isNotNull(), F.struct("judged_at", "event_id"))).alias("judgment"), F.bool_or(F.col("judgment").isNotNull()).alias("judged"),
    )
    levels = explanations.groupBy("concept_id").agg(F.max_by("level", "graded_at").alias("level"), F.lit(True).alias("explained"))
    one = created.join(merges.withColumnRenamed("src", "id").withColumnRenamed("dst", "merged_into"), "id", "left").join(aliases, "id", "left").withColumnRenamed("id", "concept_id")
    one = one.join(rolled, "concept_id", "left").join(levels, "concept_id", "left").join(shown, "concept_id", "left")
    count = F.coalesce("encounter_count", F.lit(0))
    state = D.derive_state(count, F.col("level"), F.col("judgment"), F.col("exposed"))
    staged = one.withColumns({"encounter_count": count, "state": state})
    bucket = D.bucket_for(F.col("state"), F.col("encounter_count"), F.coalesce("judged", F.lit(False)), F.coalesce("explained", F.lit(False)))
    concepts = staged.withColumn("bucket", bucket).drop("exposed", "explained", "judged")
    sessions = last(log, ("session_analysed",), key("session_id"), analysed_at=F.col("occurred_at"), candidates_found=F.coalesce(key("candidates_found").try_cast("int"), F.lit(0))).drop("_n").withColumnRenamed("id", "session_id")
    return Compiled(concepts, encounters, explanations, materials, sessions, D.compile_meta(log))


def prompts(turns: DataFrame, budget: int = X.BUDGET) -> DataFrame:
    """session_id, chunk, prompt: the exchanges of each chunk as text, a shared reply once."""
    grouped = X.islands(X.exchanges(turns))
    packed = grouped.join(X.chunks(X.island_sizes(grouped), budget), ["session_id", "island"])
    said = packed.select("session_id", "chunk", F.col("assistant_line").alias("at"), F.concat(F.lit("[assistant "), F.col("assistant_line").cast("string"), F.lit("] "), "assistant_text").alias("l"))
    replies = packed.where("human_line is not null").select("session_id", "chunk", F.col("human_line").alias("at"), F.concat(F.lit("[human "), F.col("human_line").cast("string"), F.lit("] "), "human_text").alias("l")).distinct()
    keyed = said.unionByName(replies).withColumn("k", F.struct("session_id", "chunk"))
    return ordered_block(keyed, "k", ["at"], F.col("l"), "prompt").select("k.*", "prompt")


def detect(turns: DataFrame, call: Callable[[str], list[dict]], workers: int = 4, budget: int = X.BUDGET) -> DataFrame:
    """Ranked candidates of every session: propose for each chunk, keep what is anchored, first spelling wins, rank."""
    proposed = injected.propose(prompts(turns, budget), call, workers)
    return T.rank(T.first_wins(T.coerce(proposed, X.exchanges(turns))))


def analyse(turns: DataFrame, concepts: DataFrame, propose: Callable[[str], list[dict]], judge: Callable[[str, str], float], cut: float | None) -> DataFrame:
    """From turns to decisions: detect, bypass the judge for exact names, triage, resolve what is emitted.

    cut: from ``triage.cut_rule``; None holds nothing back and asks no judge.
    """
    gaps = detect(turns, propose).where("signal = 'accepted'")
    named = gaps.withColumn("submission_id", F.concat_ws(":", F.col("session_id").cast("string"), F.col("rank").cast("string")))
    known = R.exact_match(named.select("submission_id", F.col("term").alias("text")), concepts).select("submission_id", F.col("concept_id").isNotNull().alias("is_known"))
    rows = named.join(known, "submission_id").withColumn("gloss", F.col("paraphrase"))
    asked = injected.judge(rows, judge, F.col("is_known") if cut is not None else F.lit(True))
    verdicts = T.triage(asked, cut if cut is not None else 2.0)
    filed = R.resolve_all(verdicts.where("emitted").select("submission_id", F.col("term").alias("text")), concepts)
    return verdicts.join(filed.drop("text"), "submission_id", "left").select("session_id", "rank", "term", "assistant_line", "p", "verdict", "emitted", "decision", "concept_id")
