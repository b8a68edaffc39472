"""The cycle of explanations: submit, grade, grade anew, and their history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions import injected
from colloquy.functions.renders import question
from colloquy.operators.dml import LEVELS


def submit(answers: DataFrame, concepts: DataFrame) -> DataFrame:
    """Answers as they are to be stored, each beside the question it answers, or with the reason why not.

    answers: answer_id, concept_id, raw_text, prompt_text (null: today's question); concepts: concept_id, canonical_name.
    """
    asked = answers.join(concepts.select("concept_id", "canonical_name"), "concept_id", "left")
    text = F.regexp_replace(F.coalesce("raw_text", F.lit("")), r"^\s+|\s+$", "")
    prompt = F.coalesce("prompt_text", F.when(F.col("canonical_name").isNotNull(), question(F.col("canonical_name"))))
    error = F.when(text == "", "empty").when(prompt.isNull(), "no concept")
    return asked.select("answer_id", "concept_id", text.alias("raw_text"), prompt.alias("prompt_text"), error.alias("error"))


def regrade(log: DataFrame, call: Callable[[str, str], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The log without any grade, and a new grade for every explanation in it: explanation_id, level.

    log: event_id, event_type, payload. Only derived grades go; every explanation that was submitted is in what is kept.
    """
    kept = log.where("event_type <> 'explanation_graded'")
    key = lambda name: F.try_element_at("payload", F.lit(name))
    told = kept.where("event_type = 'explanation_submitted'").select(F.col("event_id").alias("explanation_id"), key("prompt_text").alias("question"), key("raw_text").alias("answer"))
    return kept, injected.grade(told, call).select("explanation_id", "level")


def unchanged(before: DataFrame, after: DataFrame, kind: str = "explanation_submitted") -> None:
    """Raises if a rewrite of the log changed how many events of a kind there are."""
    n, m = (x.where(F.col("event_type") == kind).count() for x in (before, after))
    if n != m:
        raise RuntimeError(f"{kind}: {n} events became {m}")


def rank_of(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level)


def history(explanations: DataFrame, key: str, order: str, level: str = "level") -> DataFrame:
    """Each explanation with its place among those of its concept, and whether it is better than the one before."""
    w = Window.partitionBy(key).orderBy(order)
    return explanations.withColumn("place", F.row_number().over(w).cast("long")).withColumn("better", rank_of(F.col(level)) > F.lag(rank_of(F.col(level))).over(w))
