"""Repairs, grading, regeneration and measures on small cases with known answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from colloquy.functions import injected
from colloquy.operators import grading, probes, regeneration, repair
from colloquy.plans.compiled import compile_state
from colloquy.state import quantiles, small


def test_a_split_gives_the_encounter_a_concept_of_its_own_and_takes_the_alias_back(spark):
    asked = spark.createDataFrame([(1, "j1", "no", None, "e1"), (2, "j2", "dup", "c9", None), (3, "j9", "?", None, None), (4, "j1", "?", "c2", "e1"), (5, "j1", "?", None, "e2"), (6, "j2", "self", "c2", None)], "origin long, target string, reasoning string, merge_into string, split_out string")
    judged = spark.createDataFrame([("j1", "c1", "alias", "WAL", " Write log "), ("j2", "c2", "existing", None, "")], "target string, concept_id string, decision string, alias string, input_text string")
    met = spark.createDataFrame([("e1", "c1", "s", "p", "s1", "05"), ("e2", "c2", "s", "p", None, "06")], "encounter_id string, at_concept string, source string, paraphrase string, session_id string, event_id string").withColumn("met_at", F.lit("2024-01-01").cast("timestamp"))
    events, refused = repair.correct(asked, judged, met)
    got = {(r.origin, r.event_type): r.payload for r in events.collect()}
    new = got[1, "concept_created"]["concept_id"]
    assert new.startswith("write-log-") and got[1, "alias_removed"] == {"concept_id": "c1", "alias": "WAL"} and got[1, "encounter_recorded"]["concept_id"] == new
    assert got[2, "concept_merged"]["into_concept_id"] == "c9" and (6, "concept_merged") not in got and (6, "resolver_judgment_corrected") in got
    assert {r.origin: r.error for r in refused.collect()} == {3: "no judgment", 4: "merge and split", 5: "not under that concept"}


def test_a_merge_is_folded_by_the_compile(spark):
    start = [("01", "concept_created", {"concept_id": "a", "canonical_name": "K8s"}), ("02", "concept_created", {"concept_id": "b", "canonical_name": "Kubernetes"}), ("03", "encounter_recorded", {"encounter_id": "e", "concept_id": "a", "source": "s", "paraphrase": "p"})]
    log = spark.createDataFrame(start, "event_id string, event_type string, payload map<string,string>")
    pairs = spark.createDataFrame([(1, "a", "b", "same"), (2, "b", "b", "self")], "origin long, from_concept_id string, into_concept_id string, reasoning string")
    log = log.unionByName(repair.merge(pairs).select(F.concat(F.lit("1"), "origin").alias("event_id"), "event_type", "payload"))
    state = compile_state(log.withColumns({"occurred_at": F.lit("2024-01-01").cast("timestamp"), "supersedes": F.lit(None).cast("string")}))
    got = {r.concept_id: (r.encounter_count, r.aliases, r.merged_into) for r in state.concepts.collect()}
    assert got == {"b": (1, "K8s", None), "a": (0, None, "b")}


def test_grades_are_made_anew_from_what_was_submitted(spark):
    log = spark.createDataFrame([("1", "explanation_submitted", {"prompt_text": "q", "raw_text": "x because y"}), ("2", "explanation_submitted", {"prompt_text": "q", "raw_text": "one"}), ("3", "explanation_graded", {"explanation_id": "1", "level": "isolated"}), ("4", "other", {})], "event_id string, event_type string, payload map<string,string>")
    kept, grades = grading.regrade(log)
    assert {r.explanation_id: r.level for r in grades.collect()} == {"1": "causal", "2": "isolated"} and kept.count() == 3
    assert {r.level for r in grading.regrade(log, lambda q, a: "odd")[1].collect()} == {"isolated"}
    grading.unchanged(log, kept)
    with pytest.raises(RuntimeError, match="2 events became 1"):
        grading.unchanged(log, log.where("event_id <> '1'"))
    answers = spark.createDataFrame([(1, 1, "  "), (2, 1, " a\n"), (3, 5, "b")], "answer_id long, concept_id long, raw_text string").withColumn("prompt_text", F.lit(None).cast("string"))
    got = {r.answer_id: (r.raw_text, r.error) for r in grading.submit(answers, spark.createDataFrame([(1, "X")], "concept_id long, canonical_name string")).collect()}
    assert got == {1: ("", "empty"), 2: ("a", None), 3: ("b", "no concept")}


def test_regeneration_leaves_what_was_judged(spark):
    log = spark.createDataFrame(
        [(1, "encounter_recorded", "s1", "e1"), (2, "encounter_recorded", "s1", "e2"), (3, "session_analysed", "s1", None), (4, "familiarity_judged", "s1", "e1"), (5, "familiarity_judged", "s1", None), (6, "encounter_recorded", "s2", "e3"), (7, "encounter_confirmed", "s1", "e2"), (8, "x", None, None)],
        "event_id long, event_type string, session_id string, encounter_id string",
    )
    one, protected = spark.createDataFrame([("s1",)], "session_id string"), spark.createDataFrame([("e1",)], "encounter_id string")
    assert sorted(r.event_id for r in regeneration.cleared(log, one, protected).collect()) == [1, 4, 6, 7, 8]
    sessions = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "session_id string")
    done = spark.createDataFrame([("s1", "v1"), ("s2", "v0")], "session_id string, version string")
    met = spark.createDataFrame([("s1", "confirmed"), ("s1", None), ("s2", "dismissed")], "session_id string, judgment string")
    plan = lambda **k: {r.session_id: (r.status, r.protected) for r in regeneration.plan(sessions, done, met, "v1", **k).collect()}
    assert plan() == {"s1": ("done", 1), "s2": ("run", 1), "s3": ("run", 0)} and plan(force=True)["s1"] == ("run", 1)
    again, decided = regeneration.regenerate(log, spark.createDataFrame([], "session_id string, line_no long, seq int, role string, text string, is_meta boolean, is_sidechain boolean"), one, protected, spark.createDataFrame([], "concept_id string, canonical_name string, aliases array<string>, encounter_count long"), lambda p: [], lambda t, g: 0.5, 0.6)
    assert again.count() == 5 and decided.isEmpty()


def test_deciders_and_writers_are_not_trusted(spark):
    rows = [("a", "manual"), ("b", "transcript"), ("c", "transcript"), ("d", "manual"), ("e", "transcript"), ("f", "manual"), ("g", "manual")]
    frame = spark.createDataFrame([(t, source, ["c1"]) for t, source in rows], "text string, source string, shortlist array<string>")
    known = spark.createDataFrame([("c1", "One"), ("c2", "Two")], "concept_id string, canonical_name string")
    said = {"a": {"decision": "alias", "concept_id": "c1"}, "b": {"decision": "existing", "concept_id": "c7"}, "c": {"decision": "existing", "concept_id": "c2"}, "d": {"decision": "unclear"}, "e": {"decision": "Unclear", "canonical_name": "E (expanded)"}, "f": {"decision": "new", "canonical_name": "Eff"}}
    got = {r.text: (r.decision, r.concept_id, r.canonical_name, r.alias, r.proposed_name) for r in injected.decide(frame, lambda t, offered: said[t], known).collect()}
    assert got == {
        "a": ("alias", "c1", "One", "a", None), "b": ("new", None, "b", None, None), "c": ("existing", "c2", "Two", None, None), "d": ("unclear", None, None, None, None),
        "e": ("new", None, "e", None, "E (expanded)"), "f": ("new", None, "Eff", None, None), "g": (None, None, None, None, None),
    }
    prompts = spark.createDataFrame([("p", ["x", "y"]), ("q", ["x"])], "prompt string, wanted array<string>")
    got = {r.prompt: (r.body, r.covers) for r in injected.write(prompts, lambda p: {"body": " text ", "covers": ["y", "z", "x"]} if p == "p" else {}).collect()}
    assert got == {"p": ("text", ["x", "y"]), "q": (None, None)}
    assert injected.retrying(lambda x: 1 / 0, lambda x: x)(3) == 3 and injected.retrying(lambda x: x, lambda x: 0)(3) == 3


def test_terms_within_texts_and_quantiles(spark):
    texts = spark.createDataFrame([(1, "The Cache caches"), (2, None), (3, "")], "id long, text string")
    terms = spark.createDataFrame([("cache",), ("CACHE",), ("he c",), ("none",), ("",)], "term string")
    for most in (200_000, 1):
        assert sorted(map(tuple, probes.contained(texts, terms, "id", "text", most=most).collect())) == [(1, "CACHE"), (1, "cache"), (1, "he c")]
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 4.0), (None, 7.0), ("b", None)], "k string, v double")
    got = {r.k: (r.p50, r.p90) for r in quantiles(rows, "k", "v", {"p50": 0.5, "p90": 0.9}).collect()}
    assert got == {"a": (3.0, 4.0), None: (7.0, 7.0)}
    assert small(rows, 3).count() == small(rows).count() == 6
