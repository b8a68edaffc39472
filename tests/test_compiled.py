import datetime as dt

import pytest
from pyspark.sql import functions as F

from colloquy.plans import compiled as C

EVENTS = [
    ("concept_created", {"concept_id": "k8s", "canonical_name": "K8s"}), ("concept_created", {"concept_id": "kube", "canonical_name": "Kubernetes"}), ("concept_created", {"concept_id": "wal", "canonical_name": "WAL"}), ("concept_created", {"concept_id": "ref", "canonical_name": "Referenced"}),
    ("alias_added", {"concept_id": "kube", "alias": "kube"}), ("alias_added", {"concept_id": "k8s", "alias": "k-eights"}), ("encounter_confirmed", {"encounter_id": "e2"}), ("encounter_recorded", {"encounter_id": "e1", "concept_id": "k8s", "source": "detector", "paraphrase": "old"}),
    ("encounter_recorded", {"encounter_id": "e2", "concept_id": "wal", "source": "manual", "paraphrase": "w"}), ("concept_merged", {"from_concept_id": "k8s", "into_concept_id": "kube"}), ("alias_added", {"concept_id": "k8s", "alias": "late"}), ("alias_removed", {"concept_id": "kube", "alias": "kube"}),
    ("encounter_recorded", {"encounter_id": "e1", "concept_id": "k8s", "source": "detector", "paraphrase": "new"}), ("encounter_dismissed", {"encounter_id": "e1"}), ("encounter_judgment_retracted", {"encounter_id": "e1"}), ("material_delivered", {"material_id": "m1"}),
    ("material_generated", {"material_id": "m1", "format": "text", "covers_concept_ids": "k8s,ref"}), ("explanation_graded", {"explanation_id": "x", "rubric": "r", "level": "causal"}), ("session_analysed", {"session_id": "s", "candidates_found": "3"}), ("session_analysed", {"session_id": "s", "candidates_found": "0"}),
    ("familiarity_judged", {"verdict": "spot_check", "encounter_id": "e2"}),
]


@pytest.fixture(scope="module")
def log(spark):
    rows = [(f"{k:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), t, p, "007" if k == 12 else None) for k, (t, p) in enumerate(EVENTS)]
    rows.append(("900", dt.datetime(2024, 2, 1), "explanation_submitted", {"concept_id": "wal", "raw_text": "t", "prompt_text": "p", "prompt_version": "1"}, None))
    rows.append(("901", dt.datetime(2024, 2, 2), "explanation_graded", {"explanation_id": "900", "rubric": "r", "level": "causal"}, None))
    return spark.createDataFrame(rows, "event_id string, occurred_at timestamp, event_type string, payload map<string,string>, supersedes string")


def test_fold_resolves_merges_and_late_references(log):
    got = C.compile_state(log)
    concepts = {r.concept_id: r for r in got.concepts.collect()}
    assert concepts["k8s"].merged_into == "kube" and concepts["kube"].aliases == "k-eights,K8s,late"
    assert (concepts["kube"].state, concepts["kube"].bucket, concepts["kube"].encounter_count) == ("exposed", "open", 1)
    assert (concepts["wal"].state, concepts["wal"].bucket, concepts["wal"].level) == ("known", "closed", "causal")
    assert (concepts["ref"].state, concepts["ref"].bucket) == ("referenced", "hidden")
    encounters = {r.encounter_id: r for r in got.encounters.collect()}
    assert (encounters["e1"].concept_id, encounters["e1"].paraphrase, encounters["e1"].judgment, encounters["e1"].superseded) == ("kube", "new", None, True)
    assert (encounters["e2"].judgment, encounters["e2"].spot_check, encounters["e2"].superseded) == ("confirmed", True, False)
    assert got.materials.first().delivered_at is not None and got.sessions.first().candidates_found == 0
    assert got.explanations.first().level == "causal" and got.meta.first().event_count == len(EVENTS) + 2


def test_compiling_twice_or_in_another_order_is_the_same(log):
    a, b = C.compile_state(log), C.compile_state(log.orderBy(F.desc("event_id")).repartition(5))
    for name in ("concepts", "encounters", "explanations", "materials", "sessions"):
        rows = lambda c: sorted(map(str, getattr(c, name).select(*sorted(getattr(c, name).columns)).collect()))  # noqa: B023, E731
        assert rows(a) == rows(b)


def test_analysis_end_to_end(spark):
    text = "The transactional outbox writes events beside the data it belongs to."
    rows = [(1, 1, "user", "why?"), (1, 2, "assistant", text), (1, 3, "assistant", text + " More."), (1, 4, "user", "ok, accepted"), (1, 5, "assistant", text), (2, 1, "assistant", text)]
    turns = spark.createDataFrame([(*r, False, False) for r in rows], "session_id long, line_no long, role string, text string, is_meta boolean, is_sidechain boolean")
    shown = {r.prompt for r in C.prompts(turns).where("session_id = 1").collect()}
    assert len(shown) == 1 and shown.pop().count("accepted") == 1

    def propose(prompt):
        base = {"paraphrase": "p", "signal": "accepted", "importance": "central"}
        out = [{"term": "Outbox", "assistant_line": 2, **base}, {"term": "outbox ", "assistant_line": 3, **base}, {"term": "Saga", "assistant_line": 3, **base, "importance": "odd"}, {"term": "Ghost", "assistant_line": 40, **base}, {"term": "Known one", "assistant_line": 3, **base}]
        return out if "[assistant 2]" in prompt else []

    concepts = spark.createDataFrame([("c1", "Known One", ["k1"], 2)], "concept_id string, canonical_name string, aliases array<string>, encounter_count long")
    got = {r.term: r for r in C.analyse(turns, concepts, propose, lambda term, gloss: 0.95 if term == "Saga" else 0.1, 0.9).collect()}
    assert set(got) == {"Outbox", "Saga", "Known one"}
    assert (got["Outbox"].verdict, got["Outbox"].decision) == ("passed", "new") and got["Saga"].verdict in ("held", "spot_check")
    assert (got["Known one"].p, got["Known one"].decision, got["Known one"].concept_id) == (None, "existing", "c1")
    free = C.analyse(turns, concepts, propose, lambda term, gloss: 1.0, None).collect()
    assert all(r.verdict == "passed" and r.p is None for r in free) and sum(r.emitted for r in free) == 2
