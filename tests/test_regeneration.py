"""A regeneration that dies goes on where it ended, and nobody sees half of it."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import regeneration as A
from colloquy.sources.store import Store

LOG = "event_type string, session_id string, encounter_id string, note string"


def test_a_killed_run_is_resumed(spark, tmp_path):
    sessions = spark.createDataFrame([(f"s{k}",) for k in range(10)], "session_id string")
    history = spark.createDataFrame([("encounter_recorded", f"s{k}", f"e{k}", "old") for k in range(10)] + [("session_analysed", "s1", None, "old"), ("concept_created", None, None, "old")], LOG)
    store = Store(spark, f"file://{tmp_path}/s")
    store.rewrite("log", history)
    asked = []

    def work(todo, dies_at=None):
        names = [r["session_id"] for r in todo.collect()]
        asked.append(names)
        if dies_at in names:
            raise RuntimeError("killed")
        return todo.where("session_id <> 's4'").select("session_id", F.lit("new").alias("note"))

    first = A.Regeneration(spark, f"file://{tmp_path}/r", "v2")
    with pytest.raises(RuntimeError):
        first.run(sessions, lambda todo: work(todo, "s7"), wave=3)
    (tmp_path / "r" / "v2" / "found" / "wave=half").mkdir(parents=True)  # of a wave that was in flight
    assert store.derived("log").where("note = 'new'").isEmpty() and first.ledger().count() == 6
    asked.clear()
    again = A.Regeneration(spark, f"file://{tmp_path}/r", "v2")
    assert again.run(sessions, work, wave=3) == 2 and sorted(sum(asked, [])) == ["s6", "s7", "s8", "s9"]
    assert not (tmp_path / "r" / "v2" / "found" / "wave=half").exists()
    assert {r["session_id"]: r["found"] for r in again.ledger().collect()} == {f"s{k}": int(k != 4) for k in range(10)}
    assert again.run(sessions, work, wave=3) == 0  # all is done
    protected = spark.createDataFrame([("e2",)], "encounter_id string")
    new = lambda found: found.select(F.lit("encounter_recorded").alias("event_type"), "session_id", F.concat(F.lit("n"), F.col("session_id")).alias("encounter_id"), "note")
    store.rewrite("log", again.swapped(store.derived("log"), protected, new))
    rows = [(r["event_type"], r["session_id"], r["note"]) for r in store.derived("log").collect()]
    assert sorted(rows, key=str) == sorted([("encounter_recorded", f"s{k}", "new") for k in range(10) if k != 4] + [("encounter_recorded", "s2", "old"), ("concept_created", None, "old")], key=str)
    assert A.Regeneration(spark, f"file://{tmp_path}/r", "v3").ledger().isEmpty()  # another version starts anew


def test_detections_are_recorded_with_nothing_found_too(spark):
    sessions = spark.createDataFrame([("a",), ("b",), ("b",)], "session_id string")
    windows = spark.createDataFrame([("a", 3)], "session_id string, windows_examined long")
    ranked = spark.createDataFrame([("a", 2, "t2", 5, 6, False), ("a", 1, "T 1", 3, 4, True)], "session_id string, rank long, term string, line_start long, line_end long, emitted boolean")
    got = {r["session_id"]: r for r in A.record_detection(sessions, windows, ranked).collect()}
    assert [(c["rank"], c["term"], c["encounter_id"] is not None) for c in got["a"]["candidates"]] == [(1, "T 1", True), (2, "t2", False)]
    assert (got["b"]["windows_examined"], got["b"]["candidates_found"], got["b"]["n_emitted"], got["b"]["candidates"]) == (0, 0, 0, []) and len(got) == 2
