import datetime as dt

import pytest
from pyspark.sql import functions as F

from colloquy.sources.store import SEED, Store, meter_sink, seed


def test_log_appends_valid_events_only_and_prunes_by_type(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.log().isEmpty()
    odd = spark.createDataFrame([("x1", "made_up", {"a": "b"}), ("x2", "concept_created", {"concept_id": "c"})], "event_id string, event_type string, payload map<string,string>")
    assert store.append(seed(spark)).isEmpty()
    assert {(r.event_id, r.error) for r in store.append(odd).collect()} == {("x1", "unknown type"), ("x2", "missing canonical_name")}
    assert store.log().count() == len(SEED)
    rows = store.log("encounter_confirmed", "encounter_dismissed").collect()
    assert {(r.event_id, r.actor, r.subject) for r in rows} == {("06", "user", "e1"), ("07", "user", "e2")}
    plan = store.log("alias_added")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_type" in plan


def test_derived_tables_are_swapped_dropped_and_the_log_backed_up(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.append(seed(spark))
    store.rewrite("states", spark.range(3))
    store.rewrite("states", store.derived("states").where("id > 0").withColumn("n", F.lit(1)))
    assert store.derived("states").count() == 2 and store.drop_derived() == ["states"] and store.drop_derived() == []
    now = dt.datetime(2024, 5, 6, 7, 8, 9)
    assert store.backup(f"file://{tmp_path}/b", now).endswith("20240506T070809Z")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        store.backup(f"file://{tmp_path}/b", now)


def test_metered_calls_are_appended_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    calls = spark.createDataFrame([("m1", "model_called", {"purpose": "judge"})], "event_id string, event_type string, payload map<string,string>")
    for epoch in range(2):
        meter_sink(store)(calls, epoch)
    assert store.log("model_called").count() == 1


def test_a_table_is_whole_at_any_time(spark, tmp_path):
    """A reader keeps what it has read through a rewrite; of two writers at once one raises; a broken write changes nothing."""
    store = Store(spark, f"file://{tmp_path}/s")
    store.rewrite("t", spark.range(3))
    held = store.derived("t")
    store.rewrite("t", spark.range(5))
    assert held.count() == 3 and store.derived("t").count() == 5
    with pytest.raises(Exception, match="(?i)divi"):
        store.rewrite("t", spark.range(4).select(F.expr("1 div (id - 2)").alias("id")))
    assert store.derived("t").count() == 5
    (tmp_path / "s" / "derived" / "t" / "_version-3").write_text("taken")
    with pytest.raises(Exception, match="(?i)exists"):
        store._versions = lambda name: [1, 2]
        store.rewrite("t", spark.range(1))
