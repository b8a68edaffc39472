"""Calls are bounded, stop at a failure, and are never made again once answered."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import calls as C
from colloquy.sources.store import Store, meter_sink


def counting(folder: str, fails: str | None = None):
    """A call that notes each start in a folder and answers how many were in flight in its worker."""

    def call(prompt: str) -> str:
        import os
        import threading
        import time

        open(f"{folder}/{prompt}-{time.monotonic_ns()}", "w").close()
        lock = os.__dict__.setdefault("_lock", threading.Lock())
        with lock:
            os._active = getattr(os, "_active", 0) + 1
            seen = os._active
        time.sleep(0.05)
        with lock:
            os._active -= 1
        if prompt == fails:
            raise ValueError("no credit")
        return str(seen)

    return call


def test_calls_are_bounded_fail_fast_and_go_on(spark, tmp_path):
    for name in ("first", "second"):
        (tmp_path / name).mkdir()
    requests = spark.range(60).select(F.format_string("k%02d", "id").alias("key"), F.format_string("p%02d", "id").alias("prompt"))
    requests = requests.union(requests.limit(3))
    calls = C.Calls(spark, f"file://{tmp_path}/answers")
    with pytest.raises(C.CallFailed, match="no credit"):
        calls.ask(requests, counting(str(tmp_path / "first"), "p05"), workers=1, in_flight=3, a_task=20)
    started = {p.name.split("-")[0] for p in (tmp_path / "first").iterdir()}
    kept = {r["key"] for r in calls.answers().collect()}
    assert len(started) < 20 and "p05" in started and kept == {f"k{p[1:]}" for p in started - {"p05"}}  # what was in flight is kept, nothing else was started
    got = calls.ask(requests, counting(str(tmp_path / "second")), workers=1, in_flight=3, a_task=20).collect()
    again = [p.name.split("-")[0] for p in (tmp_path / "second").iterdir()]
    assert len(got) == 60 and sorted(again) == sorted({f"p{k:02d}" for k in range(60)} - (started - {"p05"}))
    assert {int(r["answer"]) for r in got} <= {1, 2, 3} and max(int(r["answer"]) for r in got) == 3
    store = Store(spark, f"file://{tmp_path}/s")
    for epoch in range(2):
        meter_sink(store)(C.metered(calls.made(), "propose"), epoch)
    events = store.log("model_called").select("payload").collect()
    assert len(events) == 61 and sorted(r["payload"]["ok"] for r in events)[:2] == ["false", "true"]
