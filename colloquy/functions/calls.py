"""Calls of an expensive function, so many at once: bounded, failing fast, and none that is finished is made twice.

Requests are worked on in waves. A wave's tasks keep at most ``in_flight`` calls each in threads; a call that raises stops
its task from starting more, what is in flight is waited for, and all that was answered is written with the failure. The
wave is then the last one: the failure is raised on the driver. The next run asks for what has no answer yet.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.shipping import ship
from colloquy.sources.store import file_system
from colloquy.state import cut

ANSWER = "key string, answer string, error string, started timestamp, millis long"


class CallFailed(RuntimeError):
    """A call raised; what was answered before is kept."""


class Calls:
    """Answers by key in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def made(self) -> DataFrame:
        """Every call that was made, failed ones too: what a meter of calls counts."""
        fs, path = file_system(self.spark, self.folder)
        done = [x.getPath() for x in fs.listStatus(path) if fs.exists(x.getPath().suffix("/_SUCCESS"))] if fs.exists(path) else []
        return self.spark.read.schema(ANSWER).parquet(*[p.toString() for p in done]) if done else self.spark.createDataFrame([], ANSWER)

    def answers(self) -> DataFrame:
        """key and answer of the calls that were answered."""
        return self.made().where("error is null").select("key", "answer")

    def ask(self, requests: DataFrame, call: Callable[[str], str], workers: int = 4, in_flight: int = 6, a_task: int = 64) -> DataFrame:
        """Makes the calls that have no answer yet, and returns all answers. requests: key, prompt.

        workers tasks of at most a_task calls are a wave; at most workers * in_flight calls are made at once.
        """
        ship(self.spark)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def one(key: str, prompt: str) -> tuple:
                began, clock = pd.Timestamp.now("UTC").tz_localize(None), time.monotonic()
                try:
                    answer, error = call(prompt), None
                except Exception as e:  # noqa: BLE001  whatever the caller's function raises
                    answer, error = None, f"{type(e).__name__}: {e}"[:500]
                return key, answer, error, began, int((time.monotonic() - clock) * 1000)

            rows = ((r.key, r.prompt) for b in batches for r in b.itertuples())
            running: set[Future] = set()
            failed, more = False, True
            with ThreadPoolExecutor(in_flight) as pool:
                while running or more and not failed:
                    while more and not failed and len(running) < in_flight:
                        row = next(rows, None)
                        more = row is not None
                        if more:
                            running.add(pool.submit(one, *row))
                    if not running:
                        break
                    done, running = wait(running, return_when=FIRST_COMPLETED)
                    found = [f.result() for f in done]
                    failed = failed or any(x[2] is not None for x in found)
                    yield pd.DataFrame(found, columns=["key", "answer", "error", "started", "millis"])

        while True:
            todo = requests.select("key", "prompt").dropDuplicates(["key"]).join(self.answers(), "key", "left_anti")
            todo = cut(todo.orderBy("key").limit(workers * a_task), "calls")
            if todo.isEmpty():
                return self.answers()
            wave = f"{self.folder}/wave-{uuid.uuid4().hex}"
            todo.repartition(workers).mapInPandas(run, ANSWER).write.parquet(wave)
            errors = self.spark.read.schema(ANSWER).parquet(wave).where("error is not null").orderBy("started").limit(3).collect()
            if errors:
                raise CallFailed("; ".join(f"{e['key']}: {e['error']}" for e in errors))


def metered(made: DataFrame, purpose: str) -> DataFrame:
    """Calls as events for ``store.meter_sink``: one a call, whether it was answered or not."""
    payload = F.create_map(F.lit("purpose"), F.lit(purpose), F.lit("ok"), F.col("error").isNull().cast("string"), F.lit("duration_ms"), F.col("millis").cast("string"), F.lit("error"), F.coalesce("error", F.lit("")))
    event_id = F.sha2(F.concat_ws("|", F.lit(purpose), "key", F.col("started").cast("string")), 256)
    return made.select(event_id.alias("event_id"), F.col("started").alias("occurred_at"), F.lit("model_called").alias("event_type"), payload.alias("payload"))
