"""Streaming forms: watermarked occasions, quiet projects, replay-safe ingestion, derived queue, daily notices.

The reference logic has no event-time lateness rule; the watermarks here are new behaviour and a parameter of each. Quiet
projects go by the clock and have none.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from colloquy.operators.exchange import pending


def stream_occasions(events: DataFrame, key: str, at: str, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sessions of events by gap: key, start, end, n; appended once no late event can join them."""
    windowed = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return windowed.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Each key once, whatever is replayed within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def quiet(files: DataFrame, now: str, minutes: int = 10) -> DataFrame:
    """Batch form: files of projects in which no file changed in the last so many minutes. files: project, path, changed_at."""
    last = files.groupBy("project").agg(F.max("changed_at").alias("last"))
    settled = last.where(F.col("last") <= F.lit(now).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes)))
    return files.join(settled.select("project"), "project", "left_semi")


class QuietProject(StatefulProcessor):
    """One project: its changed paths with their last change, and one timer of processing time, that of the newest change."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.changed = handle.getMapState("changed", "path string", "at long")

    def _newest(self) -> int:
        return max((row[0] for row in self.changed.values()), default=0)

    def _arm(self, now: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(self._newest() + self.quiet_ms, now + 1))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            newest = batch.groupby("path")["changed_at"].max()
            for path, at in newest.items():
                at, held = int(at.timestamp() * 1000), self.changed.getValue((path,))
                self.changed.updateValue((path,), (max(at, held[0]) if held else at,))
        self._arm(timerValues.getCurrentProcessingTimeInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, now = self._newest(), timerValues.getCurrentProcessingTimeInMs()
        if newest + self.quiet_ms > now:  # it changed again since
            self._arm(now)
            return
        paths = sorted(row[0] for row in self.changed.keys())
        self.changed.clear()
        if paths:
            yield pd.DataFrame({"project": [key[0]], "paths": [paths], "quiet_since": [pd.Timestamp(newest, unit="ms")]})

    def close(self) -> None:
        pass


def stream_quiet(changes: DataFrame, minutes: float = 10) -> DataFrame:
    """Stream form: a project's changed paths, once none of them changed for so long by the clock. changes: project, path, changed_at.

    A change while a project waits re-arms its timer, and what changed stays in its state until it comes out. A path that
    changes after that, as while it is being captured, is a new change and waits anew, so none is lost; nor is one late for
    that other projects went on, as the timers are of processing time. Needs the RocksDB state store.
    """
    kind = "project string, paths array<string>, quiet_since timestamp"
    return changes.select("project", "path", "changed_at").groupBy("project").transformWithStateInPandas(QuietProject(int(minutes * 60_000)), kind, "append", "processingTime")


def derive_queue(coverage: Callable[[], DataFrame], turns: Callable[[], DataFrame], sink: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: recompute what is pending from the tables as they are, whatever the batch held."""

    def each(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            sink(pending(turns(), coverage()).withColumn("epoch", F.lit(epoch)))

    return each


def eligible(sessions: DataFrame, opted_in: str) -> DataFrame:
    """Only what was captured after automatic work was allowed."""
    return sessions.where(F.col("captured_at") >= F.lit(opted_in).cast("timestamp"))


def catch_up(files: DataFrame, now: str, days: int = 7) -> DataFrame:
    return files.where(F.col("changed_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))


def daily_once(notices: DataFrame, hour: int, remember_days: int = 90) -> DataFrame:
    """At most one notice a day and user, only from an hour on, a key not again within so many days. notices: user, key, at, text."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, seen = state.get if state.exists else ("", [])
        held, out = dict(x.split(" ", 1)[::-1] for x in seen), []  # key -> the day it was told, kept as "day key"
        for b in batches:
            for r in b.sort_values(["at", "key"]).itertuples():
                today = r.at.date().isoformat()
                if r.at.hour >= hour and today > day and r.key not in held:
                    day, held[r.key] = today, today
                    out.append((key[0], r.key, r.at, r.text))
        if day:
            oldest = (dt.date.fromisoformat(day) - dt.timedelta(days=remember_days)).isoformat()
            held = {k: d for k, d in held.items() if d > oldest}
        state.update((day, sorted(f"{d} {k}" for k, d in held.items())))
        yield pd.DataFrame(out, columns=["user", "key", "at", "text"])

    schema = "user string, key string, at timestamp, text string"
    return notices.groupBy("user").applyInPandasWithState(step, schema, "day string, seen array<string>", "append", GroupStateTimeout.NoTimeout)


def daily_once_batch(notices: DataFrame, hour: int) -> DataFrame:
    """Batch form for keys that occur once: the first notice of each user and day from the hour on."""
    able = notices.where(F.hour("at") >= hour)
    first = able.groupBy("user", F.to_date("at").alias("day")).agg(F.min(F.struct("at", "key")).alias("f"))
    return first.select("user", F.col("f.key").alias("key"), F.col("f.at").alias("at"))


def week_ago(now: dt.datetime, days: int = 7) -> dt.datetime:
    return now - dt.timedelta(days=days)
