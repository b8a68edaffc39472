"""Running the detector anew over history: what is to do, what goes before, what stays.

What a person judged is never touched. Each step is a set operation over the sessions asked for. ``Regeneration`` keeps
a ledger of finished sessions, so a run that was broken off goes on where it ended, and what readers see is the old
log until the new one takes its place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.functions import names as N
from colloquy.plans import compiled
from colloquy.sources.store import file_system
from colloquy.state import cut as cut_state


def plan(sessions: DataFrame, analysed: DataFrame, encounters: DataFrame, version: str, force: bool = False) -> DataFrame:
    """session_id, status (done or run), protected: how many of its encounters a person judged.

    analysed: session_id, version; encounters: session_id, judgment.
    """
    done = analysed.where(F.col("version") == version).select("session_id", F.lit(not force).alias("_done")).distinct()
    kept = encounters.where("judgment is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("protected"))
    joined = sessions.select("session_id").distinct().join(done, "session_id", "left").join(kept, "session_id", "left")
    return joined.select("session_id", F.when(F.coalesce("_done", F.lit(False)), "done").otherwise("run").alias("status"), F.coalesce("protected", F.lit(0).cast("long")).alias("protected"))


def cleared(log: DataFrame, sessions: DataFrame, protected: DataFrame) -> DataFrame:
    """The log before sessions are run anew: their derived encounters, analyses and triage records are gone.

    log: event_type, session_id, encounter_id and more; protected: encounter_id. A record of triage stays with the
    encounter that was judged; one that names no encounter goes.
    """
    marked = log.join(sessions.select("session_id").distinct().withColumn("_again", F.lit(True)), "session_id", "left")
    marked = marked.withColumn("_id", F.coalesce(F.col("encounter_id").cast("string"), F.lit("")))
    marked = marked.join(protected.select(F.col("encounter_id").cast("string").alias("_id")).distinct().withColumn("_kept", F.lit(True)), "_id", "left")
    goes = F.coalesce("_again", F.lit(False)) & ((F.col("event_type") == "session_analysed") | F.col("event_type").isin("encounter_recorded", "familiarity_judged") & F.col("_kept").isNull())
    return marked.where(~goes).select(*log.columns)


def regenerate(log: DataFrame, turns: DataFrame, sessions: DataFrame, protected: DataFrame, concepts: DataFrame, propose: Callable[[str], list[dict]], judge: Callable[[str, str], float], cut: float | None) -> tuple[DataFrame, DataFrame]:
    """The cleared log, and the decisions of a new run over the sessions' turns (see ``compiled.analyse``)."""
    asked = turns.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    return cleared(log, sessions, protected), compiled.analyse(asked, concepts, propose, judge, cut)


class Regeneration:
    """One version's run over history, in a folder that all executors share.

    Sessions are worked on in waves. What a wave found is written to a folder of its own, and then one file in the ledger
    names the wave's sessions, those without a finding too; only waves of the ledger count. A run that died leaves at most
    the waves' folders that no ledger file names, which the next run deletes before it does the rest.
    """

    def __init__(self, spark: SparkSession, folder: str, version: str):
        self.spark, self.version = spark, version
        self.folder = f"{folder.rstrip('/')}/{version}"

    def _waves(self, kind: str) -> set[str]:
        fs, path = file_system(self.spark, f"{self.folder}/{kind}")
        return {x.getPath().getName().removeprefix("wave=") for x in fs.listStatus(path) if x.getPath().getName().startswith("wave=") and fs.exists(x.getPath().suffix("/_SUCCESS"))} if fs.exists(path) else set()

    def ledger(self) -> DataFrame:
        """session_id, found, wave of every finished session."""
        kind = "session_id string, found long, wave string"
        return self.spark.read.schema(kind).parquet(f"{self.folder}/ledger/wave=*", basePath=f"{self.folder}/ledger") if self._waves("ledger") else self.spark.createDataFrame([], kind)

    def pending(self, sessions: DataFrame) -> DataFrame:
        return sessions.select(F.col("session_id").cast("string").alias("session_id")).distinct().join(self.ledger(), "session_id", "left_anti")

    def discard(self) -> list[str]:
        """Deletes what a broken run left in flight, and names those waves."""
        fs, path = file_system(self.spark, f"{self.folder}/found")
        there = {x.getPath().getName() for x in fs.listStatus(path)} if fs.exists(path) else set()
        gone = sorted(there - {f"wave={w}" for w in self._waves("ledger")})
        for name in gone:
            fs.delete(file_system(self.spark, f"{self.folder}/found/{name}")[1], True)
        return gone

    def run(self, sessions: DataFrame, work: Callable[[DataFrame], DataFrame], wave: int = 64, most_waves: int | None = None) -> int:
        """Works on what is pending, so many sessions a wave, and returns how many waves were done. work: sessions to findings with a session_id."""
        self.discard()
        done = 0
        while most_waves is None or done < most_waves:
            todo = cut_state(self.pending(sessions).orderBy("session_id").limit(wave), "wave")
            if todo.isEmpty():
                break
            name = uuid.uuid4().hex
            found = work(todo)
            found.withColumn("session_id", F.col("session_id").cast("string")).write.parquet(f"{self.folder}/found/wave={name}")
            counts = self.spark.read.schema(found.schema).parquet(f"{self.folder}/found/wave={name}").groupBy(F.col("session_id").cast("string").alias("session_id")).agg(F.count(F.lit(1)).alias("found"))
            ended = todo.join(counts, "session_id", "left").select("session_id", F.coalesce("found", F.lit(0).cast("long")).alias("found"))
            ended.coalesce(1).write.parquet(f"{self.folder}/ledger/wave={name}")
            done += 1
        return done

    def found(self) -> DataFrame:
        """The findings of all finished sessions."""
        return self.spark.read.option("basePath", f"{self.folder}/found").parquet(*[f"{self.folder}/found/wave={w}" for w in sorted(self._waves("ledger"))])

    def swapped(self, log: DataFrame, protected: DataFrame, events: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The log with finished sessions cleared and their new events in place, for ``Store.rewrite``. events: findings to rows of the log."""
        return cleared(log, self.ledger(), protected).unionByName(events(self.found()), allowMissingColumns=True)


def record_detection(sessions: DataFrame, windows: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row a session that was examined, those without a candidate too: what a detector's run said of it, emitted or not.

    sessions: session_id; windows: session_id, windows_examined; ranked: session_id, rank, term, line_start, line_end, emitted.
    An emitted candidate carries the id of the encounter it was filed under, which follows from its place and term.
    """
    own = F.when(F.col("emitted"), N.fingerprint(F.col("session_id"), F.col("line_start"), F.col("line_end"), F.col("term")))
    held = F.array_sort(F.collect_list(F.struct("rank", "term", "line_start", "line_end", "emitted", own.alias("encounter_id"))))  # a session's list
    runs = ranked.groupBy("session_id").agg(F.count(F.lit(1)).alias("candidates_found"), F.count_if("emitted").alias("n_emitted"), held.alias("candidates"))
    joined = sessions.select("session_id").distinct().join(windows, "session_id", "left").join(runs, "session_id", "left")
    none = F.lit(0).cast("long")
    return joined.select("session_id", *[F.coalesce(c, none).alias(c) for c in ("windows_examined", "candidates_found", "n_emitted")], F.coalesce("candidates", F.array().cast(runs.schema["candidates"].dataType)).alias("candidates"))
