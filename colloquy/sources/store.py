"""The event log and derived tables as Parquet folders: append, read, rewrite, drop, back up.

The log is partitioned by event type, so readers of a few types touch only those folders. A derived table is a folder of
versions. A new one is written beside the present one and counts once a marker file names it, which is made in one step
and never overwritten; the version before stays for those who read it. So a reader meets a whole table at any time.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.operators.dml import validated

LOG = "event_id string, occurred_at timestamp, actor string, subject string, payload map<string,string>, supersedes string, event_type string"


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Store:
    """A folder with ``log`` and ``derived`` below it, on any file system Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, events: DataFrame) -> DataFrame:
        """Appends the events that are valid and returns the others with their error."""
        checked = validated(events)
        bad = checked.where("error is not null")
        names = [x.split(" ")[0] for x in LOG.split(", ")]
        have = checked.where("error is null")
        have.select(*[F.col(n) if n in have.columns else F.lit(None).cast(dict(x.split(" ", 1) for x in LOG.split(", "))[n]).alias(n) for n in names]).write.mode("append").partitionBy("event_type").parquet(f"{self.root}/log")
        return bad

    def log(self, *kinds: str) -> DataFrame:
        """The log, of some types only if named (partition pruning)."""
        fs, p = file_system(self.spark, f"{self.root}/log")
        if not fs.exists(p):
            return self.spark.createDataFrame([], LOG)
        every = self.spark.read.schema(LOG).parquet(f"{self.root}/log")
        return every.where(F.col("event_type").isin(*kinds)) if kinds else every

    def _versions(self, name: str) -> list[int]:
        fs, p = file_system(self.spark, f"{self.root}/derived/{name}")
        found = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removeprefix("_version-")) for n in found if n.startswith("_version-"))

    def rewrite(self, name: str, table: DataFrame) -> None:
        """Replaces a derived table; table may read the present one. Of two writers at once the later one raises."""
        version = (self._versions(name) or [0])[-1] + 1
        folder, held = f"{self.root}/derived/{name}", f"{version}-{uuid.uuid4().hex}"
        table.write.parquet(f"{folder}/{held}")
        fs, marker = file_system(self.spark, f"{folder}/_version-{version}")
        out = fs.create(marker, False)
        out.write(bytearray(held.encode()))
        out.close()
        for x in fs.listStatus(file_system(self.spark, folder)[1]):
            n = x.getPath().getName()
            if int(n.removeprefix("_version-").split("-")[0]) < version - 1:
                fs.delete(x.getPath(), True)

    def derived(self, name: str) -> DataFrame:
        folder = f"{self.root}/derived/{name}"
        fs, marker = file_system(self.spark, f"{folder}/_version-{self._versions(name)[-1]}")
        stream = fs.open(marker)
        held = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return self.spark.read.parquet(f"{folder}/{held}")

    def drop_derived(self) -> list[str]:
        """Drops every derived table, as after a change of schema, and names them."""
        fs, p = file_system(self.spark, f"{self.root}/derived")
        names = sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
        fs.delete(p, True)
        return names

    def backup(self, folder: str, now: dt.datetime | None = None) -> str:
        """Copies the log as it is now into a folder named by UTC time; refuses one that is there."""
        name = f"{folder.rstrip('/')}/{(now or dt.datetime.now(dt.timezone.utc)):%Y%m%dT%H%M%SZ}"
        self.log().write.mode("errorifexists").partitionBy("event_type").parquet(name)
        return name


def meter_sink(store: Store):
    """For foreachBatch: appends a micro-batch of model calls to the log, each once by its event id.

    Only the days on which the batch's calls were made are looked at for calls that a replay brings again.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        known = store.log("model_called")
        span = batch.agg(F.min("occurred_at").alias("a"), F.max("occurred_at").alias("b")).first() if "occurred_at" in batch.columns else None
        if span and span["a"]:
            known = known.where(F.col("occurred_at").isNull() | F.col("occurred_at").between(span["a"], span["b"]))
        store.append(batch.join(known.select("event_id"), "event_id", "left_anti").dropDuplicates(["event_id"]))

    return each


#: The development seed: a few concepts in mixed states.
SEED = [
    ("01", "concept_created", {"concept_id": "c1", "canonical_name": "Write-ahead log"}), ("02", "concept_created", {"concept_id": "c2", "canonical_name": "Bloom filter"}),
    ("03", "concept_created", {"concept_id": "c3", "canonical_name": "Service mesh"}), ("04", "encounter_recorded", {"encounter_id": "e1", "concept_id": "c1", "source": "detector", "paraphrase": "a log written first"}),
    ("05", "encounter_recorded", {"encounter_id": "e2", "concept_id": "c2", "source": "manual", "paraphrase": "a set that may err"}), ("06", "encounter_confirmed", {"encounter_id": "e1"}),
    ("07", "encounter_dismissed", {"encounter_id": "e2"}), ("08", "alias_added", {"concept_id": "c1", "alias": "WAL"}), ("09", "session_analysed", {"session_id": "s1", "candidates_found": "2"}),
]


def seed(spark: SparkSession) -> DataFrame:
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + dt.timedelta(minutes=int(i)), k, p) for i, k, p in SEED], "event_id string, occurred_at timestamp, event_type string, payload map<string,string>")
