"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import json
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What separates words (space, tab, line feed, vertical tab, form feed, return).
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table, by whatever file system its path names."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column | str) -> Column:
    """The words of a text (runs of what is not white space); none for a null text."""
    return F.array_remove(F.split(text_of(text), SPACE), "")


def lower_ascii(text: Column | str) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text_of(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session; one of our own only where none is set and all run on this machine."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        here = spark.conf.get("spark.checkpoint.dir", None)
        if not here and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(here or f"file://{tempfile.mkdtemp(prefix='colloquy-')}")
    return sc._jsc.sc().getCheckpointDir().get()


def new_dir(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder. All of them go when the driver ends."""
    mine = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_llm_dir", None) != mine:
        spark.sparkContext._llm_dir = mine
        atexit.register(drop, mine)
    return f"{mine}/{name}-{uuid.uuid4().hex}"


#: Rows of a small table that go to one file.
FILE_ROWS = 20_000


def cut(df: DataFrame, name: str, compression: str | None = None, rows: int | None = None) -> DataFrame:
    """The same rows read from a table in the shared folder: lineage ends there and a lost executor costs nothing.

    rows: about how many there are; a table of few is written by as few tasks as they need.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    made = df if rows is None else df.coalesce(max(1, min(rows // FILE_ROWS + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    made.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop(path: str) -> None:
    """Deletes a folder of ours, on whatever file system it is, if the driver still can."""
    with contextlib.suppress(Exception):  # the JVM may be gone first
        jvm = SparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table made by SQL functions, so that no Python worker has to bring them."""
    names = [x.split(" ")[0] for x in schema.split(", ")]
    held = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    fields = ",".join(f"{x.split(' ', 1)[0]}:{x.split(' ', 1)[1]}" for x in schema.split(", "))
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(held), f"array<struct<{fields}>>")))


def parts(df: DataFrame, mb: int = 16) -> int:
    """Partitions of about so many MB each by the optimiser's size of the input; at least the session's shuffle partitions.

    Beyond 100,000 partitions they grow instead; an input whose size the optimiser cannot tell gets the session's.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return session if size >= 1 << 60 else max(session, min(size // (mb << 20) + 1, 100_000))


def ranked(keys: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """Adds the 0-based rank of each row under a total order, without one task ever holding all rows.

    Rows are sorted over ranges; each row's place in its range comes with its range's number, and only one
    count a range (at most as many as shuffle partitions) is summed up ahead of it.
    """
    spark = keys.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    placed = cut(keys.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", at), rank)
    placed = placed.withColumn("_part", F.shiftright("_at", 33).cast("int"))
    before, offsets = 0, []
    for row in placed.groupBy("_part").count().orderBy("_part").collect():
        offsets.append((row["_part"], before))
        before += row["count"]
    ahead = local_rows(spark, offsets or [(0, 0)], "_part int, _before long")
    return placed.join(F.broadcast(ahead), "_part").withColumn(rank, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")
