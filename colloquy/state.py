"""Where iterative operators put their state: the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where none is set and all run on this machine."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        here = spark.conf.get("spark.checkpoint.dir", None)
        if not here and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(here or f"file://{tempfile.mkdtemp(prefix='colloquy-')}")
    return sc._jsc.sc().getCheckpointDir().get()


def drop(path: str) -> None:
    """Deletes a folder of ours, on whatever file system it is, if the driver still can."""
    with contextlib.suppress(Exception):  # the JVM may be gone first
        jvm = SparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


def new_dir(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder. All of them go when the driver ends."""
    mine = f"{shared_dir(spark)}/state-{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_state_dir", None) != mine:
        spark.sparkContext._state_dir = mine
        atexit.register(drop, mine)
    return f"{mine}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """The same rows read from a table in the shared folder; it goes when the driver ends."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """Adds ``<name>_upto``, the sum of each column over all rows up to this one in a total order.

    Rows are sorted over ranges; each range sums up on its own and adds what the ranges before it hold, one row a range.
    No task ever sees all rows.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "running")
    ranges, before = placed.groupBy("_part").agg(*[F.sum(c).alias(c) for c in sums]), Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranges.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(ahead), "_part")
    return joined.withColumns({f"{c}_upto": F.sum(c).over(own) + F.col(f"_{c}") for c in sums}).drop("_part", *[f"_{c}" for c in sums])


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """Marked for broadcast if it has at most so many rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def quantiles(rows: DataFrame, key: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles of each key, interpolated. wanted: column name -> share.

    Values are counted first and ranked over ranges, so no task holds all values of a key.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(counts, [F.asc("_k"), F.asc("_v")], ["_n"])
    spans = placed.groupBy("_k").agg(F.min(F.col("_n_upto") - F.col("_n")).alias("_start"), F.sum("_n").alias("_all"))
    both = placed.alias("p").join(spans.alias("s"), F.col("p._k").eqNullSafe(F.col("s._k"))).select(F.col("p._k").alias("_k"), "_v", (F.col("_n_upto") - F.col("_start")).alias("_upto"), "_all")
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_v").cast("double")))
    place = {name: share * (F.col("_all") - 1) for name, share in wanted.items()}
    found = both.groupBy("_k", "_all").agg(*[at(f(place[name])).alias(f"_{f.__name__}_{name}") for name in wanted for f in (F.floor, F.ceil)])
    part = lambda name: place[name] - F.floor(place[name])
    return found.select(F.col("_k").alias(key), *[(F.col(f"_floor_{n}") * (1 - part(n)) + F.col(f"_ceil_{n}") * part(n)).alias(n) for n in wanted])
