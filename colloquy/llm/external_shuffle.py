"""Two-pass external shuffle into shards.

Pass one scatters rows uniformly into memory-sized buckets by a seeded hash of the whole (id, text) key; pass two
shuffles each bucket (Spark's seeded ``shuffle`` is a Fisher-Yates) and writes it. Buckets follow one another, so
their counts give every row its place in the whole order, and equal ranges of that order are the shards: counts of
shards are at most one apart (law ``rows``) and slots have no gap. The text is shuffled once.

The number of buckets follows the input's bytes without a bound; counts are summed up within spans of buckets first,
so neither a task nor the driver holds one number a bucket. A row with more copies than a fair share of a bucket is
counted first and its copies are dealt out again by their number, so that they scatter like different rows.

Defined cases: null ids and texts are kept and scattered like any value; repeated rows are kept each (up to
MOST_COPIES of one (id, text) share a bucket); with fewer rows than shards some shards are empty; an empty table gives
an empty result; input columns named shard or slot give way to those of the shuffle, any other column is carried along.
The result depends on the rows alone, not on their order or partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.llm.common import new_dir, text_of

BUCKET_BYTES = 4 << 20
#: Copies of one (id, text) that may share a bucket; and rows that one task makes of a repeated row.
MOST_COPIES, DEALT = 64, 10_000
#: Buckets whose counts are summed up in one task; and partitions at most, each of several buckets then.
SPAN, MOST_PARTS = 4096, 100_000
#: Rows of a helper table up to which it is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def size_of(text: str = "text") -> Column:
    return F.octet_length(text_of(text)).cast("long") + 16


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def scattered(docs: DataFrame, seed: int, id_col: str, text_col: str) -> DataFrame:
    """The rows with _key, a seeded hash by which they scatter; copies of a much repeated row have different ones."""
    keyed = docs.withColumn("_key", F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)))
    copies = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MOST_COPIES).select("_key")
    many = copies.count()
    if not many:
        return keyed
    copies = _small(copies, many)
    hot = keyed.join(copies, "_key", "left_semi")
    counted = hot.groupBy(*[F.col(f"`{c}`") for c in hot.columns]).agg(F.count(F.lit(1)).alias("_n"))
    parts = counted.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / DEALT))))
    parts = parts.repartition("_key", "_part")
    dealt = parts.withColumn("_copy", F.explode(F.sequence(F.col("_part") * DEALT, F.least(F.col("_part") * DEALT + (DEALT - 1), F.col("_n") - 1))))
    dealt = dealt.withColumn("_key", F.xxhash64(F.lit(seed), "_key", "_copy")).select(*keyed.columns)
    return keyed.join(copies, "_key", "left_anti").unionByName(dealt)


def external_shuffle(docs: DataFrame, path: str, shards: int = 40, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards under path (a folder each, Parquet) and returns what is read back, with shard and slot."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot", "_key", "_bucket", "_n", "_part", "_copy")
    keyed = scattered(docs, seed, id_col, text_col)
    total, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(size_of(text_col)), F.lit(0))).first()
    buckets = size // bucket_bytes + 1
    keyed = keyed.withColumn("_bucket", F.pmod("_key", F.lit(buckets)))

    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("span", F.expr(f"_bucket div {SPAN}"))
    spans = counts.groupBy("span").agg(F.sum("n").alias("all"))
    before = spans.select("span", (F.sum("all").over(Window.orderBy("span")) - F.col("all")).alias("before"))  # a row for every 16 GB
    within = F.sum("n").over(Window.partitionBy("span").orderBy("_bucket")) - F.col("n")
    ahead = counts.withColumn("_within", within).join(F.broadcast(before), "span").select("_bucket", (F.col("before") + F.col("_within")).alias("_ahead"))

    row = F.struct("_key", *[F.col(f"`{c}`") for c in docs.columns])
    held = keyed.repartition(int(min(buckets, MOST_PARTS)), "_bucket").groupBy("_bucket").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    mixed = held.sortWithinPartitions("_bucket").select("_bucket", F.shuffle("_rows", seed).alias("_rows"))  # one stream of random numbers a partition
    placed = mixed.join(_small(ahead, buckets), "_bucket").select("_ahead", F.posexplode("_rows").alias("_pos", "_row"))
    shard = F.floor((F.col("_ahead") + F.col("_pos")) * F.lit(shards) / F.lit(max(total, 1))) if total * shards < 1 << 50 else F.expr(f"cast((_ahead + _pos) as decimal(38)) * {shards} div {total}")
    first = F.ceil(F.col("shard") * F.lit(total) / F.lit(shards)) if total * shards < 1 << 50 else F.expr(f"(cast(shard as decimal(38)) * {total} + {shards - 1}) div {shards}")
    out = placed.select("_row.*", shard.cast("int").alias("shard"), (F.col("_ahead") + F.col("_pos")).alias("_at")).withColumn("slot", (F.col("_at") - first).cast("long")).drop("_at", "_key")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def op8(spark, sf_dir: str) -> DataFrame:
    from colloquy.llm.common import read

    held = external_shuffle(read(spark, sf_dir, "documents"), new_dir(spark, "shards"))
    return held.select("doc_id", size_of().alias("size"), F.crc32(text_of("text")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
