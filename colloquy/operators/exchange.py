"""Turns to exchanges to chunks.

``next_human`` is a forward as-of join done as one window per session; islands and chunks build on the same session
partitioning, so a session's turns are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Shortest assistant text, chunk budget in characters.
MIN_CHARS = 40
BUDGET = 40_000


def strip(text: Column | str) -> Column:
    """Without white space at the ends (any, not just spaces)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def human_turns(turns: DataFrame) -> DataFrame:
    """What a person typed: user rows that are neither meta nor of a side chain."""
    return turns.where((F.col("role") == "user") & ~F.col("is_meta") & ~F.col("is_sidechain") & F.col("text").isNotNull())


def exchanges(turns: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Each assistant turn with the first human line after it (none: null)."""
    human = (F.col("role") == "user") & ~F.col("is_meta") & ~F.col("is_sidechain") & F.col("text").isNotNull()
    after = Window.partitionBy("session_id").orderBy("line_no").rangeBetween(1, Window.unboundedFollowing)
    reply = F.min(F.when(human, F.struct("line_no", strip("text").alias("text")))).over(after)
    paired = turns.where(F.col("text").isNotNull()).withColumn("_r", reply)
    kept = paired.where((F.col("role") == "assistant") & (F.length(strip("text")) >= min_chars))
    return kept.select("session_id", F.col("line_no").alias("assistant_line"), strip("text").alias("assistant_text"), F.col("_r.line_no").alias("human_line"), F.col("_r.text").alias("human_text"))


def islands(windows: DataFrame) -> DataFrame:
    """Runs of consecutive exchanges with the same reply line (null equals null): island number from 1 a session."""
    order = Window.partitionBy("session_id").orderBy("assistant_line")
    new = (F.row_number().over(order) == 1) | ~F.col("human_line").eqNullSafe(F.lag("human_line").over(order))
    return windows.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def island_sizes(grouped: DataFrame) -> DataFrame:
    """Per island: exchanges, first and last line, and its rendered size (the reply counts once)."""
    return grouped.groupBy("session_id", "island").agg(
        F.count(F.lit(1)).alias("n_windows"), F.min("assistant_line").alias("first_line"), F.max("assistant_line").alias("last_line"), F.max("human_line").alias("human_line"),
        (F.sum(F.length("assistant_text")) + F.coalesce(F.max(F.length("human_text")), F.lit(0))).alias("size"),
    )


def chunks(sizes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Greedy packing in order: a new chunk where a non-empty one would exceed the budget.

    The running sum starts over at every chunk, so it is a fold; only a session's (island, size) pairs are gathered,
    never its text.
    """
    ordered = F.array_sort(F.collect_list(F.struct("island", "size")))
    start = F.struct(F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<island:bigint,chunk:bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        over = (F.size(a["out"]) == 0) | (a["used"] + x["size"] > budget)
        chunk = F.when(over, a["chunk"] + 1).otherwise(a["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(over, x["size"]).otherwise(a["used"] + x["size"]).cast("long").alias("used"), F.concat(a["out"], F.array(F.struct(x["island"].cast("long").alias("island"), chunk.alias("chunk")))).alias("out"))

    packed = sizes.groupBy("session_id").agg(F.aggregate(ordered, start, step, lambda a: a["out"]).alias("p"))
    return packed.select("session_id", F.inline("p"))


def moment_slice(turns: DataFrame, first: int, last: int, most: int = 40) -> DataFrame:
    """User and assistant text of a range of lines, the first rows of each session."""
    rows = turns.where(F.col("line_no").between(first, last) & F.col("role").isin("user", "assistant") & F.col("text").isNotNull())
    order = Window.partitionBy("session_id").orderBy("line_no", "seq")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def clip(text: Column, most: int = 700) -> Column:
    return F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(most))


def transcript_excerpt(turns: DataFrame, first: int, last: int, most: int = 8, chars: int = 700) -> DataFrame:
    """``role: text`` of the first rows of a range, one excerpt a session."""
    rows = turns.where(F.col("line_no").between(first, last) & F.col("text").isNotNull())
    top = rows.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy("line_no", "seq"))).where(F.col("_n") <= most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.concat("role", F.lit(": "), "text").alias("t")))), lambda x: x["t"]), "\n")
    return top.groupBy("session_id").agg(clip(joined, chars).alias("excerpt"), F.count(F.lit(1)).alias("n_rows"))


def session_inventory(turns: DataFrame) -> DataFrame:
    """Conditional counts of one session."""
    human = (F.col("role") == "user") & ~F.col("is_meta") & ~F.col("is_sidechain")
    return turns.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.count_if(human).alias("n_human"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.count_if("is_meta").alias("n_meta"), F.max("line_no").alias("last_line"),
    )


def pending(turns: DataFrame, coverage: DataFrame) -> DataFrame:
    """Sessions a person took part in that were never analysed, or have grown since. coverage: session_id, seen."""
    human = human_turns(turns).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_human"))
    joined = human.join(coverage, "session_id", "left")
    reason = F.when(F.col("seen").isNull(), "never").when(F.col("n_human") > F.col("seen"), "grown")
    return joined.withColumn("reason", reason).where("reason is not null").select("session_id", "n_human", "reason")


def sessions_with_humans(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    return sessions.join(human_turns(turns), "session_id", "left_semi")


def already_done(sessions: DataFrame, coverage: DataFrame) -> DataFrame:
    """Sessions that coverage lacks."""
    return sessions.join(coverage, "session_id", "left_anti")


def recent_sessions(turns: DataFrame, most: int = 20) -> DataFrame:
    """Sessions with a human turn, longest first."""
    last = turns.groupBy("session_id").agg(F.max("line_no").alias("last_line"))
    return sessions_with_humans(last, turns).orderBy(F.desc("last_line"), "session_id").limit(most)


def anchor_sample(windows: DataFrame, wanted: int = 50, min_chars: int = 400) -> DataFrame:
    """Round robin: one long answered exchange of every session before a second of any."""
    able = windows.where((F.length("assistant_text") > min_chars) & F.col("human_line").isNotNull())
    depth = F.row_number().over(Window.partitionBy("session_id").orderBy("assistant_line"))
    return able.withColumn("depth", depth.cast("long")).orderBy("depth", "session_id").limit(wanted).select("session_id", "assistant_line", "human_line", "depth")


def mention_dups(texts: DataFrame, key: str, session: str, order: list[str]) -> DataFrame:
    """Marks rows whose content first occurs in another session.

    The first session of each content is an aggregate with partial sums, so one content may be a third of all rows.
    """
    hashed = texts.withColumn("_h", F.sha2(key, 256))
    first = hashed.groupBy("_h").agg(F.min(F.struct(*order, session))[session].alias("_first"))
    return hashed.join(first, "_h").withColumn("is_dup", F.col("_first") != F.col(session)).drop("_h", "_first")
