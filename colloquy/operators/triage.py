"""Ranking and triage of candidates: coerce, dedupe, rank, budgets, the calibrated cut and spot checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.state import running

# Fixed values of the rules.
SIGNALS = {"accepted": 0, "unclear": 1}
IMPORTANCE = {"central": 0, "supporting": 1}
GAP_BUDGET, SPOT_EVERY, MIN_SIDE, DEFAULT_SIDE, TARGET = 2, 5, 3, 8, 0.9


def order_of(value: Column, ranks: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in ranks.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def coerce(proposed: DataFrame, anchors: DataFrame) -> DataFrame:
    """Proposals that stand: anchored to an exchange, with term and paraphrase, a known signal that is not questioned.

    proposed: session_id, chunk, pos, term, paraphrase, assistant_line, signal, importance; anchors: session_id, assistant_line.
    """
    kept = proposed.join(anchors.select("session_id", "assistant_line").distinct(), ["session_id", "assistant_line"], "left_semi")
    kept = kept.where((F.trim(F.coalesce("term", F.lit(""))) != "") & (F.trim(F.coalesce("paraphrase", F.lit(""))) != "") & F.col("signal").isin(*SIGNALS))
    return kept.withColumn("importance", F.when(F.col("importance").isin(*IMPORTANCE), F.col("importance")).otherwise("supporting"))


def first_wins(candidates: DataFrame) -> DataFrame:
    """The first spelling of each term of a session, by chunk and place in it."""
    key = F.lower(F.trim("term"))
    w = Window.partitionBy("session_id", key).orderBy("chunk", "pos")
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rank(candidates: DataFrame) -> DataFrame:
    """rank within a session: signal, importance, line, term."""
    w = Window.partitionBy("session_id").orderBy(order_of(F.col("signal"), SIGNALS, 9), order_of(F.col("importance"), IMPORTANCE, 1), "assistant_line", F.lower("term"))
    return candidates.withColumn("rank", F.row_number().over(w).cast("long"))


def gap_budget(ranked: DataFrame, most: int = GAP_BUDGET) -> DataFrame:
    """The first accepted candidates of each session."""
    gaps = ranked.where("signal = 'accepted'")
    return gaps.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy("rank"))).where(F.col("_n") <= most).drop("_n")


def calibrate(entries: DataFrame, target: float = TARGET, keys: tuple[str, ...] = ()) -> DataFrame:
    """The lowest score at which holding back everything from it up is right often enough. entries: score, known (0/1).

    Counts by distinct score come first, so the running sums see one row a score and group, never the entries.
    """
    by = entries.groupBy(*keys, "score").agg(F.sum("known").alias("k"), F.count(F.lit(1)).alias("n"))
    if keys:
        up = Window.partitionBy(*keys).orderBy(F.desc("score"))
        summed = by.withColumns({"k_upto": F.sum("k").over(up), "n_upto": F.sum("n").over(up)})
    else:
        summed = running(by, [F.desc("score")], ["k", "n"])
    cut = summed.withColumn("precision", F.col("k_upto") / F.col("n_upto")).where(F.col("precision") >= target)
    return cut.groupBy(*keys).agg(F.min("score").alias("cut"), F.min_by("precision", "score").alias("precision"))


def cut_rule(entries: DataFrame, spot_answered: int = 0, spot_known: int = 0, target: float = TARGET) -> DataFrame:
    """One row: cut (null: hold nothing back) and where it comes from."""
    sides = entries.agg(F.sum("known").alias("known"), F.sum(1 - F.col("known")).alias("unknown"))
    both = sides.join(calibrate(entries, target), how="left")  # one row each
    least = F.least("known", "unknown")
    source = F.when(F.lit(spot_answered >= 10 and spot_known < 0.9 * spot_answered), "spot checks").when(least < MIN_SIDE, "no map").when(least < DEFAULT_SIDE, "default").when(F.col("cut").isNull(), "unreliable").otherwise("map")
    return both.select("known", "unknown", F.when(source == "default", 0.5).when(source == "map", F.col("cut")).alias("cut"), source.alias("source"))


def triage(judged: DataFrame, cut: float, most: int = GAP_BUDGET) -> DataFrame:
    """passed, held or spot_check for every ranked gap, and whether it is emitted. judged: session_id, rank, term, p."""
    from colloquy.functions.names import spot_hash

    held = F.coalesce(F.col("p") >= cut, F.lit(False))  # a judge that failed lets the candidate pass
    marked = judged.withColumn("_held", held).withColumn("_able", held & spot_hash(F.concat_ws(":", F.col("session_id").cast("string"), F.lower("term")), SPOT_EVERY))
    first = F.row_number().over(Window.partitionBy("session_id", "_able").orderBy("rank")) == 1
    verdict = marked.withColumn("verdict", F.when(F.col("_able") & first, "spot_check").when(F.col("_held"), "held").otherwise("passed"))
    n = F.row_number().over(Window.partitionBy("session_id", "verdict").orderBy("rank"))
    emitted = verdict.withColumn("emitted", (F.col("verdict") == "spot_check") | ((F.col("verdict") == "passed") & (n <= most)))
    return emitted.drop("_held", "_able")


def bands(records: DataFrame, edges: tuple[float, ...] = (0.0, 0.1, 0.3, 1.01)) -> DataFrame:
    """Per band of p: passed and answered records, dismissed ones. records: p, answered, dismissed."""
    band = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        band = F.when((F.col("p") >= edges[k]) & (F.col("p") < edges[k + 1]), k).otherwise(band)
    return records.where("answered").withColumn("band", band).where("band is not null").groupBy("band").agg(F.count(F.lit(1)).alias("answered"), F.count_if("dismissed").alias("dismissed"))


def knowledge_map(concepts: DataFrame, most: int = 40) -> DataFrame:
    """The newest concepts of each side: known, or met and confirmed. concepts: key, state, judgment, last_seen."""
    side = F.when(F.col("state") == "known", "known").when(F.col("judgment") == "confirmed", "unknown")
    w = Window.partitionBy("side").orderBy(F.desc("last_seen"), "key")
    return concepts.withColumn("side", side).where("side is not null").withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most)
