"""The spend ledger: totals, breakdowns, per-session averages and estimates.

A call is local, else unpriced if its cost is null, else priced. Null is never zero: sums over no priced call are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.state import quantiles

#: Purposes that count towards what a session costs.
ANALYSIS = ("click", "purchase", "view")


def totals() -> list[Column]:
    """The mergeable totals of a group of calls."""
    priced = ~F.col("local") & F.col("cost").isNotNull()
    return [
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.coalesce("ok", F.lit(True))).alias("failed"), F.count_if("local").alias("local_calls"), F.count_if(priced).alias("priced"),
        F.count_if(~F.col("local") & F.col("cost").isNull()).alias("unpriced"), F.sum(F.when(priced, F.col("cost"))).alias("cost"), F.sum("tokens").alias("tokens"),
    ]


def spend(calls: DataFrame, by: list[Column] | None = None, since: str | None = None, until: str | None = None, order: str | None = None) -> DataFrame:
    """Totals of each group. order: a column in whose order the costs of a group are added up, one after the other.

    A sum of doubles depends on the order in its last digits, which shows where it is cut to whole units afterwards.
    """
    kept = calls
    if since:
        kept = kept.where(F.col("occurred_at") >= F.lit(since).cast("timestamp"))
    if until:
        kept = kept.where(F.col("occurred_at") < F.lit(until).cast("timestamp"))
    cells = totals()
    if by and order:
        line = Window.partitionBy(*by).orderBy(order, "cost").rowsBetween(Window.unboundedPreceding, 0)
        kept = kept.withColumn("_upto", F.sum(F.when(~F.col("local"), F.col("cost"))).over(line))
        cells[5] = F.max_by("_upto", F.struct(order, "cost")).alias("cost")
    return (kept.groupBy(*by) if by else kept.groupBy()).agg(*cells)


def per_session(calls: DataFrame) -> DataFrame:
    """By model: sessions, mean cost of one, and whether any of its calls was local (those count as 0)."""
    used = calls.where(F.col("purpose").isin(*ANALYSIS) & F.col("session_id").isNotNull() & (F.col("local") | F.col("cost").isNotNull()))
    one = used.groupBy("model", "session_id").agg(F.sum(F.when(F.col("local"), 0.0).otherwise(F.col("cost"))).alias("c"), F.bool_or("local").alias("l"))
    return one.groupBy("model").agg(F.count(F.lit(1)).alias("sessions"), F.avg("c").alias("per_session"), F.bool_or("l").alias("any_local"))


def estimate(calls: DataFrame, n: int, recent: int = 20) -> DataFrame:
    """By model: mean cost of its most recently active sessions, times n."""
    used = calls.where(F.col("purpose").isin(*ANALYSIS) & F.col("session_id").isNotNull() & ~F.col("local") & F.col("cost").isNotNull())
    one = used.groupBy("model", "session_id").agg(F.sum("cost").alias("c"), F.max("call_id").alias("last"))
    top = one.withColumn("_n", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("last")))).where(F.col("_n") <= recent)
    return top.groupBy("model").agg(F.count(F.lit(1)).alias("sampled"), (F.avg("c") * n).alias("estimate"))


def stage_cost(calls: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """A row for each stage, also one without calls: calls, failed, cost, unpriced and the exact median duration."""
    spark = calls.sparkSession
    fixed = spark.range(1).select(F.posexplode(F.array(*map(F.lit, stages))).alias("stage_no", "purpose"))
    found = calls.groupBy("purpose").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.sum(F.when(~F.col("local"), F.col("cost"))).alias("cost"),
        F.count_if(~F.col("local") & F.col("cost").isNull()).alias("unpriced"), F.median("duration_ms").alias("median_ms"),
    )
    joined = fixed.join(found, "purpose", "left")
    return joined.select(F.col("stage_no").cast("long").alias("stage_no"), "purpose", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("calls", "failed", "unpriced")), "cost", "median_ms")


def latency(calls: DataFrame) -> DataFrame:
    """Per purpose: failure rate, quantiles (exact, interpolated) and token sums."""
    found = calls.groupBy("purpose").agg(F.count(F.lit(1)).alias("calls"), F.avg((~F.col("ok")).cast("double")).alias("fail_rate"), F.max("duration_ms").alias("longest"), F.sum("tokens").alias("tokens"))
    return found.join(quantiles(calls, "purpose", "duration_ms", {"p50": 0.5, "p90": 0.9}), "purpose", "left").select("purpose", "calls", "fail_rate", "p50", "p90", "longest", "tokens")


def session_spend(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.sum(F.when(~F.col("local"), F.col("cost"))).alias("cost"), F.count(F.when(~F.col("local"), F.col("cost"))).alias("priced"), F.sum("duration_ms").alias("ms"))


def money(amount: Column) -> Column:
    """Half-even like the ledger's own printing: not reported, $0, <$0.0001, four places under a cent, else two."""
    return F.when(amount.isNull(), "not reported").when(amount == 0, "$0").when(amount < 0.0001, "<$0.0001").when(amount < 0.01, F.format_string("$%.4f", F.bround(amount, 4))).otherwise(F.format_string("$%.2f", F.bround(amount, 2)))


def total_text(cost: Column, unpriced: Column, priced: Column, local: Column) -> Column:
    text = F.when((priced == 0) & (unpriced == 0) & (local > 0), "local").when(priced == 0, "not reported").otherwise(money(cost))
    return F.when((unpriced > 0) & (priced > 0), F.concat(text, F.lit(" + "), unpriced.cast("string"), F.lit(" unpriced"))).otherwise(text)


def ratio_text(part: Column, whole: Column) -> Column:
    """``p of w (r%)``, with a warning under five; a whole of 0 has no rate."""
    text = F.when(whole == 0, F.format_string("%d of %d", part, whole)).otherwise(F.format_string("%d of %d (%d%%)", part, whole, F.floor(100 * part / whole + 0.5).cast("long")))
    return F.when((whole > 0) & (whole < 5), F.concat(text, F.lit(" - too few to mean much"))).otherwise(text)


def cost_ceiling(jobs: DataFrame, per_in: float, per_out: float) -> DataFrame:
    """Upper bound of a batch: characters / 4 in, the token limit out."""
    return jobs.agg(F.sum((F.col("prompt_chars") / 4 * per_in + F.col("max_tokens") * per_out) * F.col("repeats")).alias("ceiling"))


def running_totals(passes: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return passes.withColumn("so_far", F.sum(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
