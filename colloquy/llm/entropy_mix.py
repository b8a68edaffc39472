"""Mixing sources to target weights by entropy balancing.

Among all rates w with sum(w * size) = target in every source and 0 <= w <= 3, the ones of least
sum(w * (log w - 1)) are w = min(3, exp(lambda * size / mean size)), one lambda a source: the minimiser of a convex
dual. Newton steps on it need two sums a source; they are aggregated over (source, size) counts, with a bisection
bracket on the driver against overshooting. Rates become copies by systematic rounding (over documents sorted by
size, in blocks of bounded rows, so a hot source is many tasks), then a few single-document corrections a source
take out what rounding left.

Defined cases: a null source is one source, last in order; a null or empty text has size 0 and no words to take; a
source without words has target 0; repeated rows are rounded on their own (one correction may touch all of them);
an empty table gives an empty result; extra columns are carried along unless they have a name of the result's.
The driver holds a few numbers for each source up to MOST_SOURCES; the state of more (as when every site is a source)
is a table, and each step a join with it. Neither holds anything for each document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from colloquy.llm.common import cut, local_rows, ranked, words
from colloquy.state import running

CAP = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_ROWS = 2000
#: Sources whose state the driver holds, at most.
MOST_SOURCES = 4096
#: Stands for an infinite multiplier: every document at the cap, or none.
HUGE = 1e300


def targets(totals: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> dict[str | None, float]:
    """Words for each source: shares of all words by weight, never above cap times its own, the excess dealt again."""
    ordered = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(ordered)}
    most = {s: float(cap * n) for s, n in ordered}
    out: dict[str | None, float] = {}
    left = float(sum(n for _, n in ordered))
    while len(out) < len(most):
        free = [s for s in most if s not in out]
        unit = left / sum(weight[s] for s in free)
        above = [s for s in free if unit * weight[s] > most[s]]
        for s in above or free:
            out[s] = most[s] if above else unit * weight[s]
            left -= out[s] if above else 0.0
    return out


def tilt(counts: DataFrame, totals: dict, goal: dict, cap: float = CAP, most_steps: int = 60, near: float = 1e-9) -> dict:
    """lambda of each source. counts: source, size, n; totals: source -> (words, documents with words)."""
    spark = counts.sparkSession
    top = math.log(cap)
    state = {s: [0.0, -math.inf, math.inf] for s, (n, _) in totals.items() if n}
    mean = {s: n / k for s, (n, k) in totals.items() if n}
    done = {s: (math.inf if goal[s] >= cap * totals[s][0] * (1 - 1e-12) else -math.inf) for s in state if goal[s] >= cap * totals[s][0] * (1 - 1e-12) or goal[s] <= 0}
    for _ in range(most_steps):
        live = [(s, state[s][0], mean[s]) for s in state if s not in done]
        if not live:
            break
        z = F.col("size") / F.col("mean")
        x = F.least(F.col("lam") * z, F.lit(top))
        mass = F.col("n") * F.col("size") * F.exp(x)
        step = counts.join(local_rows(spark, live, "s string, lam double, mean double"), F.col("source").eqNullSafe(F.col("s")))
        for r in step.groupBy("source").agg(F.sum(mass).alias("g"), F.sum(F.when(x < top, mass * z).otherwise(0.0)).alias("h")).collect():
            s, (lam, lo, hi) = r["source"], state[r["source"]]
            miss = r["g"] - goal[s]
            if abs(miss) <= near * goal[s]:
                done[s] = lam
                continue
            lo, hi = (lo, lam) if miss > 0 else (lam, hi)
            new = lam - miss / r["h"] if r["h"] > 0 else math.nan
            if not lo < new < hi:
                new = (lo + hi) / 2 if math.isfinite(lo) and math.isfinite(hi) else lam + (2.0 if miss < 0 else -2.0) * (1 + abs(lam))
            state[s] = [new, lo, hi]
    return {s: done.get(s, state[s][0]) for s in state}


def target_table(sums: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sums (source, words, k, rows) with target: as ``targets``, for any number of sources.

    Sources in order of cap * words / weight are at their cap up to where the share of those left falls below it.
    """
    placed = ranked(sums, [F.asc_nulls_last("source")], "place")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    rows = placed.withColumn("weight", weight).withColumn("most", F.col("words") * float(cap))
    upto = cut(running(rows, [F.asc(F.col("most") / F.col("weight")), F.asc("place")], ["most", "weight"]), "upto")
    total, all_weights = upto.agg(F.sum("words"), F.sum("weight")).first()
    unit = (F.lit(float(total)) - (F.col("most_upto") - F.col("most"))) / (F.lit(all_weights) - (F.col("weight_upto") - F.col("weight")))
    marked = cut(upto.withColumn("capped", unit * F.col("weight") > F.col("most")), "capped")
    held, free = marked.agg(F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)), F.sum(F.when(~F.col("capped"), F.col("weight")))).first()
    share = (total - held) / free if free else 0.0
    return marked.select("source", "words", "k", "rows", F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * share).alias("target"))


def tilt_table(counts: DataFrame, goals: DataFrame, cap: float = CAP, most_steps: int = 60, near: float = 1e-9) -> DataFrame:
    """goals (source, words, k, rows, target) with lam: as ``tilt``, for any number of sources."""
    top, inf = math.log(cap), F.lit(math.inf)
    mean = F.col("words") / F.when(F.col("k") > 0, F.col("k"))
    at_cap, at_none = F.col("target") >= cap * F.col("words") * (1 - 1e-12), F.col("target") <= 0
    fixed = F.when(F.col("words") == 0, 0.0).when(at_cap, HUGE).when(at_none, -HUGE)
    state = cut(goals.select("*", F.coalesce(mean, F.lit(1.0)).alias("mean"), F.coalesce(fixed, F.lit(0.0)).alias("lam"), (-inf).alias("lo"), inf.alias("hi"), fixed.isNotNull().alias("done")), "tilt")
    for _ in range(most_steps):
        if state.where("not done").isEmpty():
            break
        live = state.where("not done").select(F.col("source").alias("s"), F.col("lam").alias("l"), F.col("mean").alias("m"))
        z = F.col("size") / F.col("m")
        x = F.least(F.col("l") * z, F.lit(top))
        mass = F.col("n") * F.col("size") * F.exp(x)
        step = counts.join(live, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(F.sum(mass).alias("g"), F.sum(F.when(x < top, mass * z).otherwise(0.0)).alias("h"))
        miss = F.col("g") - F.col("target")
        met = F.col("done") | (F.abs(miss) <= near * F.col("target"))
        lo, hi = F.when(miss > 0, F.col("lo")).otherwise(F.col("lam")), F.when(miss > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.when(F.col("h") > 0, F.col("lam") - miss / F.col("h"))
        away = F.col("lam") + F.when(miss < 0, 2.0).otherwise(-2.0) * (1 + F.abs("lam"))
        new = F.when((newton > lo) & (newton < hi), newton).when((lo > -inf) & (hi < inf), (lo + hi) / 2).otherwise(away)
        moved = state.join(step, F.col("source").eqNullSafe(F.col("s")), "left")
        state = cut(moved.select("source", "words", "k", "rows", "target", "mean", F.when(met, F.col("lam")).otherwise(new).alias("lam"), F.when(met, F.col("lo")).otherwise(lo).alias("lo"), F.when(met, F.col("hi")).otherwise(hi).alias("hi"), met.alias("done")), "tilt")
    return state


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, seed: int = 7, corrections: int = 4, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every document with size, source_size, target, rate, copies and taken (copies * size)."""
    spark = docs.sparkSession
    own = ("size", "source_size", "target", "rate", "copies", "taken")
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_h"), F.size(words(text_col)).cast("long").alias("size"))
    sized = cut(sized.withColumn("_n", F.monotonically_increasing_id()), "sizes")  # _n tells equal rows apart, from here on
    counts = cut(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    sums = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum("n").alias("rows"))
    few = counts.select("source").distinct().limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    if few:
        held = sums.collect()
        goal = targets([(r["source"], r["words"]) for r in held], weights, cap)
        lam = tilt(counts, {r["source"]: (r["words"], r["k"]) for r in held}, goal, cap)
        per = [(r["source"], r["words"], goal[r["source"]], max(-HUGE, min(HUGE, lam.get(r["source"], 0.0))), r["words"] / r["k"] if r["k"] else 1.0, r["rows"] // BLOCK_ROWS + 1) for r in held]
        known = local_rows(spark, per, "s string, source_size long, target double, lam double, mean double, blocks long")
    else:
        state = tilt_table(counts, target_table(cut(sums, "sums"), weights, cap), cap)
        known = state.select(F.col("source").alias("s"), F.col("words").alias("source_size"), "target", "lam", "mean", F.expr(f"rows div {BLOCK_ROWS} + 1").alias("blocks"))

    same = F.col("source").eqNullSafe(F.col("s"))
    rate = F.when(F.col("size") == 0, 0.0).otherwise(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(math.log(cap)))))
    rate = F.when(F.col("lam") == HUGE, F.lit(float(cap))).when(F.col("lam") == -HUGE, 0.0).otherwise(rate)
    rated = sized.join(known, same).withColumn("rate", F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate))
    over = Window.partitionBy("source", F.pmod("_h", "blocks")).orderBy(F.desc("size"), "_h", "_id", "_n").rowsBetween(Window.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64(F.lit(seed), "source", F.pmod("_h", "blocks")), F.lit(1 << 20)) / F.lit(1 << 20)
    part = F.col("rate") - F.floor("rate")
    sofar = F.sum(part).over(over) + start
    rounded = rated.withColumn("_c", sofar).withColumn("_p", part).select("_id", "_h", "_n", "source", "size", "source_size", "target", "rate", (F.floor("rate") + F.floor("_c") - F.floor(F.col("_c") - F.col("_p") + 1e-12)).alias("copies"))
    rounded = rounded.withColumn("copies", F.greatest(F.lit(0), F.least(F.lit(cap), F.col("copies"))).cast("long"))
    held = cut(rounded, "copies")

    for _ in range(corrections):
        now = held.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap")).where("abs(gap) >= 1").select(F.col("source").alias("s"), "gap")
        left = local_rows(spark, [tuple(r) for r in now.collect()], "s string, gap double") if few else now
        able = (F.col("size") > 0) & (F.col("size") < 2 * F.abs("gap")) & F.when(F.col("gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
        best = held.join(left, same).where(able).groupBy("source").agg(F.min(F.struct(F.abs(F.abs("gap") - F.col("size")).alias("miss"), "_h", "_id", "_n", F.signum("gap").cast("long").alias("step"))).alias("b"))
        best = best.select(F.col("source").alias("s"), F.col("b._n").alias("pn"), F.col("b.step").alias("step"))
        picked = local_rows(spark, [tuple(r) for r in best.collect()], "s string, pn long, step long") if few else cut(best, "picked")
        if picked.isEmpty():
            break
        held = held.join(picked, same & (F.col("_n") == F.col("pn")), "left").withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0))).drop("s", "pn", "step")
        held = held if few else cut(held, "copies")
    out = held.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(F.col("_id").alias(id_col), F.col("source").alias(source_col), "_h", *own)


def mixed_documents(docs: DataFrame, seed: int = 7, **settings) -> DataFrame:
    """The documents as the mix has them: each as many times as its copies, with the columns of the input.

    Rows equal in id, text and source share what the mix gave them: each takes the same number of copies, and as many
    of them as are left over take one more. Only rows of groups with such a rest are numbered, part by part, so a group
    of any size is many tasks.
    """
    id_col, text_col, source_col = (settings.get(f"{x}_col", d) for x, d in (("id", "doc_id"), ("text", "text"), ("source", "source")))
    plan = mix(docs, seed=seed, **settings).groupBy("_h", F.col(source_col).alias("_source")).agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows"))
    shares = plan.where("_all > 0").select("_h", "_source", F.expr("_all div _rows").cast("int").alias("_copies"), (F.col("_all") % F.col("_rows")).alias("_rest"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"), F.col(source_col).alias("s"), row.alias("_row"))
    met = keyed.join(shares, (F.col("h") == F.col("_h")) & F.col("s").eqNullSafe(F.col("_source"))).select("_h", "_source", "_row", "_copies", "_rest")
    even, rest = met.where("_rest = 0"), met.where("_rest > 0")
    if not shares.where("_rest > 0").isEmpty():
        placed = cut(rest.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "rest")
        group = ["_h", "_source"]
        held = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
        ahead = held.select(*group, "_part", (F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")).alias("_ahead"))  # a row a part
        own = F.row_number().over(Window.partitionBy(*group, "_part").orderBy("_at"))
        p, q = placed.withColumn("_own", own).alias("p"), ahead.alias("q")
        joined = p.join(q, (F.col("p._h") == F.col("q._h")) & F.col("p._source").eqNullSafe(F.col("q._source")) & (F.col("p._part") == F.col("q._part")))
        more = F.col("_copies") + (F.col("_own") + F.col("_ahead") <= F.col("_rest")).cast("int")
        even = even.select("_row", "_copies").union(joined.select("_row", more.alias("_copies")).where("_copies > 0"))
    return even.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_row.*")


def op7(spark, sf_dir: str) -> DataFrame:
    from colloquy.llm.common import read

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")
