"""Evaluation kernels: rank AUC, thresholds, agreement, confusion, quantiles, nearest-neighbour votes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.shipping import ship
from colloquy.state import cut, running


def auc(scored: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Area under the curve with half credit for ties, from counts by distinct score. scored: score, label (0/1)."""
    by = scored.groupBy(*keys, "score").agg(F.sum("label").cast("double").alias("p"), F.sum(1 - F.col("label")).cast("double").alias("n"))
    if keys:
        part = by.withColumn("_below", F.sum("n").over(Window.partitionBy(*keys).orderBy("score")) - F.col("n"))
    else:
        part = running(by, [F.asc("score")], ["n"]).withColumn("_below", F.col("n_upto") - F.col("n"))
    return part.groupBy(*keys).agg(F.try_divide(F.sum(F.col("p") * (F.col("_below") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))


def best_threshold(scored: DataFrame) -> DataFrame:
    """The cut (score >= cut is positive) of the highest accuracy, the lowest such; over counts by distinct score."""
    by = scored.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    down = running(by, [F.desc("score")], ["p", "n"])
    gained = down.withColumn("gain", F.col("p_upto") - F.col("n_upto"))  # right answers, less all negatives
    best = gained.agg(F.min_by("score", F.struct(-F.col("gain"), "score")).alias("cut"), F.max("gain").alias("gain"), F.sum("n").alias("n"), F.sum("p").alias("p"))
    return best.select("cut", ((F.col("gain") + F.col("n")) / (F.col("p") + F.col("n"))).alias("accuracy"))


def confusion(rows: DataFrame, truth: str, found: str) -> DataFrame:
    return rows.groupBy(truth, found).agg(F.count(F.lit(1)).alias("n"))


def confusion_pivot(rows: DataFrame, truth: str, found: str, levels: list) -> DataFrame:
    """One row a truth, the share of each found level, and the row's accuracy."""
    n = F.count(F.lit(1))
    return rows.groupBy(truth).agg(*[(F.count_if(F.col(found) == v) / n).alias(f"share_{v}") for v in levels], F.avg((F.col(found) == F.col(truth)).cast("double")).alias("accuracy"))


def jaccard_stability(runs: DataFrame, unit: str = "unit", run: str = "run", item: str = "item") -> DataFrame:
    """Mean pairwise Jaccard of a unit's runs; two empty sets agree. runs: unit, run, item (null: an empty run).

    Sizes and overlaps are counted by joins on (unit, item), so no set is held in one row.
    """
    sizes = runs.groupBy(unit, run).agg(F.countDistinct(item).alias("size"))
    one = runs.where(F.col(item).isNotNull()).select(unit, run, item).distinct()
    a, b = one.select(unit, F.col(run).alias("r1"), item), one.select(unit, F.col(run).alias("r2"), item)
    shared = a.join(b, [unit, item]).where("r1 < r2").groupBy(unit, "r1", "r2").agg(F.count(F.lit(1)).alias("both"))
    pairs = sizes.select(unit, F.col(run).alias("r1"), F.col("size").alias("s1")).join(sizes.select(unit, F.col(run).alias("r2"), F.col("size").alias("s2")), unit).where("r1 < r2")
    joined = pairs.join(shared, [unit, "r1", "r2"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    value = F.when(F.col("s1") + F.col("s2") == 0, 1.0).otherwise(F.col("both") / (F.col("s1") + F.col("s2") - F.col("both")))
    return joined.groupBy(unit).agg(F.avg(value).alias("jaccard"))


def majority(votes: DataFrame, key: str, vote: str, order: str) -> DataFrame:
    """The most frequent non-null vote, the one seen first among equals."""
    by = votes.where(F.col(vote).isNotNull()).groupBy(key, vote).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return by.groupBy(key).agg(F.max_by(vote, F.struct("n", -F.col("first"))).alias("majority"), F.max("n").alias("votes"))


def unanimity(votes: DataFrame, key: str, vote: str, repeats: int) -> DataFrame:
    return votes.groupBy(key).agg(((F.countDistinct(vote) == 1) & (F.count(vote) == F.count(F.lit(1))) & (F.count(F.lit(1)) >= repeats)).alias("unanimous"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    return F.get(F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))), F.lit(0))


#: Points and queries of a block, about, and queries that are compared at once.
BLOCK_POINTS, BLOCK_QUERIES, AT_ONCE = 20_000, 10_000, 256
#: What the order of a sum can change in a product of unit vectors.
DOT_SLACK = 1e-9


def nearest(query_ids: np.ndarray, qs: np.ndarray, ids: np.ndarray, ps: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's place, its k nearest other points (places; lower id among equals) and their products.

    A matrix product leaves whatever could be among the k; that is summed up again from left to right, as ``dot`` does,
    so equal vectors have equal products wherever they lie.
    """
    for start in range(0, len(qs), AT_ONCE):
        rough = qs[start : start + AT_ONCE] @ ps.T
        rough[query_ids[start : start + AT_ONCE, None] == ids[None, :]] = -np.inf
        for row, sims in enumerate(rough, start):
            least = np.partition(sims, len(sims) - k)[len(sims) - k] if len(sims) > k else -np.inf
            near = np.flatnonzero((sims >= least - DOT_SLACK) & (sims > -np.inf))
            exact = np.zeros(len(near))
            for x, column in zip(qs[row], ps[near].T, strict=True):
                exact += x * column
            best = np.lexsort((ids[near], -exact))[:k]
            yield row, near[best], exact[best]


def knn_vote(queries: DataFrame, points: DataFrame, k: int = 7, tau: float = 0.05) -> DataFrame:
    """Softmax-weighted vote of the nearest other points by cosine. Both: vec_id, embedding, label (0/1 as vote).

    A stated query set against all points: both are cut into blocks by hash, a task holds one block of either and keeps
    the k best of each query, and those partial lists (k a block of points) meet in one small ranking.
    """
    ship(points.sparkSession)
    blocks, parts = max(16, points.count() // BLOCK_POINTS + 1), queries.count() // BLOCK_QUERIES + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    q = queries.select(F.col("vec_id").alias("query_id"), unit(F.col("embedding")).alias("qv"), F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(parts)).cast("int").alias("part")).where("qv is not null").withColumn("block", every(blocks))
    p = points.select("vec_id", F.col("label").cast("double").alias("label"), unit(F.col("embedding")).alias("pv"), at(blocks).alias("block")).where("pv is not null").withColumn("part", every(parts))

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        columns, out = ["query_id", "block", "vec_id", "label", "sim"], []
        if len(asked) and len(held):
            ids, labels = held["vec_id"].to_numpy(), held["label"].to_numpy()
            of, block = asked["query_id"].to_numpy(), int(held["block"].iloc[0])
            for row, near, sims in nearest(of, np.stack(asked["qv"].to_numpy()), ids, np.stack(held["pv"].to_numpy()), k):
                out += zip([of[row]] * len(near), [block] * len(near), ids[near], labels[near], sims, strict=True)
        return pd.DataFrame(out, columns=columns)

    id_type = dict(points.dtypes)["vec_id"]
    scored = q.groupBy("block", "part").cogroup(p.groupBy("block", "part")).applyInPandas(run, f"query_id {id_type}, block int, vec_id {id_type}, label double, sim double")
    near = cut(scored.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id"))).where(F.col("_n") <= k).drop("_n"), "near")
    top = near.groupBy("query_id").agg(F.max("sim").alias("top"))
    w = F.exp((F.col("sim") - F.col("top")) / tau)
    return near.join(top, "query_id").groupBy("query_id").agg((F.sum(w * F.col("label")) / F.sum(w)).alias("vote"), F.count(F.lit(1)).alias("neighbours"))


def mean_sd(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and sample deviation without NaN; a single value has no deviation."""
    good = F.when(~F.isnan(value), F.col(value))
    return rows.groupBy(key).agg(F.avg(good).alias("mean"), F.when(F.count(good) > 1, F.stddev_samp(good)).alias("sd"), F.count(good).alias("n"))


def bench_scores(flags: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Precision, recall, flags a session and failure rate of each setting. flags: keys, session, mark, expected, ok."""
    hit = F.count_if(F.col("mark") == "hit")
    return flags.groupBy(*keys).agg(
        F.try_divide(hit, F.count_if(F.col("mark").isin("hit", "known"))).alias("precision"), F.try_divide(hit, F.sum("expected")).alias("recall"),
        (F.count(F.lit(1)) / F.countDistinct("session")).alias("flags_per_session"), F.avg((~F.col("ok")).cast("double")).alias("fail_rate"),
    )


def recall_at(hits: DataFrame, group: str, item: str, rank: str, at: int) -> DataFrame:
    """Share of items whose first hit is within the first so many, and the upper-middle of first ranks."""
    first = hits.groupBy(group, item).agg(F.min(rank).alias("r"))
    n = F.count(F.lit(1))
    ranks = F.array_sort(F.collect_list("r"))
    return first.groupBy(group).agg((F.count_if(F.col("r") <= at) / n).alias("recall"), F.count_if(F.col("r").isNull()).alias("missed"), F.get(ranks, F.floor(F.size(ranks) / 2).cast("int")).alias("median_rank"))
