"""Gold labels against flags, located units, sampling and small models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions.names import normalise


def label_match(flags: DataFrame, gold: DataFrame) -> DataFrame:
    """Each flag as hit (a gap), known (declared no gap) or unlabelled. gold: session_id, name, is_gap; one row a name or alias."""
    keyed = gold.groupBy("session_id", normalise("name").alias("norm")).agg(F.bool_or("is_gap").alias("is_gap"))
    joined = flags.withColumn("norm", normalise("term")).join(keyed, ["session_id", "norm"], "left")
    return joined.withColumn("mark", F.when(F.col("is_gap"), "hit").when(F.col("is_gap").isNotNull(), "known").otherwise("unlabelled")).drop("is_gap", "norm")


def missed(flags: DataFrame, gold: DataFrame) -> DataFrame:
    """Gaps that no flag names."""
    said = flags.select("session_id", normalise("term").alias("norm")).distinct()
    return gold.where("is_gap").withColumn("norm", normalise("name")).join(said, ["session_id", "norm"], "left_anti").select("session_id", "name")


def covers(candidate: Column, gold: Column, slack: int = 2) -> Column:
    """The gold words stand in a row in the candidate, which has at most so many more."""
    c, g = F.split(normalise(candidate), " "), F.split(normalise(gold), " ")
    inside = F.contains(F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(g, " "), F.lit(" ")))
    return inside & (F.size(c) - F.size(g) <= slack)


def ngram_contains(tokens: Column, seq: Column) -> Column:
    """A word sequence occurs in a row among tokens."""
    starts = F.when(F.size(tokens) >= F.size(seq), F.sequence(F.lit(1), F.size(tokens) - F.size(seq) + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: F.slice(tokens, i, F.size(seq)) == seq)


def locate(points: DataFrame, units: DataFrame, bucket: int = 64) -> DataFrame:
    """The unit of each line: one that starts exactly there, else the shortest that spans it, else none.

    Lines and units meet in buckets of line numbers, so it is an equi join whatever the spans. points: key, line;
    units: key, unit, first, last.
    """
    spread = units.withColumn("_b", F.explode(F.sequence(F.floor(F.col("first") / bucket), F.floor(F.col("last") / bucket))))
    met = points.withColumn("_b", F.floor(F.col("line") / bucket)).join(spread, ["key", "_b"]).where(F.col("line").between(F.col("first"), F.col("last")))
    best = met.groupBy("key", "line").agg(F.min_by("unit", F.struct((F.col("first") != F.col("line")).cast("int"), F.col("last") - F.col("first"), "unit")).alias("unit"))
    return points.select("key", "line").distinct().join(best, ["key", "line"], "left")


def leave_one_out(entries: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The mean of the others for each entry: total minus own."""
    total = entries.groupBy(*keys).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return entries.join(total, keys).withColumn("others", F.try_divide(F.col("_s") - F.col(value), F.col("_n") - 1)).drop("_s", "_n")


def seeded_split(rows: DataFrame, keys: list[str], item: str, share: float, seed: int) -> DataFrame:
    """Reveals a fixed share of each group by hash order, the same on every run."""
    w, every = Window.partitionBy(*keys).orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(item).cast("string")), 256), item), Window.partitionBy(*keys)
    return rows.withColumn("revealed", F.row_number().over(w) <= F.floor(F.count(F.lit(1)).over(every) * share))


def flip(pairs: DataFrame, a: str, b: str, seed: int) -> DataFrame:
    """Turns about half of the pairs round, by hash."""
    coin = F.conv(F.left(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(a).cast("string"), F.col(b).cast("string")), 256), F.lit(4)), 16, 10).cast("long") % 2 == 1
    return pairs.withColumn("flipped", coin).withColumns({a: F.when(F.col("flipped"), F.col(b)).otherwise(F.col(a)), b: F.when(F.col("flipped"), F.col(a)).otherwise(F.col(b))})


def job_expansion(pairs: DataFrame, settings: DataFrame, repeats: int) -> DataFrame:
    """Every pair under every setting so many times, and once swapped. Both settings and repeats are a handful."""
    runs = F.array(*[F.struct(F.lit(k).alias("repeat"), F.lit(False).alias("swapped")) for k in range(repeats)], F.struct(F.lit(0).alias("repeat"), F.lit(True).alias("swapped")))
    return pairs.join(F.broadcast(settings), how="cross").select("*", F.inline(runs))


def membership(terms: DataFrame, vocabularies: dict[str, DataFrame]) -> DataFrame:
    """Which vocabularies hold each term, or hand. Each vocabulary: term."""
    out = terms
    for name, v in vocabularies.items():
        out = out.join(v.select("term").distinct().withColumn(f"_{name}", F.lit(name)), "term", "left")
    found = F.array_compact(F.array(*[f"_{n}" for n in vocabularies]))
    return out.select("term", F.when(F.size(found) > 0, F.array_join(found, ",")).otherwise("hand").alias("sources"))


def logistic(rows: DataFrame, features: list[str], label: str, reg: float = 0.0) -> DataFrame:
    """One row: intercept and coefficients of a logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    made = VectorAssembler(inputCols=features, outputCol="features").transform(rows.select(*features, F.col(label).cast("double").alias("label")))
    model = LogisticRegression(regParam=reg, standardization=False, maxIter=200, tol=1e-9).fit(made)
    return rows.sparkSession.createDataFrame([(float(model.intercept), [float(x) for x in model.coefficients])], "intercept double, coefficients array<double>")


def clusters(vectors: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """vec_id and cluster by bisecting k-means; stands in for agglomerative clustering, which needs all pairs."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    made = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return BisectingKMeans(k=k, seed=seed).fit(made).transform(made).select("vec_id", F.col("prediction").alias("cluster"))


def projected(vectors: DataFrame, k: int = 2) -> DataFrame:
    """vec_id and its first principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    made = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="p").fit(made).transform(made).select("vec_id", vector_to_array("p").alias("components"))


def glosses(concepts: DataFrame, encounters: DataFrame, judgments: DataFrame) -> DataFrame:
    """Latest paraphrase of each concept, and whether any of its encounters was confirmed."""
    by = encounters.join(judgments, "key", "left").groupBy("concept_id").agg(F.max_by("paraphrase", "event_id").alias("gloss"), F.bool_or(F.coalesce(F.col("judgment") == "confirmed", F.lit(False))).alias("confirmed"))
    return concepts.join(by, "concept_id", "left")


def spot_record(verdicts: DataFrame, judgments: DataFrame) -> DataFrame:
    """One row: answered spot checks and those that were known after all."""
    spots = verdicts.where("verdict = 'spot_check'").join(judgments.where("judgment is not null"), "key")
    return spots.agg(F.count(F.lit(1)).alias("answered"), F.count_if(F.col("judgment") == "dismissed").alias("known"))


def guard(concepts: DataFrame) -> DataFrame:
    """Why a concept may not be explained yet: nobody met it."""
    return concepts.withColumn("refused", F.when(F.coalesce("encounter_count", F.lit(0)) == 0, "never encountered"))


def ungraded(explanations: DataFrame, grades: DataFrame) -> DataFrame:
    last = grades.groupBy("explanation_id").agg(F.max_by("level", "event_id").alias("level"))
    return explanations.join(last, "explanation_id", "left").where("level is null")


def allowed_path(path: Column, root: str) -> Column:
    """A transcript below the root, without a way out of it."""
    return F.startswith(path, F.lit(root.rstrip("/") + "/")) & path.endswith(".jsonl") & ~path.rlike(r"(^|/)\.\.(/|$)")


def concept_units(encounters: DataFrame) -> DataFrame:
    """Encounters and distinct sessions of each concept; a manual one (no session) is a session of its own."""
    session = F.coalesce(F.col("session_id").cast("string"), F.concat(F.lit("manual-"), F.col("event_id").cast("string")))
    return encounters.groupBy("concept_id").agg(F.count(F.lit(1)).alias("encounters"), F.countDistinct(session).alias("sessions"))
