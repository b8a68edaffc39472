"""Queries of ranking, triage and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import evals as E, fold as D, triage as T
from colloquy.plans.folds import STATE_SQL
from colloquy.sources.domain import LOG_SQL, log, table
from colloquy.state import quantiles


def proposed(s, d):
    """Events as proposals: a term a value of k, signal and importance by type and id."""
    e = log(s, d)
    signal = F.when(F.col("event_id") % 4 < 2, "accepted").when(F.col("event_id") % 4 == 2, "unclear").when(F.col("event_id") % 8 == 3, "questioned").otherwise("odd")
    importance = F.when(F.col("event_id") % 3 == 0, "central").when(F.col("event_id") % 3 == 1, "supporting").otherwise("vital")
    return e.select(F.col("key").alias("session_id"), F.floor(F.col("event_id") / 1000).alias("chunk"), F.col("event_id").alias("pos"), F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("Term ")).otherwise(F.lit("term ")), (F.col("k") % 40).cast("string")).alias("term"), F.when(F.col("event_id") % 17 != 0, "p").otherwise(" ").alias("paraphrase"), (F.col("k") % 60).alias("assistant_line"), signal.alias("signal"), importance.alias("importance"))


PROPOSED_SQL = f"""{LOG_SQL}, proposed AS (SELECT key AS session_id, CAST(floor(event_id / 1000) AS BIGINT) AS chunk, event_id AS pos, CASE WHEN event_id % 2 = 0 THEN 'Term ' ELSE 'term ' END || (k % 40) AS term, CASE WHEN event_id % 17 <> 0 THEN 'p' ELSE ' ' END AS paraphrase, k % 60 AS assistant_line,
  CASE WHEN event_id % 4 < 2 THEN 'accepted' WHEN event_id % 4 = 2 THEN 'unclear' WHEN event_id % 8 = 3 THEN 'questioned' ELSE 'odd' END AS signal, CASE event_id % 3 WHEN 0 THEN 'central' WHEN 1 THEN 'supporting' ELSE 'vital' END AS importance FROM log),
 coerced AS (SELECT * REPLACE (CASE WHEN importance IN ('central', 'supporting') THEN importance ELSE 'supporting' END AS importance) FROM proposed WHERE assistant_line % 2 = 0 AND trim(term) <> '' AND trim(paraphrase) <> '' AND signal IN ('accepted', 'unclear')),
 firsts AS (SELECT * FROM coerced QUALIFY row_number() OVER (PARTITION BY session_id, lower(trim(term)) ORDER BY chunk, pos) = 1),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CASE signal WHEN 'accepted' THEN 0 ELSE 1 END, CASE importance WHEN 'central' THEN 0 ELSE 1 END, assistant_line, lower(term)) AS rank FROM firsts)"""


def anchors(s, d):
    return proposed(s, d).where("assistant_line % 2 = 0").select("session_id", "assistant_line")


def ranked(s, d):
    return T.rank(T.first_wins(T.coerce(proposed(s, d), anchors(s, d))))


def entries(s, d):
    return table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select((F.floor(F.pmod(F.col("n_chars") + 137 * F.col("quality"), F.lit(400)) / 4) / 100).alias("score"), F.col("quality").alias("known"), "source")


ENTRIES_SQL = "entries AS (SELECT floor(((n_chars + 137 * quality) % 400) / 4) / 100 AS score, quality AS known, source FROM labels JOIN documents USING (doc_id))"
CUT_SQL = "by_score AS (SELECT score, sum(known) AS k, count(*) AS n FROM entries GROUP BY score), cuts AS (SELECT score, sum(k) OVER (ORDER BY score DESC) / sum(n) OVER (ORDER BY score DESC) AS precision FROM by_score)"


def scored(s, d):
    return entries(s, d).select("score", F.col("known").alias("label"), "source")


def judged(s, d):
    return ranked(s, d).where("signal = 'accepted'").withColumn("p", F.when(F.col("pos") % 9 != 0, F.pmod(F.col("pos") * 37, F.lit(100)) / 100))


JUDGED_SQL = f"""{PROPOSED_SQL}, judged AS (SELECT *, CASE WHEN pos % 9 <> 0 THEN (pos * 37) % 100 / 100 END AS p FROM ranked WHERE signal = 'accepted'),
 m AS (SELECT *, coalesce(p >= 0.6, false) AS held, coalesce(p >= 0.6, false) AND CAST('0x' || left(sha256(session_id || ':' || lower(term)), 8) AS BIGINT) % 5 = 0 AS able FROM judged),
 v AS (SELECT *, CASE WHEN able AND row_number() OVER (PARTITION BY session_id, able ORDER BY rank) = 1 THEN 'spot_check' WHEN held THEN 'held' ELSE 'passed' END AS verdict FROM m)"""


def bands_of(s, d):
    e = log(s, d).where("event_type in ('encounter_confirmed', 'encounter_dismissed', 'session_analysed')")
    return e.select((F.col("k") / 100).alias("p"), (F.col("event_type") != "session_analysed").alias("answered"), (F.col("event_type") == "encounter_dismissed").alias("dismissed"))


def votes(s, d):
    return log(s, d).select("key", "event_id", F.when(F.col("k") % 7 != 0, F.col("k") % 4).alias("vote"))


VOTES_SQL = f"{LOG_SQL}, votes AS (SELECT key, event_id, CASE WHEN k % 7 <> 0 THEN k % 4 END AS vote FROM log)"


def runs(s, d):
    return log(s, d).select(F.col("key").alias("unit"), (F.col("event_id") % 3).alias("run"), F.when(F.col("k") % 3 == 0, F.col("k")).alias("item"))


def vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).alias("label"))


UNIT_SQL = "u AS (SELECT vec_id, label % 2 AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings)"

QUERIES = {
    "candidate_coerce": lambda s, d: T.coerce(proposed(s, d), anchors(s, d)).select("session_id", "pos", "term", "importance"),
    "first_wins_dedupe": lambda s, d: T.first_wins(T.coerce(proposed(s, d), anchors(s, d))).select("session_id", "pos", "term"),
    "rank_candidates": lambda s, d: ranked(s, d).select("session_id", "pos", "rank"),
    "flag_budget": lambda s, d: T.gap_budget(ranked(s, d)).select("session_id", "pos", "rank"),
    "triage_verdicts": lambda s, d: T.triage(judged(s, d), 0.6).select("session_id", "pos", "verdict", "emitted"),
    "calibrate_cut": lambda s, d: T.calibrate(entries(s, d), 0.85),
    "cut_rule": lambda s, d: T.cut_rule(entries(s, d), target=0.85),
    "calibration_bands": lambda s, d: T.bands(bands_of(s, d)),
    "knowledge_map": lambda s, d: T.knowledge_map(D.concept_state(log(s, d)).join(log(s, d).groupBy("key").agg(F.max("occurred_at").alias("last_seen")), "key")).select("key", "side", "place"),
    "auc": lambda s, d: E.auc(scored(s, d)),
    "auc_by_source": lambda s, d: E.auc(scored(s, d), ("source",)),
    "best_threshold": lambda s, d: E.best_threshold(scored(s, d)),
    "confusion": lambda s, d: E.confusion(scored(s, d).withColumn("found", (F.col("score") >= 0.5).cast("int")), "label", "found"),
    "grader_confusion": lambda s, d: E.confusion_pivot(scored(s, d).withColumn("found", (F.col("score") >= 0.5).cast("int")), "label", "found", [0, 1]),
    "jaccard_stability": lambda s, d: E.jaccard_stability(runs(s, d)),
    "majority_vote": lambda s, d: E.majority(votes(s, d), "key", "vote", "event_id"),
    "unanimity": lambda s, d: E.unanimity(votes(s, d).withColumn("key", F.floor(F.col("event_id") / 3)), "key", "vote", 3),
    "pair_cosine": lambda s, d: vectors(s, d).alias("a").join(vectors(s, d).alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id").alias("vec_id"), E.dot(E.unit(F.col("a.embedding")), E.unit(F.col("b.embedding"))).alias("cosine")),
    "knn_vote": lambda s, d: E.knn_vote(vectors(s, d).where("vec_id % 100 = 0"), vectors(s, d)),
    "mean_sd": lambda s, d: E.mean_sd(table(s, d, "events").withColumn("v", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))), "user_id", "v"),
    "quantile_linear": lambda s, d: quantiles(table(s, d, "lineitem"), "l_returnflag", "l_quantity", {"p90": 0.9}).join(quantiles(table(s, d, "lineitem"), "l_returnflag", "l_extendedprice", {"p25": 0.25}), "l_returnflag"),
    "bench_scores": lambda s, d: E.bench_scores(log(s, d).select((F.col("key") % 3).alias("model"), (F.col("key") % 2).alias("effort"), F.col("key").alias("session"), F.when(F.col("k") % 3 == 0, "hit").when(F.col("k") % 3 == 1, "known").otherwise("unlabelled").alias("mark"), (F.col("k") % 2).alias("expected"), (F.col("event_id") % 10 != 0).alias("ok")), ("model", "effort")),
    "recall_at": lambda s, d: E.recall_at(log(s, d).select((F.col("key") % 5).alias("extractor"), F.col("key").alias("item"), F.when(F.col("k") > 10, F.col("k")).alias("rank")), "extractor", "item", "rank", 15),
}

ORACLE_SQL = {
    "candidate_coerce": f"WITH {PROPOSED_SQL} SELECT session_id, pos, term, importance FROM coerced",
    "first_wins_dedupe": f"WITH {PROPOSED_SQL} SELECT session_id, pos, term FROM firsts",
    "rank_candidates": f"WITH {PROPOSED_SQL} SELECT session_id, pos, rank FROM ranked",
    "flag_budget": f"WITH {PROPOSED_SQL} SELECT session_id, pos, rank FROM ranked WHERE signal = 'accepted' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY rank) <= 2",
    "triage_verdicts": f"WITH {JUDGED_SQL} SELECT session_id, pos, verdict, verdict = 'spot_check' OR (verdict = 'passed' AND row_number() OVER (PARTITION BY session_id, verdict ORDER BY rank) <= 2) AS emitted FROM v",
    "calibrate_cut": f"WITH {ENTRIES_SQL}, {CUT_SQL} SELECT min(score) AS cut, arg_min(precision, score) AS precision FROM cuts WHERE precision >= 0.85",
    "cut_rule": f"""WITH {ENTRIES_SQL}, {CUT_SQL}, c AS (SELECT min(score) AS cut FROM cuts WHERE precision >= 0.85), n AS (SELECT CAST(sum(known) AS BIGINT) AS known, CAST(sum(1 - known) AS BIGINT) AS unknown FROM entries),
  x AS (SELECT *, CASE WHEN least(known, unknown) < 3 THEN 'no map' WHEN least(known, unknown) < 8 THEN 'default' WHEN cut IS NULL THEN 'unreliable' ELSE 'map' END AS source FROM n, c) SELECT known, unknown, CASE source WHEN 'default' THEN 0.5 WHEN 'map' THEN cut END AS cut, source FROM x""",
    "calibration_bands": f"WITH {LOG_SQL} SELECT CASE WHEN k < 10 THEN 0 WHEN k < 30 THEN 1 ELSE 2 END AS band, count(*) AS answered, count(*) FILTER (event_type = 'encounter_dismissed') AS dismissed FROM log WHERE event_type IN ('encounter_confirmed', 'encounter_dismissed') GROUP BY band",
    "knowledge_map": f"WITH {STATE_SQL}, seen AS (SELECT key, max(occurred_at) AS last_seen FROM log GROUP BY key), sides AS (SELECT key, last_seen, CASE WHEN state = 'known' THEN 'known' WHEN judgment = 'confirmed' THEN 'unknown' END AS side FROM states JOIN seen USING (key)) SELECT key, side, row_number() OVER (PARTITION BY side ORDER BY last_seen DESC, key) AS place FROM sides WHERE side IS NOT NULL QUALIFY place <= 40",
    "auc": f"WITH {ENTRIES_SQL} SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) / count(*) AS auc FROM entries a JOIN entries b ON a.known = 1 AND b.known = 0",
    "auc_by_source": f"WITH {ENTRIES_SQL}, x AS (SELECT a.source, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) / count(*) AS auc FROM entries a JOIN entries b ON a.source = b.source AND a.known = 1 AND b.known = 0 GROUP BY a.source) SELECT source, auc FROM (SELECT DISTINCT source FROM entries) LEFT JOIN x USING (source)",
    "best_threshold": f"WITH {ENTRIES_SQL}, c AS (SELECT DISTINCT score AS cut FROM entries), r AS (SELECT cut, count(*) FILTER ((score >= cut) = (known = 1)) / count(*) AS accuracy FROM c, entries GROUP BY cut) SELECT cut, accuracy FROM r ORDER BY accuracy DESC, cut LIMIT 1",
    "confusion": f"WITH {ENTRIES_SQL} SELECT known AS label, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS found, count(*) AS n FROM entries GROUP BY ALL",
    "grader_confusion": f"WITH {ENTRIES_SQL} SELECT known AS label, count(*) FILTER (score < 0.5) / count(*) AS share_0, count(*) FILTER (score >= 0.5) / count(*) AS share_1, avg(CASE WHEN (score >= 0.5) = (known = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM entries GROUP BY known",
    "jaccard_stability": f"""WITH {LOG_SQL}, r AS (SELECT key AS unit, event_id % 3 AS run, list_distinct(list(CASE WHEN k % 3 = 0 THEN k END)) AS s FROM log GROUP BY ALL)
  SELECT a.unit, avg(CASE WHEN len(a.s) + len(b.s) = 0 THEN 1.0 ELSE len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END) AS jaccard FROM r a JOIN r b ON a.unit = b.unit AND a.run < b.run GROUP BY a.unit""",
    "majority_vote": f"WITH {VOTES_SQL}, n AS (SELECT key, vote, count(*) AS n, min(event_id) AS first FROM votes WHERE vote IS NOT NULL GROUP BY ALL) SELECT key, vote AS majority, n AS votes FROM n QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, first) = 1",
    "unanimity": f"WITH {VOTES_SQL} SELECT event_id // 3 AS key, count(DISTINCT vote) = 1 AND count(vote) = count(*) AND count(*) >= 3 AS unanimous FROM votes GROUP BY event_id // 3",
    "pair_cosine": f"WITH {UNIT_SQL} SELECT a.vec_id, list_dot_product(a.v, b.v) AS cosine FROM u a JOIN u b ON b.vec_id = a.vec_id + 1",
    "knn_vote": f"""WITH {UNIT_SQL}, n AS (SELECT a.vec_id AS query_id, b.label, list_dot_product(a.v, b.v) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) <= 7), t AS (SELECT *, max(sim) OVER (PARTITION BY query_id) AS top FROM n)
  SELECT query_id, sum(exp((sim - top) / 0.05) * label) / sum(exp((sim - top) / 0.05)) AS vote, count(*) AS neighbours FROM t GROUP BY query_id""",
    "mean_sd": "SELECT user_id, avg(value) AS mean, CASE WHEN count(value) > 1 THEN stddev_samp(value) END AS sd, count(value) AS n FROM (SELECT user_id, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events) GROUP BY user_id",
    "quantile_linear": "SELECT l_returnflag, quantile_cont(l_quantity, 0.9) AS p90, quantile_cont(l_extendedprice, 0.25) AS p25 FROM lineitem GROUP BY l_returnflag",
    "bench_scores": f"""WITH {LOG_SQL} SELECT key % 3 AS model, key % 2 AS effort, count(*) FILTER (k % 3 = 0) / count(*) FILTER (k % 3 < 2) AS precision, count(*) FILTER (k % 3 = 0) / sum(k % 2) AS recall, count(*) / count(DISTINCT key) AS flags_per_session, avg(CASE WHEN event_id % 10 = 0 THEN 1.0 ELSE 0.0 END) AS fail_rate FROM log GROUP BY ALL""",
    "recall_at": f"WITH {LOG_SQL}, f AS (SELECT key % 5 AS extractor, key, min(CASE WHEN k > 10 THEN k END) AS r FROM log GROUP BY ALL) SELECT extractor, count(*) FILTER (r <= 15) / count(*) AS recall, count(*) FILTER (r IS NULL) AS missed, list_sort(list(r) FILTER (r IS NOT NULL))[len(list(r) FILTER (r IS NOT NULL)) // 2 + 1] AS median_rank FROM f GROUP BY extractor",
}
