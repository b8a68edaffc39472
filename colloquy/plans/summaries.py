"""Queries of summaries: windows of days, accuracy by bucket, lists of several extractors, funnels, the read model."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import renders as N
from colloquy.operators import exchange as X, fold as D, probes as P, spend as S
from colloquy.operators.dml import LEVELS
from colloquy.plans.exchanges import WINDOWS_SQL
from colloquy.plans.folds import JUDGMENT_SQL
from colloquy.plans.spending import TOTALS_SQL
from colloquy.sources.domain import CALLS_SQL, LOG_SQL, calls, log, table, turns

JUDGED = "event_type IN ('encounter_confirmed', 'encounter_dismissed', 'encounter_judgment_retracted')"


def found(s, d, kind):
    return log(s, d).where(F.col("event_type") == kind).select("key", F.concat(F.lit("t"), (F.col("k") % 20).cast("string")).alias("term"), F.col("event_id").alias("place"))


def encounters(s, d):
    return log(s, d).where("event_type = 'encounter_recorded'").select("key", F.col("k").alias("concept_id"), "event_id").join(D.latest_judgment(log(s, d)), "key", "left")


def children(s, d):
    made = P.read_model(log(s, d).select(F.col("k").alias("concept_id")).distinct(), encounters(s, d))
    return made.select("concept_id", "waiting", F.array_join(F.transform("children", lambda x: F.concat(x["event_id"].cast("string"), F.lit(":"), x["judgment"])), ",").alias("children"))


QUERIES = {
    "spend_last_days": lambda s, d: P.last_days(S.spend(calls(s, d), [F.to_date("occurred_at").cast("string").alias("day")]), "day"),
    "bucket_accuracy": lambda s, d: P.bucket_accuracy(log(s, d).select(N.difficulty(F.col("k") % 5 + 1, F.col("key") % 4).alias("bucket"), (F.col("event_id") % 3).alias("seed"), (F.col("k") % 7 < 4).alias("correct"))),
    "unrecognised_level": lambda s, d: log(s, d).select("event_id", P.known_level(F.when(F.col("k") % 4 == 0, " Causal").when(F.col("k") % 4 == 1, "listed").when(F.col("k") % 4 == 2, "expert"), LEVELS).alias("level")),
    "fixture_exclude": lambda s, d: P.without_fixtures(log(s, d).select(F.when(F.col("k") % 10 == 0, "fixture").when(F.col("k") % 10 < 8, "local").alias("origin")))[1],
    "material_join": lambda s, d: P.materials_of(log(s, d).select(F.col("event_id").alias("material_id"), F.col("occurred_at").alias("generated_at")), log(s, d).where("event_type = 'session_analysed'").select(F.col("event_id").alias("material_id"), F.explode(F.array(F.col("k") % 20, F.col("k") % 7)).alias("concept_id"))),
    "resolvable_sessions": lambda s, d: P.resolvable(log(s, d).select(F.col("key").alias("session_id")).distinct(), turns(s, d)),
    "extractor_union": lambda s, d: P.extractor_union([found(s, d, "encounter_recorded"), found(s, d, "session_analysed")], "key"),
    "undo_window": lambda s, d: P.undone(log(s, d).where(JUDGED), "key", "event_id", "occurred_at", F.col("event_type") == "encounter_judgment_retracted", 6 * 3600),
    "e2e_funnel": lambda s, d: P.funnel([("sessions", turns(s, d).select("session_id").distinct()), ("windows", X.exchanges(turns(s, d))), ("proposed", log(s, d).where("event_type = 'encounter_recorded'")), ("judged", encounters(s, d).where("judgment is not null")), ("kept", encounters(s, d).where("judgment = 'confirmed'"))]),
    "read_model": children,
}

ORACLE_SQL = {
    "spend_last_days": f"WITH {CALLS_SQL}, d AS (SELECT CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS day, {TOTALS_SQL} FROM calls GROUP BY day) SELECT * FROM d WHERE CAST(day AS DATE) > (SELECT max(CAST(day AS DATE)) FROM d) - 14",
    "bucket_accuracy": f"""WITH {LOG_SQL}, x AS (SELECT event_id % 3 AS seed, k % 5 + 1 AS d, key % 4 AS l, k % 7 < 4 AS correct FROM log), b AS (SELECT CASE WHEN l = 0 THEN 'outside' WHEN d <= l - 1 THEN 'easy' WHEN d = l THEN 'boundary_known' WHEN d = l + 1 THEN 'boundary_unknown' ELSE 'hard' END AS bucket, seed, avg(CAST(correct AS DOUBLE)) AS a FROM x GROUP BY ALL)
 SELECT bucket, avg(a) AS accuracy, CASE WHEN count(*) > 1 THEN stddev_samp(a) END AS sd, count(*) AS seeds FROM b GROUP BY bucket""",
    "unrecognised_level": f"WITH {LOG_SQL} SELECT event_id, CASE k % 4 WHEN 0 THEN 'causal' WHEN 1 THEN 'listed' ELSE 'isolated' END AS level FROM log",
    "fixture_exclude": f"WITH {LOG_SQL} SELECT count(*) FILTER (k % 10 <> 0) AS kept, count(*) FILTER (k % 10 = 0) AS excluded FROM log",
    "material_join": f"WITH {LOG_SQL}, b AS (SELECT DISTINCT event_id AS material_id, occurred_at, unnest([k % 20, k % 7]) AS concept_id FROM log WHERE event_type = 'session_analysed') SELECT concept_id, material_id, row_number() OVER (PARTITION BY concept_id ORDER BY occurred_at DESC, material_id DESC) AS place FROM b",
    "resolvable_sessions": f"WITH {LOG_SQL} SELECT DISTINCT key AS session_id, key IN (SELECT conv_id FROM conversations) AS resolvable FROM log",
    "extractor_union": f"WITH {LOG_SQL}, e AS (SELECT key, 't' || (k % 20) AS term, min(CASE event_type WHEN 'encounter_recorded' THEN 0 ELSE 1000000000 END + event_id) AS p FROM log WHERE event_type IN ('encounter_recorded', 'session_analysed') GROUP BY ALL) SELECT key, term, row_number() OVER (PARTITION BY key ORDER BY p) AS place FROM e",
    "undo_window": f"WITH {LOG_SQL}, j AS (SELECT key, event_id, event_type, coalesce(lead(event_type) OVER w = 'encounter_judgment_retracted' AND epoch_us(lead(occurred_at) OVER w) - epoch_us(occurred_at) < 21601000000, false) AS undone FROM log WHERE {JUDGED} WINDOW w AS (PARTITION BY key ORDER BY event_id)) SELECT key, event_id, undone FROM j WHERE event_type <> 'encounter_judgment_retracted'",
    "e2e_funnel": f"""WITH {WINDOWS_SQL}, {LOG_SQL}, {JUDGMENT_SQL}, e AS (SELECT judgment FROM log LEFT JOIN judgments USING (key) WHERE event_type = 'encounter_recorded')
 SELECT CAST(0 AS BIGINT) AS stage_no, 'sessions' AS stage, count(DISTINCT session_id) AS n FROM turns UNION ALL SELECT 1, 'windows', count(*) FROM windows UNION ALL SELECT 2, 'proposed', count(*) FROM e UNION ALL SELECT 3, 'judged', count(judgment) FROM e UNION ALL SELECT 4, 'kept', count(*) FILTER (judgment = 'confirmed') FROM e""",
    "read_model": f"""WITH {LOG_SQL}, {JUDGMENT_SQL}, e AS (SELECT k, event_id, judgment FROM log LEFT JOIN judgments USING (key) WHERE event_type = 'encounter_recorded'), n AS (SELECT k, count(*) FILTER (judgment IS NULL) AS waiting, string_agg(event_id || ':' || coalesce(judgment, 'waiting'), ',' ORDER BY event_id DESC) AS children FROM e GROUP BY k)
 SELECT c.k AS concept_id, coalesce(waiting, 0) AS waiting, coalesce(children, '') AS children FROM (SELECT DISTINCT k FROM log) c LEFT JOIN n ON n.k IS NOT DISTINCT FROM c.k""",
}
