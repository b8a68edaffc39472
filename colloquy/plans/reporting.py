"""Queries of reports and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import exchange as X, export as E, fold as D, reports as P, spend as S
from colloquy.plans.compiled import compile_state
from colloquy.plans.folds import JUDGMENT_SQL, STATE_SQL
from colloquy.sources.domain import CALLS_SQL, LOG_SQL, TURNS_SQL, calls, log, turns

SINCE, UNTIL = "2024-01-08", "2024-01-15"
IN = "occurred_at >= TIMESTAMP '2024-01-08' AND occurred_at < TIMESTAMP '2024-01-15'"


def of_type(s, d, kind):
    return log(s, d).where(F.col("event_type") == kind)


def flags(s, d):
    enc = of_type(s, d, "encounter_recorded").select("event_id", "key", F.col("k").alias("concept_id"))
    concepts = of_type(s, d, "session_analysed").groupBy(F.col("k").alias("concept_id")).agg(F.min("event_id").alias("created")).where("concept_id % 3 <> 0")
    return E.flags(enc, concepts, D.latest_judgment(log(s, d)))


def detections(s, d):
    runs = of_type(s, d, "session_analysed").select(F.col("event_id").alias("run_id"), F.when(F.col("k") % 5 != 0, F.transform(F.sequence(F.lit(1), F.col("k") % 5), lambda i: F.concat(F.lit("t"), i.cast("string")))).otherwise(F.array().cast("array<string>")).alias("candidates"))
    verdicts = of_type(s, d, "session_analysed").where("event_id % 2 = 0").select(F.col("event_id").alias("run_id"), F.lit("t2").alias("term"), F.lit("held").alias("verdict"))
    return E.detections(runs, verdicts).select("run_id", F.col("place").cast("long").alias("place"), "term", "verdict")


def sessions(s, d):
    one = lambda df, c: df.groupBy(F.col("key").alias("session_id")).agg(F.max("k").alias(c))
    return E.sessions(one(of_type(s, d, "session_analysed").where("key % 2 = 0"), "found"), one(of_type(s, d, "encounter_recorded").where("key % 3 = 0"), "ran"), S.session_spend(calls(s, d)).select("session_id", "cost", "calls"), X.session_inventory(turns(s, d)).select("session_id", "n_human"))


def resolutions(s, d):
    made = of_type(s, d, "encounter_recorded").select("event_id", "key")
    undone = of_type(s, d, "encounter_judgment_retracted").select(F.col("event_id").alias("corrected_by"), (F.col("event_id") - F.col("event_id") % 5).alias("supersedes")).groupBy("supersedes").agg(F.max("corrected_by").alias("corrected_by"))
    return E.corrections(made, undone, 300)


def materials(s, d):
    made = of_type(s, d, "session_analysed").select(F.col("event_id").alias("material_id"), "k")
    return E.materials(made.where("k % 2 = 0"), made.where("k % 2 = 1").drop("k"), of_type(s, d, "session_analysed").where("key % 4 = 0").select(F.col("event_id").alias("material_id")))


def payloads(s, d):
    payload = F.map_from_arrays(F.array(F.lit("k"), F.when(F.col("k") % 2 == 0, "paraphrase").otherwise("reason")), F.array(F.col("k").cast("string"), F.col("event_type")))
    return log(s, d).select("event_id", "event_type", payload.alias("payload"))


def frames(s, d):
    stamped = log(s, d).withColumn("is_fixture", F.col("event_id") % 50 == 0)
    return {"confirms": stamped.where("event_type = 'encounter_confirmed'"), "flags": stamped.where("event_type = 'encounter_recorded'"), "sessions": stamped.where("event_type = 'session_analysed'")}


def typed(s, d):
    """Stored events as a typed log: a concept for each k that was analysed, an encounter for each key."""
    t, k, key = F.col("event_type"), F.col("k").cast("string"), F.col("key").cast("string")
    made = F.create_map(F.lit("concept_id"), k, F.lit("canonical_name"), F.concat(F.lit("c"), k))
    met = F.create_map(F.lit("encounter_id"), key, F.lit("concept_id"), (F.col("k") % 60).cast("string"), F.lit("source"), F.lit("s"), F.lit("paraphrase"), F.lit("p"))
    rows = log(s, d)
    return rows.select(F.lpad(F.col("event_id").cast("string"), 10, "0").alias("event_id"), "occurred_at", F.when(t == "session_analysed", "concept_created").otherwise(t).alias("event_type"), F.when(t == "session_analysed", made).when(t == "encounter_recorded", met).otherwise(F.create_map(F.lit("encounter_id"), key)).alias("payload"), F.lit(None).cast("string").alias("supersedes"))


QUERIES = {
    "compiled_concepts": lambda s, d: compile_state(typed(s, d)).concepts.select("concept_id", "encounter_count", "judgment", "state", "bucket"),
    "compiled_encounters": lambda s, d: compile_state(typed(s, d)).encounters.select("encounter_id", "concept_id", "judgment"),
    "weekly_metrics": lambda s, d: P.weekly(log(s, d), SINCE, UNTIL),
    "weekly_all_time": lambda s, d: P.weekly(log(s, d), None, None),
    "pipeline_funnel": lambda s, d: P.funnel(log(s, d), SINCE, UNTIL),
    "surface_state": lambda s, d: P.surface(turns(s, d).select("session_id").distinct(), log(s, d).select(F.col("key").alias("session_id")).where("session_id % 2 = 0").distinct(), D.concept_state(log(s, d))),
    "capture_stats": lambda s, d: P.capture_stats(turns(s, d)),
    "populated_sections": lambda s, d: P.populated(D.concept_state(log(s, d))),
    "newest_concepts": lambda s, d: P.newest_concepts(log(s, d).groupBy("key").agg(F.max("occurred_at").alias("last_seen")), 25),
    "notify_select": lambda s, d: P.notify_select(of_type(s, d, "encounter_recorded").join(D.latest_judgment(log(s, d)), "key", "left"), of_type(s, d, "session_analysed").where("k > 95").select("key").distinct()),
    "export_flags": flags,
    "export_detections": detections,
    "export_sessions": sessions,
    "export_resolutions": resolutions,
    "export_materials": materials,
    "export_manifest": lambda s, d: E.manifest(frames(s, d), "occurred_at"),
    "redact": lambda s, d: E.redact(payloads(s, d)).select("event_id", F.array_join("withheld", ",").alias("withheld"), F.array_join(F.array_sort(F.map_keys("payload")), ",").alias("kept")),
}

WEEKLY = f"""{LOG_SQL}, {JUDGMENT_SQL}, f0 AS (SELECT key, arg_min(occurred_at, event_id) AS occurred_at, arg_min(k, event_id) AS k FROM log WHERE event_type = 'encounter_recorded' GROUP BY key),
 f AS (SELECT f0.key, f0.k, judgment, judgment IS NOT NULL AND k % 10 <> 0 AS judged, EXISTS (SELECT 1 FROM log e WHERE e.key = f0.key AND e.event_type = 'session_analysed' AND e.k < 10) AS explained FROM f0 LEFT JOIN judgments USING (key) WHERE {{0}}),
 one AS (SELECT count(*) AS flags, count(*) FILTER (k % 10 = 0) AS manual, count(*) FILTER (judged OR explained) AS engaged, count(*) FILTER (judged) AS judged, count(*) FILTER (judged AND judgment = 'dismissed') AS dismissed_now FROM f),
 last AS (SELECT key, arg_max(k, event_id) AS k FROM log WHERE event_type = 'session_analysed' AND {{0}} GROUP BY key), clean AS (SELECT count(*) AS sessions, count(*) FILTER (k % 4 = 0) AS sessions_clean FROM last),
 ev AS (SELECT count(*) FILTER (event_type = 'encounter_confirmed') AS confirms, count(*) FILTER (event_type = 'encounter_dismissed') AS dismissals, count(*) FILTER (event_type = 'encounter_judgment_retracted') AS undos FROM log WHERE {{0}})
 SELECT *, dismissed_now / nullif(judged, 0) AS dismissal_rate FROM one, clean, ev"""

COMPILED = f"""{LOG_SQL}, {JUDGMENT_SQL}, e AS (SELECT key, arg_max(k % 60, event_id) AS k, max(event_id) AS event_id FROM log WHERE event_type = 'encounter_recorded' GROUP BY key), enc AS (SELECT * FROM e LEFT JOIN judgments USING (key)),
 made AS (SELECT DISTINCT k FROM log WHERE event_type = 'session_analysed'),
 roll AS (SELECT k, count(*) AS n, arg_max(judgment, lpad(CAST(epoch_us(judged_at) AS VARCHAR), 20, '0') || lpad(CAST(event_id AS VARCHAR), 10, '0')) FILTER (judgment IS NOT NULL) AS judgment FROM enc GROUP BY k),
 st AS (SELECT CAST(k AS VARCHAR) AS concept_id, coalesce(n, 0) AS encounter_count, judgment, CASE WHEN coalesce(n, 0) = 0 THEN 'referenced' WHEN judgment = 'dismissed' THEN 'known' ELSE 'gap' END AS state FROM made LEFT JOIN roll USING (k))"""

ORACLE_SQL = {
    "compiled_concepts": f"WITH {COMPILED} SELECT *, CASE WHEN state = 'referenced' THEN 'hidden' WHEN state = 'known' THEN 'closed' WHEN judgment IS NOT NULL THEN 'learning' ELSE 'open' END AS bucket FROM st",
    "compiled_encounters": f"WITH {COMPILED} SELECT CAST(key AS VARCHAR) AS encounter_id, CAST(k AS VARCHAR) AS concept_id, judgment FROM enc",
    "weekly_metrics": "WITH " + WEEKLY.format(IN),
    "weekly_all_time": "WITH " + WEEKLY.format("true"),
    "pipeline_funnel": f"""WITH {LOG_SQL}, {JUDGMENT_SQL}, r AS (SELECT key, arg_max(k, event_id) AS found FROM log WHERE event_type = 'session_analysed' AND {IN} GROUP BY key), c AS (SELECT key, count(*) AS filed FROM log WHERE event_type = 'encounter_recorded' AND {IN} GROUP BY key),
  p AS (SELECT found, found // 2 AS gaps, coalesce(filed, 0) AS filed, judgment FROM r LEFT JOIN c USING (key) LEFT JOIN judgments USING (key))
  SELECT count(*) AS sessions, CAST(sum(found) AS BIGINT) AS found, CAST(sum(gaps) AS BIGINT) AS gaps, CAST(sum(least(gaps, filed)) AS BIGINT) AS judged, CAST(greatest(sum(gaps) - sum(filed), 0) AS BIGINT) AS not_judged, CAST(sum(filed) AS BIGINT) AS filed, count(judgment) AS answered FROM p""",
    "surface_state": f"""WITH {STATE_SQL}, ss AS (SELECT DISTINCT conv_id AS session_id FROM conversations), a AS (SELECT DISTINCT key AS session_id FROM log WHERE key % 2 = 0),
  c AS (SELECT (SELECT count(*) FROM ss) AS sessions, (SELECT count(*) FROM a) AS analysed, (SELECT count(*) FROM states WHERE bucket = 'open') AS opened, (SELECT count(*) FROM ss WHERE session_id NOT IN (SELECT session_id FROM a)) AS waiting)
  SELECT *, CASE WHEN sessions = 0 THEN 'not_captured' WHEN analysed = 0 THEN 'not_analysed' WHEN opened > 0 THEN 'gaps' WHEN waiting > 0 THEN 'not_analysed' WHEN analysed < 3 THEN 'cold_start' ELSE 'clean' END AS state FROM c""",
    "capture_stats": f"WITH {TURNS_SQL} SELECT count(*) AS turns, count(DISTINCT session_id) AS sessions, max(line_no) AS last_line, count(*) FILTER (is_meta) AS meta FROM turns",
    "populated_sections": f"WITH {STATE_SQL} SELECT CAST(CASE bucket WHEN 'open' THEN 0 WHEN 'learning' THEN 1 WHEN 'closed' THEN 2 ELSE 3 END AS BIGINT) AS place, bucket, count(*) AS n FROM states GROUP BY bucket",
    "newest_concepts": f"WITH {LOG_SQL} SELECT key, max(occurred_at) AS last_seen FROM log GROUP BY key ORDER BY last_seen DESC, key LIMIT 25",
    "notify_select": f"WITH {LOG_SQL}, {JUDGMENT_SQL} SELECT key, min(event_id) AS event_id FROM log LEFT JOIN judgments USING (key) WHERE event_type = 'encounter_recorded' AND judgment IS NULL AND key NOT IN (SELECT key FROM log WHERE event_type = 'session_analysed' AND k > 95) GROUP BY key",
    "export_flags": f"WITH {LOG_SQL}, {JUDGMENT_SQL}, c AS (SELECT k AS concept_id, min(event_id) AS created FROM log WHERE event_type = 'session_analysed' AND k % 3 <> 0 GROUP BY k) SELECT key, concept_id, event_id, created, judgment, judged_at FROM (SELECT event_id, key, k AS concept_id FROM log WHERE event_type = 'encounter_recorded') LEFT JOIN c USING (concept_id) LEFT JOIN judgments USING (key)",
    "export_detections": f"""WITH {LOG_SQL}, r AS (SELECT event_id AS run_id, k % 5 AS n FROM log WHERE event_type = 'session_analysed'), x AS (SELECT run_id, unnest(range(n)) AS place FROM r UNION ALL SELECT run_id, NULL FROM r WHERE n = 0)
  SELECT run_id, CAST(place AS BIGINT) AS place, 't' || (place + 1) AS term, CASE WHEN place = 1 AND run_id % 2 = 0 THEN 'held' END AS verdict FROM x""",
    "export_sessions": f"""WITH {LOG_SQL}, {TURNS_SQL}, c AS (SELECT user_id AS session_id, count(*) AS calls, sum(CASE WHEN event_id % 11 <> 0 AND event_id % 7 <> 0 THEN value END) AS cost FROM events GROUP BY user_id),
  a AS (SELECT key AS session_id, max(k) AS found FROM log WHERE event_type = 'session_analysed' AND key % 2 = 0 GROUP BY key), r AS (SELECT key AS session_id, max(k) AS ran FROM log WHERE event_type = 'encounter_recorded' AND key % 3 = 0 GROUP BY key),
  t AS (SELECT session_id, count(*) FILTER (role = 'user' AND NOT is_meta) AS n_human FROM turns GROUP BY session_id) SELECT session_id, found, ran, cost, calls, n_human FROM a FULL JOIN r USING (session_id) LEFT JOIN c USING (session_id) LEFT JOIN t USING (session_id)""",
    "export_resolutions": f"WITH {LOG_SQL}, u AS (SELECT event_id - event_id % 5 AS supersedes, max(event_id) AS corrected_by FROM log WHERE event_type = 'encounter_judgment_retracted' GROUP BY ALL) SELECT event_id, key, corrected_by FROM log LEFT JOIN u ON supersedes = event_id WHERE event_type = 'encounter_recorded' ORDER BY event_id DESC LIMIT 300",
    "export_materials": f"WITH {LOG_SQL} SELECT event_id AS material_id, CASE WHEN k % 2 = 0 THEN k END AS k, k % 2 = 1 AS refused, key % 4 = 0 AS delivered FROM log WHERE event_type = 'session_analysed'",
    "export_manifest": f"""WITH {LOG_SQL} SELECT CASE event_type WHEN 'encounter_confirmed' THEN 'confirms' WHEN 'encounter_recorded' THEN 'flags' ELSE 'sessions' END AS frame, count(*) AS rows, min(occurred_at) AS first_at, max(occurred_at) AS last_at, count(*) FILTER (event_id % 50 = 0) AS fixtures
  FROM log WHERE event_type IN ('encounter_confirmed', 'encounter_recorded', 'session_analysed') GROUP BY frame""",
    "redact": f"""WITH {LOG_SQL}, x AS (SELECT event_id, CASE WHEN k % 2 = 0 THEN 'paraphrase' ELSE 'reason' END AS t, event_type FROM log), y AS (SELECT event_id, t, (event_type = 'encounter_recorded' AND t = 'paraphrase') OR (event_type = 'encounter_dismissed' AND t = 'reason') AS gone FROM x)
  SELECT event_id, CASE WHEN gone THEN t ELSE '' END AS withheld, CASE WHEN gone THEN 'k' ELSE 'k,' || t END AS kept FROM y""",
}
