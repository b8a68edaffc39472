"""Queries of writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import dml as W
from colloquy.sources.domain import LOG_SQL, TURNS_SQL, log, turns


def events(s, d):
    kind = F.when(F.col("event_id") % 50 == 0, "made_up").when(F.col("event_id") % 50 == 1, "explanation_graded").otherwise(F.col("event_type"))
    names = F.when(F.col("k") % 3 == 0, F.array(F.lit("encounter_id"), F.lit("concept_id"), F.lit("source"), F.lit("paraphrase"))).when(F.col("k") % 3 == 1, F.array(F.lit("session_id"), F.lit("explanation_id"), F.lit("rubric"), F.lit("level"))).otherwise(F.array(F.lit("session_id"), F.lit("x"), F.lit("y"), F.lit("z")))
    values = F.array(F.col("key").cast("string"), F.lit("a"), F.lit("b"), F.when(F.col("k") % 2 == 0, "causal").otherwise("odd"))
    return log(s, d).select("event_id", kind.alias("event_type"), F.map_from_arrays(names, values).alias("payload"))


def old_new(s, d):
    t = turns(s, d).select("session_id", "line_no", F.length("text").cast("long").alias("size"))
    new = t.where("line_no % 3 = 0").select("session_id", F.col("line_no") + F.col("session_id") % 2, (F.col("size") + 1).alias("size"), F.col("line_no").alias("_order")).toDF("session_id", "line_no", "size", "_order")
    return t, new


QUERIES = {
    "append_event": lambda s, d: W.validated(events(s, d)).select("event_id", "actor", "subject", "error"),
    "upsert_turns": lambda s, d: W.upsert(*old_new(s, d), ["session_id", "line_no"]),
    "upsert_session": lambda s, d: W.upsert_first(log(s, d).where("event_type = 'encounter_recorded'").groupBy("key").agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("n")).where("key % 2 = 0"), log(s, d).where("event_type = 'session_analysed'").groupBy("key").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("n")).where("key % 3 = 0"), "key", ["k"], ["n"]),
    "drop_stale": lambda s, d: W.drop_stale(log(s, d).where("event_type = 'encounter_recorded'").select("event_id", F.col("key").alias("session_id"), F.when(F.col("k") % 10 != 0, F.col("event_id")).alias("encounter_id")), log(s, d).where("key % 5 = 0").select(F.col("key").alias("session_id")).distinct(), log(s, d).where("event_type = 'encounter_recorded' and k > 50").select(F.col("event_id").alias("encounter_id"))).select("event_id", "session_id"),
    "wipe": lambda s, d: W.wiped(log(s, d), ("encounter_recorded", "session_analysed"), log(s, d).where("event_type = 'encounter_confirmed' and k > 80").select("key"), "key").select("event_id", "event_type"),
    "delete_fixture": lambda s, d: W.without(log(s, d).select("event_id"), log(s, d).where("event_id % 50 = 0").select("event_id"), "event_id"),
}

ORACLE_SQL = {
    "append_event": f"""WITH {LOG_SQL}, x AS (SELECT event_id, key, k, CASE event_id % 50 WHEN 0 THEN 'made_up' WHEN 1 THEN 'explanation_graded' ELSE event_type END AS t, k % 3 AS m FROM log),
  y AS (SELECT *, CASE t WHEN 'encounter_recorded' THEN ['concept_id', 'encounter_id', 'paraphrase', 'source'] WHEN 'session_analysed' THEN ['session_id'] WHEN 'explanation_graded' THEN ['explanation_id', 'level', 'rubric'] ELSE ['encounter_id'] END AS need,
   CASE m WHEN 0 THEN ['encounter_id', 'concept_id', 'source', 'paraphrase'] WHEN 1 THEN ['session_id', 'explanation_id', 'rubric', 'level'] ELSE ['session_id', 'x', 'y', 'z'] END AS have FROM x),
  z AS (SELECT *, list_filter(need, lambda n: NOT list_contains(have, n)) AS missing FROM y)
  SELECT event_id, CASE WHEN t IN ('encounter_confirmed', 'encounter_dismissed', 'encounter_judgment_retracted') THEN 'user' ELSE 'system' END AS actor, CASE m WHEN 0 THEN 'a' WHEN 1 THEN 'a' ELSE CAST(key AS VARCHAR) END AS subject,
  CASE WHEN t = 'made_up' THEN 'unknown type' WHEN len(missing) > 0 THEN 'missing ' || array_to_string(missing, ',') WHEN t = 'explanation_graded' AND k % 2 = 1 THEN 'unknown level' END AS error FROM z""",
    "upsert_turns": f"""WITH {TURNS_SQL}, o AS (SELECT session_id, line_no, length(text) AS size FROM turns), n AS (SELECT session_id, line_no + session_id % 2 AS line_no, size + 1 AS size FROM o WHERE line_no % 3 = 0)
  SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.session_id = o.session_id AND n.line_no = o.line_no)""",
    "upsert_session": f"""WITH {LOG_SQL}, a AS (SELECT key, max(k) AS k, count(*) AS n FROM log WHERE event_type = 'encounter_recorded' AND key % 2 = 0 GROUP BY key), b AS (SELECT key, min(k) AS k, count(*) AS n FROM log WHERE event_type = 'session_analysed' AND key % 3 = 0 GROUP BY key)
  SELECT coalesce(a.key, b.key) AS key, coalesce(a.k, b.k) AS k, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM a FULL JOIN b ON a.key = b.key""",
    "drop_stale": f"WITH {LOG_SQL}, e AS (SELECT event_id, key AS session_id, CASE WHEN k % 10 <> 0 THEN CAST(event_id AS VARCHAR) ELSE '' END AS id, k FROM log WHERE event_type = 'encounter_recorded'), p AS (SELECT CAST(event_id AS VARCHAR) AS id FROM log WHERE event_type = 'encounter_recorded' AND k > 50), st AS (SELECT DISTINCT id FROM e WHERE session_id % 5 = 0 AND id NOT IN (SELECT id FROM p)) SELECT event_id, session_id FROM e WHERE id NOT IN (SELECT id FROM st)",
    "wipe": f"WITH {LOG_SQL} SELECT event_id, event_type FROM log WHERE event_type NOT IN ('encounter_recorded', 'session_analysed') OR key IN (SELECT key FROM log WHERE event_type = 'encounter_confirmed' AND k > 80)",
    "delete_fixture": "SELECT event_id FROM events WHERE event_id % 50 <> 0",
}
