"""Queries of the fold family."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import fold as D
from colloquy.sources.domain import LOG_SQL, log

JUDGMENT_SQL = """judgment AS (SELECT key, arg_max(CASE event_type WHEN 'encounter_confirmed' THEN 'confirmed' WHEN 'encounter_dismissed' THEN 'dismissed' ELSE '' END, event_id) AS j, arg_max(occurred_at, event_id) AS t
  FROM log WHERE event_type IN ('encounter_confirmed', 'encounter_dismissed', 'encounter_judgment_retracted') GROUP BY key),
 judgments AS (SELECT key, nullif(j, '') AS judgment, CASE WHEN j <> '' THEN t END AS judged_at FROM judgment)"""
STATE_SQL = f"""{LOG_SQL}, {JUDGMENT_SQL}, rec AS (SELECT key, count(*) FILTER (event_type = 'encounter_recorded') AS n_encounters,
  arg_max(CASE WHEN value >= 150 THEN 'causal' WHEN value >= 75 THEN 'listed' ELSE 'isolated' END, event_id) FILTER (event_type = 'session_analysed') AS level,
  bool_or(event_type = 'session_analysed' AND k > 90) AS exposed, bool_or(event_type = 'session_analysed' AND k < 10) AS explained FROM log GROUP BY key),
 st AS (SELECT *, CASE WHEN n_encounters = 0 THEN 'referenced' WHEN level = 'causal' THEN 'known' WHEN judgment = 'dismissed' THEN 'known' WHEN exposed THEN 'exposed' ELSE 'gap' END AS state FROM rec LEFT JOIN judgments USING (key)),
 states AS (SELECT key, n_encounters, level, judgment, exposed, state, CASE WHEN state = 'referenced' OR n_encounters = 0 THEN 'hidden' WHEN state = 'known' THEN 'closed' WHEN judgment IS NOT NULL OR explained THEN 'learning' ELSE 'open' END AS bucket FROM st)"""


def alias_ops(s, d):
    e = log(s, d).where("event_type in ('encounter_dismissed', 'encounter_judgment_retracted')")
    return e.select("key", "event_id", F.when(F.col("event_type") == "encounter_dismissed", "add").otherwise("remove").alias("op"), F.col("k").alias("alias"))


ALIAS_SQL = f"""{LOG_SQL}, ops AS (SELECT key, event_id, event_type = 'encounter_dismissed' AS is_add, k FROM log WHERE event_type IN ('encounter_dismissed', 'encounter_judgment_retracted')),
 live AS (SELECT key, k FROM ops GROUP BY key, k HAVING arg_max(is_add, event_id)),
 gone AS (SELECT key, k, max(event_id) AS last_remove FROM ops WHERE NOT is_add GROUP BY key, k),
 placed AS (SELECT o.key, o.k, min(o.event_id) AS place FROM ops o JOIN live USING (key, k) LEFT JOIN gone g USING (key, k) WHERE o.is_add AND o.event_id > coalesce(g.last_remove, -1) GROUP BY o.key, o.k)"""


def occasion_sql(seconds: int) -> str:
    return f"""WITH {LOG_SQL}, m AS (SELECT key, event_id, occurred_at, CASE WHEN lag(occurred_at) OVER o IS NULL OR epoch_us(occurred_at) - epoch_us(lag(occurred_at) OVER o) > {seconds * 1000000} THEN 1 ELSE 0 END AS fresh FROM log WINDOW o AS (PARTITION BY key ORDER BY occurred_at, event_id))
  SELECT event_id, key, CAST(sum(fresh) OVER (PARTITION BY key ORDER BY occurred_at, event_id) AS BIGINT) AS occasion FROM m"""


def occasion(seconds: int):
    return lambda s, d: D.occasions(log(s, d), "key", "occurred_at", "event_id", seconds).select("event_id", "key", "occasion")


QUERIES = {
    "fold_latest": lambda s, d: D.latest(log(s, d), ["key", "event_type"], F.when(F.col("k") % 5 != 0, F.col("k")), F.col("event_id")),
    "first_seen": lambda s, d: D.first_seen(log(s, d), "key"),
    "latest_judgment": lambda s, d: D.latest_judgment(log(s, d)),
    "superseded": lambda s, d: D.superseded(log(s, d)),
    "concept_rollup": lambda s, d: D.concept_rollup(log(s, d)),
    "concept_state": lambda s, d: D.concept_state(log(s, d)),
    "state_counts": lambda s, d: D.state_counts(D.concept_state(log(s, d))),
    "alias_fold": lambda s, d: D.alias_fold(alias_ops(s, d)),
    "occasions_1h": occasion(3600),
    "occasions_1d": occasion(86400),
    "occasions_1w": occasion(604800),
    "exposed_set": lambda s, d: D.exposed_set(log(s, d).where("event_type = 'session_analysed'").select(F.col("event_id").alias("material_id"), F.col("k").alias("concept_id")), log(s, d).where("event_type = 'session_analysed' and key % 3 = 0").select(F.col("event_id").alias("material_id"))),
    "compile_meta": lambda s, d: D.compile_meta(log(s, d)),
    "read_log": lambda s, d: log(s, d).where("event_type in ('encounter_confirmed', 'encounter_dismissed')").select("event_id", "key", "event_type"),
}

ORACLE_SQL = {
    "fold_latest": f"WITH {LOG_SQL}, r AS (SELECT key, event_type, arg_max(k, event_id) AS k FROM log GROUP BY ALL) SELECT key, event_type, CASE WHEN k % 5 <> 0 THEN k END AS latest FROM r",
    "first_seen": f"WITH {LOG_SQL} SELECT key, arg_min(occurred_at, event_id) AS first_at, min(event_id) AS first_event FROM log GROUP BY key",
    "latest_judgment": f"WITH {LOG_SQL}, {JUDGMENT_SQL} SELECT * FROM judgments",
    "superseded": f"WITH {LOG_SQL} SELECT key, max(event_id) AS event_id, count(*) > 1 AND arg_max(k, event_id) % 2 = 1 AS superseded FROM log WHERE event_type = 'encounter_recorded' GROUP BY key",
    "concept_rollup": f"WITH {LOG_SQL} SELECT k, count(*) AS encounter_count, count(DISTINCT key) AS n_keys, min(occurred_at) AS first_seen, max(occurred_at) AS last_seen, arg_max(value, event_id) AS last_value FROM log WHERE event_type = 'encounter_recorded' AND k IS NOT NULL GROUP BY k",
    "concept_state": f"WITH {STATE_SQL} SELECT * FROM states",
    "state_counts": f"WITH {STATE_SQL} SELECT state, bucket, count(*) AS n FROM states GROUP BY ALL",
    "alias_fold": f"WITH {ALIAS_SQL} SELECT key, string_agg(CAST(k AS VARCHAR), ',' ORDER BY place) AS aliases, count(*) AS n_aliases FROM placed GROUP BY key",
    "occasions_1h": occasion_sql(3600),
    "occasions_1d": occasion_sql(86400),
    "occasions_1w": occasion_sql(604800),
    "exposed_set": f"WITH {LOG_SQL} SELECT DISTINCT k AS concept_id FROM log WHERE event_type = 'session_analysed' AND key % 3 = 0",
    "compile_meta": "SELECT max(event_id) AS compiled_through, count(*) AS event_count FROM events",
    "read_log": f"WITH {LOG_SQL} SELECT event_id, key, event_type FROM log WHERE event_type IN ('encounter_confirmed', 'encounter_dismissed')",
}
