"""Queries of the spend ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import spend as S
from colloquy.sources.domain import CALLS_SQL, PURPOSES, calls, table

TOTALS_SQL = """count(*) AS calls, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (local) AS local_calls, count(*) FILTER (NOT local AND cost IS NOT NULL) AS priced,
  count(*) FILTER (NOT local AND cost IS NULL) AS unpriced, sum(cost) FILTER (NOT local) AS cost, CAST(sum(tokens) AS BIGINT) AS tokens"""
MONEY_SQL = "CASE WHEN {0} IS NULL THEN 'not reported' WHEN {0} = 0 THEN '$0' WHEN {0} < 0.0001 THEN '<$0.0001' WHEN {0} < 0.01 THEN printf('$%.4f', {0}) ELSE printf('$%.2f', {0}) END"
USED = "purpose IN ('click', 'purchase', 'view') AND session_id IS NOT NULL"
STAGES = (*PURPOSES, "refund")


def jobs(s, d):
    return table(s, d, "conversations").select(F.length("text").alias("prompt_chars"), F.lit(8000).alias("max_tokens"), (F.col("turn") % 3 + 1).alias("repeats"))


QUERIES = {
    "spend_total": lambda s, d: S.spend(calls(s, d)),
    "spend_window": lambda s, d: S.spend(calls(s, d), since="2024-01-08", until="2024-01-15"),
    "spend_by_purpose": lambda s, d: S.spend(calls(s, d), [F.col("purpose")]),
    "spend_by_day": lambda s, d: S.spend(calls(s, d), [F.to_date("occurred_at").cast("string").alias("day")]),
    "spend_per_session": lambda s, d: S.per_session(calls(s, d)),
    "spend_estimate": lambda s, d: S.estimate(calls(s, d), 10),
    "stage_cost": lambda s, d: S.stage_cost(calls(s, d), STAGES),
    "latency_by_purpose": lambda s, d: S.latency(calls(s, d)),
    "session_spend": lambda s, d: S.session_spend(calls(s, d)),
    "money_text": lambda s, d: table(s, d, "events").select("event_id", S.money(F.when(F.col("event_id") % 13 != 0, F.floor(F.col("value")) / F.when(F.col("event_id") % 3 == 0, 8).when(F.col("event_id") % 3 == 1, 65536).otherwise(1 << 24))).alias("text")),
    "total_text": lambda s, d: S.spend(calls(s, d), [F.col("session_id")], order="call_id").select("session_id", S.total_text(F.floor("cost").cast("double"), F.col("unpriced"), F.col("priced"), F.col("local_calls")).alias("text")),
    "ratio_text": lambda s, d: S.spend(calls(s, d), [F.col("session_id"), F.col("purpose")]).select("session_id", "purpose", S.ratio_text(F.col("failed"), F.col("priced")).alias("text")),
    "cost_ceiling": lambda s, d: S.cost_ceiling(jobs(s, d), 1e-6, 4e-6),
    "progress_accumulate": lambda s, d: S.running_totals(calls(s, d).select("call_id", "session_id", "tokens"), "session_id", "call_id", "tokens"),
}

ORACLE_SQL = {
    "spend_total": f"WITH {CALLS_SQL} SELECT {TOTALS_SQL} FROM calls",
    "spend_window": f"WITH {CALLS_SQL} SELECT {TOTALS_SQL} FROM calls WHERE occurred_at >= TIMESTAMP '2024-01-08' AND occurred_at < TIMESTAMP '2024-01-15'",
    "spend_by_purpose": f"WITH {CALLS_SQL} SELECT purpose, {TOTALS_SQL} FROM calls GROUP BY purpose",
    "spend_by_day": f"WITH {CALLS_SQL} SELECT CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS day, {TOTALS_SQL} FROM calls GROUP BY day",
    "spend_per_session": f"""WITH {CALLS_SQL}, o AS (SELECT model, session_id, sum(CASE WHEN local THEN 0.0 ELSE cost END) AS c, bool_or(local) AS l FROM calls WHERE {USED} AND (local OR cost IS NOT NULL) GROUP BY ALL)
  SELECT model, count(*) AS sessions, avg(c) AS per_session, bool_or(l) AS any_local FROM o GROUP BY model""",
    "spend_estimate": f"""WITH {CALLS_SQL}, o AS (SELECT model, session_id, sum(cost) AS c, max(call_id) AS last FROM calls WHERE {USED} AND NOT local AND cost IS NOT NULL GROUP BY model, session_id QUALIFY row_number() OVER (PARTITION BY model ORDER BY max(call_id) DESC) <= 20)
  SELECT model, count(*) AS sampled, avg(c) * 10 AS estimate FROM o GROUP BY model""",
    "stage_cost": f"""WITH {CALLS_SQL}, st AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{p}')" for k, p in enumerate(STAGES))}) t(stage_no, purpose)), f AS (SELECT purpose, count(*) AS calls, count(*) FILTER (NOT ok) AS failed, sum(cost) FILTER (NOT local) AS cost, count(*) FILTER (NOT local AND cost IS NULL) AS unpriced, median(duration_ms) AS median_ms FROM calls GROUP BY purpose)
  SELECT CAST(stage_no AS BIGINT) AS stage_no, purpose, coalesce(calls, 0) AS calls, coalesce(failed, 0) AS failed, coalesce(unpriced, 0) AS unpriced, cost, CAST(median_ms AS DOUBLE) AS median_ms FROM st LEFT JOIN f USING (purpose)""",
    "latency_by_purpose": f"WITH {CALLS_SQL} SELECT purpose, count(*) AS calls, avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END) AS fail_rate, CAST(quantile_cont(duration_ms, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont(duration_ms, 0.9) AS DOUBLE) AS p90, max(duration_ms) AS longest, CAST(sum(tokens) AS BIGINT) AS tokens FROM calls GROUP BY purpose",
    "session_spend": f"WITH {CALLS_SQL} SELECT session_id, count(*) AS calls, count(*) FILTER (NOT ok) AS failed, sum(cost) FILTER (NOT local) AS cost, count(cost) FILTER (NOT local) AS priced, CAST(sum(duration_ms) AS BIGINT) AS ms FROM calls GROUP BY session_id",
    "money_text": f"WITH x AS (SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN floor(value) / CASE event_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 65536 ELSE 16777216 END END AS v FROM events) SELECT event_id, {MONEY_SQL.format('v')} AS text FROM x",
    "total_text": f"""WITH {CALLS_SQL}, t AS (SELECT session_id, {TOTALS_SQL} FROM calls GROUP BY session_id), u AS (SELECT *, CASE WHEN priced = 0 AND unpriced = 0 AND local_calls > 0 THEN 'local' WHEN priced = 0 THEN 'not reported' ELSE {MONEY_SQL.format('floor(cost)')} END AS x FROM t)
  SELECT session_id, CASE WHEN unpriced > 0 AND priced > 0 THEN x || ' + ' || unpriced || ' unpriced' ELSE x END AS text FROM u""",
    "ratio_text": f"""WITH {CALLS_SQL}, t AS (SELECT session_id, purpose, {TOTALS_SQL} FROM calls GROUP BY ALL), u AS (SELECT *, CASE WHEN priced = 0 THEN failed || ' of ' || priced ELSE failed || ' of ' || priced || ' (' || CAST(floor(100 * failed / priced + 0.5) AS BIGINT) || '%)' END AS x FROM t)
  SELECT session_id, purpose, CASE WHEN priced > 0 AND priced < 5 THEN x || ' - too few to mean much' ELSE x END AS text FROM u""",
    "cost_ceiling": "SELECT sum((length(text) / 4 * 1e-6 + 8000 * 4e-6) * (turn % 3 + 1)) AS ceiling FROM conversations",
    "progress_accumulate": f"WITH {CALLS_SQL} SELECT call_id, session_id, tokens, CAST(sum(tokens) OVER (PARTITION BY session_id ORDER BY call_id) AS BIGINT) AS so_far FROM calls",
}
