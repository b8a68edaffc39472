"""The engine's tables as views over the stored ones.

A conversation plays a captured session and an event stream plays the append-only log: both are what the operators
expect, so the same operators run on parsed transcripts and on these tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, line_no, seq, role, text, is_meta, is_sidechain; system rows are meta user lines."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("session_id"), (F.col("turn") + 1).alias("line_no"), F.lit(0).alias("seq"), F.when(F.col("role") == "system", "user").otherwise(F.col("role")).alias("role"),
        "text", (F.col("role") == "system").alias("is_meta"), F.lit(False).alias("is_sidechain"),
    )


TURNS_SQL = """turns AS (SELECT conv_id AS session_id, turn + 1 AS line_no, 0 AS seq, CASE WHEN role = 'system' THEN 'user' ELSE role END AS role,
  text, role = 'system' AS is_meta, false AS is_sidechain FROM conversations)"""

#: What each kind of event stands for in the log.
LOG_TYPES = {"signup": "encounter_recorded", "purchase": "encounter_confirmed", "click": "encounter_dismissed", "error": "encounter_judgment_retracted", "view": "session_analysed"}


def payload_k(props: Column | str = "props") -> Column:
    return F.get_json_object(props, "$.k").cast("long")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, occurred_at, key, event_type, k, value: one row an event, in order of event_id."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for kv in LOG_TYPES.items() for x in kv])[F.col("event_type")]
    return e.select("event_id", F.col("ts").alias("occurred_at"), F.col("user_id").alias("key"), kind.alias("event_type"), payload_k().alias("k"), "value")


LOG_SQL = """log AS (SELECT event_id, ts AS occurred_at, user_id AS key, CASE event_type WHEN 'signup' THEN 'encounter_recorded' WHEN 'purchase' THEN 'encounter_confirmed'
  WHEN 'click' THEN 'encounter_dismissed' WHEN 'error' THEN 'encounter_judgment_retracted' WHEN 'view' THEN 'session_analysed' END AS event_type,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events)"""

#: Every third purpose runs on a local model; a cost ending in a multiple of 7 cents was not reported.
PURPOSES = ("click", "error", "purchase", "signup", "view")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls: call_id, occurred_at, session_id, purpose, model, local, ok, cost (null: local or not reported), tokens, duration_ms."""
    e = table(spark, sf_dir, "events")
    local = F.col("event_id") % 11 == 0
    return e.select(
        F.col("event_id").alias("call_id"), F.col("ts").alias("occurred_at"), F.col("user_id").alias("session_id"), F.col("event_type").alias("purpose"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        local.alias("local"), (F.col("event_type") != "error").alias("ok"), F.when(local | (F.col("event_id") % 7 == 0), None).otherwise(F.col("value")).alias("cost"),
        payload_k().alias("tokens"), (payload_k() * 10 + F.col("event_id") % 10).alias("duration_ms"),
    )


CALLS_SQL = """calls AS (SELECT event_id AS call_id, ts AS occurred_at, user_id AS session_id, event_type AS purpose, 'm' || (user_id % 3) AS model, event_id % 11 = 0 AS local,
  event_type <> 'error' AS ok, CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END AS cost, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens,
  CAST(json_extract(props, '$.k') AS BIGINT) * 10 + event_id % 10 AS duration_ms FROM events)"""
