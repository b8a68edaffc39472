"""Queries of streaming forms (as batch over the stored events) and of sources for explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import injected as I
from colloquy.operators import material as M
from colloquy.sources.domain import LOG_SQL, log, table
from colloquy.streaming import live as L


def changes(s, d):
    """Events as file changes, forty projects."""
    e = log(s, d)
    return e.select(F.concat(F.lit("p"), (F.col("key") % 40).cast("string")).alias("project"), F.concat(F.lit("f"), F.col("key").cast("string")).alias("path"), F.col("occurred_at").cast("timestamp").alias("changed_at"))


NOW = "2024-01-30 23:30:00"
CHANGES_SQL = f"{LOG_SQL}, changes AS (SELECT 'p' || (key % 40) AS project, 'f' || key AS path, occurred_at AS changed_at FROM log)"


def occasions(s, d):
    out = L.stream_occasions(log(s, d).withColumn("occurred_at", F.col("occurred_at").cast("timestamp")), "key", "occurred_at")
    return out.select("key", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def found(s, d):
    return table(s, d, "pages").select(F.regexp_extract("url", r"://([^/]+)", 1).alias("term"), F.col("page_id").alias("place"), F.regexp_replace("url", r"[?#].*$", "").alias("url"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"))


FOUND_SQL = r"found AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS term, page_id AS place, regexp_replace(url, '[?#].*$', '') AS url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)"


def probabilities():
    return F.create_map(F.lit("causal"), F.col("k") / 100, F.lit("listed"), (100 - F.col("k")) / 200, F.lit("isolated"), (100 - F.col("k")) / 200)


QUERIES = {
    "session_windows_1h": occasions,
    "quiet_period": lambda s, d: L.quiet(changes(s, d), NOW, 60).select("project", "path").distinct(),
    "catch_up": lambda s, d: L.catch_up(changes(s, d), "2024-02-06 12:00:00").select("path").distinct(),
    "daily_once": lambda s, d: L.daily_once_batch(log(s, d).select(F.col("key").cast("string").alias("user"), F.col("event_id").cast("string").alias("key"), F.col("occurred_at").alias("at")), 18).select("user", "key"),
    "search_candidates": lambda s, d: M.search_candidates(found(s, d)),
    "gather_sources": lambda s, d: M.gather(found(s, d).where("place % 2 = 0").select("term", "place", F.col("url").alias("body")), found(s, d).where("place % 2 = 1").select("term", "place", F.col("title").alias("body"))),
    "verified_pages": lambda s, d: M.verified_pages(table(s, d, "pages"), "the").select("page_id", "excerpt"),
    "argmax_level": lambda s, d: log(s, d).select("event_id", I.argmax_level(probabilities()).alias("level")),
    "threshold_level": lambda s, d: log(s, d).select("event_id", I.threshold_level(probabilities(), 0.7).alias("level")),
}

STRIPPED = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"

ORACLE_SQL = {
    "session_windows_1h": f"""WITH {LOG_SQL}, m AS (SELECT key, epoch_us(occurred_at) AS t, CASE WHEN epoch_us(occurred_at) - lag(epoch_us(occurred_at)) OVER (PARTITION BY key ORDER BY occurred_at) <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM log), g AS (SELECT key, t, sum(fresh) OVER (PARTITION BY key ORDER BY t) AS o FROM m)
  SELECT key, min(t) AS start_us, max(t) + 3600000000 AS end_us, count(*) AS n FROM g GROUP BY key, o""",
    "quiet_period": f"WITH {CHANGES_SQL} SELECT DISTINCT project, path FROM changes c WHERE NOT EXISTS (SELECT 1 FROM changes x WHERE x.project = c.project AND x.changed_at > TIMESTAMP '{NOW}' - INTERVAL 60 MINUTE)",
    "catch_up": f"WITH {CHANGES_SQL} SELECT DISTINCT path FROM changes WHERE changed_at >= TIMESTAMP '2024-01-30 12:00:00'",
    "daily_once": 'SELECT CAST(user_id AS VARCHAR) AS "user", CAST(arg_min(event_id, ts) AS VARCHAR) AS key FROM events WHERE hour(ts) >= 18 GROUP BY user_id, CAST(ts AS DATE)',
    "search_candidates": f"WITH {FOUND_SQL}, o AS (SELECT term, url, min(place) AS place, left(arg_min(title, place), 140) AS title FROM found GROUP BY term, url) SELECT term, row_number() OVER (PARTITION BY term ORDER BY place) AS n, url, title FROM o QUALIFY n <= 5",
    "gather_sources": f"WITH {FOUND_SQL} SELECT term, place, CASE place % 2 WHEN 0 THEN url ELSE title END AS body, 'S' || row_number() OVER (PARTITION BY term ORDER BY place % 2, place) AS label FROM found",
    "verified_pages": f"WITH t AS (SELECT page_id, {STRIPPED} AS text FROM pages) SELECT page_id, substr(text, greatest(strpos(lower(text), 'the') - 260, 1), 800) AS excerpt FROM t WHERE strpos(lower(text), 'the') > 0",
    "argmax_level": f"WITH {LOG_SQL} SELECT event_id, CASE WHEN k / 100 > (100 - k) / 200 THEN 'causal' ELSE 'isolated' END AS level FROM log",
    "threshold_level": f"WITH {LOG_SQL} SELECT event_id, CASE WHEN k / 100 >= 0.7 THEN 'causal' WHEN k / 100 + (100 - k) / 200 >= 0.7 THEN 'listed' ELSE 'isolated' END AS level FROM log",
}
