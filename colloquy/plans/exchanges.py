"""Queries of the exchange family."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import exchange as X
from colloquy.sources.domain import LOG_SQL, TURNS_SQL, log, table, turns

STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
HUMANS_SQL = f"{TURNS_SQL}, humans AS (SELECT * FROM turns WHERE role = 'user' AND NOT is_meta AND NOT is_sidechain AND text IS NOT NULL)"
WINDOWS_SQL = f"""{HUMANS_SQL}, windows AS (SELECT a.session_id, a.line_no AS assistant_line, {STRIP.replace('text', 'a.text')} AS assistant_text,
  min(h.line_no) AS human_line, arg_min({STRIP.replace('text', 'h.text')}, h.line_no) AS human_text
  FROM turns a LEFT JOIN humans h ON h.session_id = a.session_id AND h.line_no > a.line_no
  WHERE a.role = 'assistant' AND a.text IS NOT NULL AND length({STRIP.replace('text', 'a.text')}) >= 40 GROUP BY ALL)"""


def islands_sql(source: str) -> str:
    return f"""marked AS (SELECT *, CASE WHEN row_number() OVER o = 1 OR human_line IS DISTINCT FROM lag(human_line) OVER o THEN 1 ELSE 0 END AS fresh
  FROM {source} WINDOW o AS (PARTITION BY session_id ORDER BY assistant_line)),
 grouped AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY session_id ORDER BY assistant_line) AS BIGINT) AS island FROM marked),
 sizes AS (SELECT session_id, island, count(*) AS n_windows, min(assistant_line) AS first_line, max(assistant_line) AS last_line, max(human_line) AS human_line,
  CAST(sum(length(assistant_text)) + coalesce(max(length(human_text)), 0) AS BIGINT) AS size FROM grouped GROUP BY ALL)"""


def chunks_sql(budget: int) -> str:
    return f"""packed AS (SELECT session_id, island, size AS used, CAST(1 AS BIGINT) AS chunk FROM sizes WHERE island = 1
  UNION ALL SELECT s.session_id, s.island, CASE WHEN p.used + s.size > {budget} THEN s.size ELSE p.used + s.size END, CASE WHEN p.used + s.size > {budget} THEN p.chunk + 1 ELSE p.chunk END
  FROM packed p JOIN sizes s ON s.session_id = p.session_id AND s.island = p.island + 1)"""


def event_windows(spark, d):
    """Events as exchanges: a confirmation is the human line that answers everything before it."""
    e = log(spark, d)
    as_turns = e.select(F.col("key").alias("session_id"), F.col("event_id").alias("line_no"), F.when(F.col("event_type") == "encounter_confirmed", "user").otherwise("assistant").alias("role"), F.lpad(F.col("event_type"), 45, "-").alias("text"), F.lit(False).alias("is_meta"), F.lit(False).alias("is_sidechain"))
    return X.exchanges(as_turns)


EVENT_WINDOWS_SQL = f"""{LOG_SQL}, windows AS (SELECT a.key AS session_id, a.event_id AS assistant_line, lpad(a.event_type, 45, '-') AS assistant_text,
  min(h.event_id) AS human_line, any_value(lpad(h.event_type, 45, '-')) AS human_text
  FROM log a LEFT JOIN log h ON h.key = a.key AND h.event_id > a.event_id AND h.event_type = 'encounter_confirmed'
  WHERE a.event_type <> 'encounter_confirmed' GROUP BY ALL)"""


def coverage(spark, d):
    t = turns(spark, d).where("session_id % 2 = 0")
    return X.human_turns(t).groupBy("session_id").agg((F.count(F.lit(1)) - (F.col("session_id") % 3)).alias("seen"))


COVERAGE_SQL = "coverage AS (SELECT session_id, count(*) - (session_id % 3) AS seen FROM humans WHERE session_id % 2 = 0 GROUP BY session_id)"
STATED = ["session_id", "line_no", "text"]

QUERIES = {
    "human_turns": lambda s, d: X.human_turns(turns(s, d)).select(*STATED),
    "next_human": lambda s, d: X.exchanges(turns(s, d)),
    "exchange_islands": lambda s, d: X.island_sizes(X.islands(X.exchanges(turns(s, d)))),
    "exchange_chunks": lambda s, d: X.chunks(X.island_sizes(X.islands(X.exchanges(turns(s, d)))), 800),
    "event_islands": lambda s, d: X.island_sizes(X.islands(event_windows(s, d))),
    "event_chunks": lambda s, d: X.chunks(X.island_sizes(X.islands(event_windows(s, d))), 600),
    "moment_slice": lambda s, d: X.moment_slice(turns(s, d), 2, 5).select("session_id", "line_no", "role", "text"),
    "transcript_excerpt": lambda s, d: X.transcript_excerpt(turns(s, d), 1, 4),
    "session_inventory": lambda s, d: X.session_inventory(turns(s, d)),
    "pending_sessions": lambda s, d: X.pending(turns(s, d), coverage(s, d)),
    "sessions_with_humans": lambda s, d: X.sessions_with_humans(turns(s, d).select("session_id").distinct(), turns(s, d).where("line_no > 3")),
    "sessions_already_done": lambda s, d: X.already_done(turns(s, d).select("session_id").distinct(), coverage(s, d)),
    "recent_sessions": lambda s, d: X.recent_sessions(turns(s, d)),
    "anchor_sample": lambda s, d: X.anchor_sample(X.exchanges(turns(s, d))),
    "human_turn_counts": lambda s, d: X.human_turns(turns(s, d)).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_human")),
    "content_dup": lambda s, d: X.mention_dups(table(s, d, "documents"), "text", "source", ["doc_id"]).select("doc_id", "source", "is_dup"),
}

ORACLE_SQL = {
    "human_turns": f"WITH {HUMANS_SQL} SELECT session_id, line_no, text FROM humans",
    "next_human": f"WITH {WINDOWS_SQL} SELECT * FROM windows",
    "exchange_islands": f"WITH {WINDOWS_SQL}, {islands_sql('windows')} SELECT * FROM sizes",
    "exchange_chunks": f"WITH RECURSIVE {WINDOWS_SQL}, {islands_sql('windows')}, {chunks_sql(800)} SELECT session_id, island, chunk FROM packed",
    "event_islands": f"WITH {EVENT_WINDOWS_SQL}, {islands_sql('windows')} SELECT * FROM sizes",
    "event_chunks": f"WITH RECURSIVE {EVENT_WINDOWS_SQL}, {islands_sql('windows')}, {chunks_sql(600)} SELECT session_id, island, chunk FROM packed",
    "moment_slice": f"WITH {TURNS_SQL} SELECT session_id, line_no, role, text FROM turns WHERE line_no BETWEEN 2 AND 5 AND role IN ('user', 'assistant') AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY line_no, seq) <= 40",
    "transcript_excerpt": rf"""WITH {TURNS_SQL}, top AS (SELECT * FROM turns WHERE line_no BETWEEN 1 AND 4 AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY line_no, seq) <= 8)
  SELECT session_id, left(trim(regexp_replace(string_agg(role || ': ' || text, chr(10) ORDER BY line_no), '\s+', ' ', 'g')), 700) AS excerpt, count(*) AS n_rows FROM top GROUP BY ALL""",
    "session_inventory": f"""WITH {TURNS_SQL} SELECT session_id, count(*) AS n_turns, count(*) FILTER (role = 'user' AND NOT is_meta AND NOT is_sidechain) AS n_human,
  count(*) FILTER (role = 'assistant') AS n_assistant, count(*) FILTER (is_meta) AS n_meta, max(line_no) AS last_line FROM turns GROUP BY ALL""",
    "pending_sessions": f"""WITH {HUMANS_SQL}, {COVERAGE_SQL}, n AS (SELECT session_id, count(*) AS n_human FROM humans GROUP BY ALL)
  SELECT session_id, n_human, CASE WHEN seen IS NULL THEN 'never' ELSE 'grown' END AS reason FROM n LEFT JOIN coverage USING (session_id) WHERE seen IS NULL OR n_human > seen""",
    "sessions_with_humans": f"WITH {HUMANS_SQL} SELECT DISTINCT session_id FROM turns WHERE EXISTS (SELECT 1 FROM humans h WHERE h.session_id = turns.session_id AND h.line_no > 3)",
    "sessions_already_done": f"WITH {HUMANS_SQL}, {COVERAGE_SQL} SELECT DISTINCT session_id FROM turns WHERE session_id NOT IN (SELECT session_id FROM coverage)",
    "recent_sessions": f"WITH {HUMANS_SQL} SELECT session_id, max(line_no) AS last_line FROM turns WHERE session_id IN (SELECT session_id FROM humans) GROUP BY ALL ORDER BY last_line DESC, session_id LIMIT 20",
    "anchor_sample": f"""WITH {WINDOWS_SQL}, able AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY assistant_line) AS depth FROM windows WHERE length(assistant_text) > 400 AND human_line IS NOT NULL)
  SELECT session_id, assistant_line, human_line, depth FROM able ORDER BY depth, session_id LIMIT 50""",
    "human_turn_counts": f"WITH {HUMANS_SQL} SELECT session_id, count(*) AS n_human FROM humans GROUP BY ALL",
    "content_dup": "SELECT doc_id, source, first_value(source) OVER (PARTITION BY sha256(text) ORDER BY doc_id) <> source AS is_dup FROM documents",
}
