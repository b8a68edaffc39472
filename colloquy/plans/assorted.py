"""Queries of labels, sampling, rendering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import renders as R
from colloquy.operators import fold as D, labelled as L
from colloquy.plans.folds import JUDGMENT_SQL
from colloquy.plans.judging import JUDGED_SQL, judged
from colloquy.operators import triage as T
from colloquy.sources.domain import LOG_SQL, log, table, turns


def flags(s, d):
    return log(s, d).where("event_type = 'encounter_recorded'").select("event_id", F.col("key").alias("session_id"), F.concat(F.lit("Term-"), (F.col("k") % 20).cast("string")).alias("term"))


def gold(s, d):
    return log(s, d).where("event_type = 'session_analysed'").select(F.col("key").alias("session_id"), F.concat(F.lit("term "), (F.col("k") % 20).cast("string")).alias("name"), (F.col("k") % 2 == 0).alias("is_gap"))


GOLD_SQL = f"""{LOG_SQL}, flags AS (SELECT event_id, key AS session_id, 'Term-' || (k % 20) AS term, 'term ' || (k % 20) AS norm FROM log WHERE event_type = 'encounter_recorded'),
 gold AS (SELECT key AS session_id, 'term ' || (k % 20) AS name, k % 2 = 0 AS is_gap FROM log WHERE event_type = 'session_analysed')"""


def points(s, d):
    return log(s, d).where("event_type = 'session_analysed'").select("key", F.col("k").alias("line"))


def units(s, d):
    return log(s, d).where("event_type <> 'session_analysed'").select("key", F.col("event_id").alias("unit"), F.col("k").alias("first"), (F.col("k") + F.col("event_id") % 5).alias("last"))


UNITS_SQL = f"{LOG_SQL}, points AS (SELECT DISTINCT key, k AS line FROM log WHERE event_type = 'session_analysed'), units AS (SELECT key, event_id AS unit, k AS first, k + event_id % 5 AS last FROM log WHERE event_type <> 'session_analysed')"


def usage_rows(s, d):
    n = F.col("event_id")
    body = F.concat(F.lit('{"prompt_tokens": '), F.when(n % 3 == 0, F.lit("null")).otherwise((n % 100).cast("string")), F.lit(', "input_tokens": 7, "completion_tokens": "'), (n % 50).cast("string"), F.lit('", "cost": '), F.when(n % 5 == 0, F.lit("null")).otherwise(F.lit("0.25")), F.lit(', "is_byok": '), (n % 2 == 0).cast("string"), F.lit(', "cost_details": {"upstream_inference_cost": 0.5}, "local": '), (n % 7 == 0).cast("string"), F.lit("}"))
    return log(s, d).select("event_id", R.usage(body).alias("u")).select("event_id", "u.*")


def captured(s, d):
    return turns(s, d).select("session_id").distinct()


def done(s, d):
    return log(s, d).select(F.col("key").alias("session_id")).where("session_id % 2 = 0").distinct()


SETS_SQL = f"{LOG_SQL}, captured AS (SELECT DISTINCT conv_id AS session_id FROM conversations), done AS (SELECT DISTINCT key AS session_id FROM log WHERE key % 2 = 0)"
ENC = "event_type = 'encounter_recorded'"

QUERIES = {
    "label_match": lambda s, d: L.label_match(flags(s, d), gold(s, d)),
    "missed_gaps": lambda s, d: L.missed(flags(s, d), gold(s, d)).distinct(),
    "gold_cover": lambda s, d: flags(s, d).select("event_id", L.covers(F.concat(F.lit("the old "), "term", F.when(F.col("event_id") % 2 == 0, " of all").otherwise("")), F.col("term")).alias("covers")),
    "ngram_contains": lambda s, d: table(s, d, "part").select("p_partkey", L.ngram_contains(F.split(F.concat("p_name", F.lit(" of "), F.lower("p_type")), " "), F.array(F.lit("ring"), F.lit("of"))).alias("found")),
    "interval_locate": lambda s, d: L.locate(points(s, d), units(s, d)),
    "leave_one_out": lambda s, d: L.leave_one_out(log(s, d).select("event_id", "key", "value"), ["key"], "value"),
    "seeded_split": lambda s, d: L.seeded_split(log(s, d).select("event_id", "key"), ["key"], "event_id", 0.4, 11),
    "pair_shuffle_flip": lambda s, d: L.flip(log(s, d).select("event_id", F.col("key").alias("a"), F.col("k").alias("b")), "a", "b", 5),
    "job_expansion": lambda s, d: L.job_expansion(table(s, d, "nation").select("n_nationkey"), table(s, d, "region").select(F.col("r_regionkey").alias("setting")), 3),
    "source_membership": lambda s, d: L.membership(log(s, d).select(F.col("k").cast("string").alias("term")).distinct(), {n: log(s, d).where(F.col("event_type") == t).where(F.col("k") % m == 0).select(F.col("k").cast("string").alias("term")) for n, t, m in (("seen", "encounter_recorded", 2), ("asked", "session_analysed", 3))}),
    "gloss_subquery": lambda s, d: L.glosses(log(s, d).select(F.col("k").alias("concept_id")).distinct(), log(s, d).where(ENC).select("event_id", "key", F.col("k").alias("concept_id"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("paraphrase")), D.latest_judgment(log(s, d))),
    "spot_check_record": lambda s, d: L.spot_record(T.triage(judged(s, d), 0.6).select(F.col("session_id").alias("key"), "verdict"), D.latest_judgment(log(s, d))),
    "guard_depth1": lambda s, d: L.guard(log(s, d).groupBy("key").agg(F.count_if(F.col("event_type") == "encounter_recorded").alias("encounter_count")).select("key", F.when(F.col("key") % 5 != 0, F.col("encounter_count")).alias("encounter_count"))),
    "ungraded": lambda s, d: L.ungraded(log(s, d).where(ENC).select(F.col("event_id").alias("explanation_id")), log(s, d).where("event_type = 'session_analysed'").select("event_id", (F.col("event_id") - F.col("event_id") % 3).alias("explanation_id"), F.when(F.col("k") % 4 != 0, "listed").alias("level"))).select("explanation_id"),
    "path_allowlist": lambda s, d: log(s, d).select("event_id", L.allowed_path(F.concat(F.when(F.col("k") % 3 == 0, "/root/x/").otherwise("/rootx/"), F.when(F.col("k") % 4 == 0, "../").otherwise("a/"), F.col("key").cast("string"), F.when(F.col("k") % 2 == 0, ".jsonl").otherwise(".json")), "/root").alias("ok")),
    "concept_units": lambda s, d: L.concept_units(log(s, d).where(ENC).select("event_id", F.col("k").alias("concept_id"), F.when(F.col("event_id") % 3 != 0, F.col("key")).alias("session_id"))),
    "usage_normalise": usage_rows,
    "number_coerce": lambda s, d: log(s, d).select("event_id", R.number(F.when(F.col("k") % 4 == 0, "x1").when(F.col("k") % 4 == 1, "true").otherwise(F.col("k").cast("string")), F.when(F.col("k") % 4 == 1, "boolean").otherwise("string")).alias("n")),
    "difficulty_bucket": lambda s, d: log(s, d).select("event_id", R.difficulty(F.col("k") % 5 + 1, F.col("key") % 4).alias("bucket")),
    "question": lambda s, d: table(s, d, "nation").select("n_nationkey", R.question(F.col("n_name")).alias("text")),
    "render_windows": lambda s, d: R.ordered_block(turns(s, d).select("session_id", "line_no", F.concat(F.lit("["), F.col("line_no").cast("string"), F.lit("] "), "text").alias("l")), "session_id", ["line_no"], F.col("l")),
    "map_fingerprint": lambda s, d: R.map_fingerprint(table(s, d, "nation").select((F.col("n_regionkey") % 2).cast("string").alias("side"), "n_name"), "side", "n_name"),
    "backticked": lambda s, d: table(s, d, "nation").select("n_nationkey", F.array_join(R.backticked(F.concat(F.lit("use `a b` and `"), "n_name", F.lit("` or `a b` ```x `no` ``` end"))), "|").alias("code")),
    "clean_markdown": lambda s, d: table(s, d, "nation").select("n_nationkey", R.clean_markdown(F.concat(F.lit("## Head  `"), "n_name", F.lit("` see https://x.y/z?q now - item **"))).alias("text")),
    "mean_sd_format": lambda s, d: log(s, d).groupBy("key").agg(F.avg(F.col("k")).alias("m"), F.when(F.count(F.lit(1)) > 1, F.stddev_samp("k")).alias("sd")).select("key", R.mean_sd_text(F.floor(F.col("m")).cast("double"), F.floor("sd").cast("double")).alias("text")),
    "camel": lambda s, d: table(s, d, "part").select("p_partkey", R.camel(F.when(F.col("p_partkey") % 2 == 0, F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))).otherwise(F.col("p_name"))).alias("is_camel")),
    "since_string": lambda s, d: log(s, d).where(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss") >= "2024-01-20").select("event_id"),
    "key_union": lambda s, d: captured(s, d).union(done(s, d)).distinct(),
    "intersect_done": lambda s, d: captured(s, d).intersect(done(s, d)),
    "except_todo": lambda s, d: captured(s, d).exceptAll(done(s, d)),
    "logistic_combo": lambda s, d: L.logistic(log(s, d).select((F.col("k") / 100).alias("x"), (F.col("key") % 7 / 7).alias("y"), (F.col("event_id") % 3 == 0).cast("int").alias("label")), ["x", "y"], "label"),
    "clusters": lambda s, d: L.clusters(table(s, d, "embeddings"), 4),
    "principal_components": lambda s, d: L.projected(table(s, d, "embeddings")),
}

ORACLE_SQL = {
    "label_match": f"WITH {GOLD_SQL}, g AS (SELECT session_id, name, bool_or(is_gap) AS is_gap FROM gold GROUP BY ALL) SELECT event_id, f.session_id, term, CASE WHEN is_gap THEN 'hit' WHEN is_gap IS NOT NULL THEN 'known' ELSE 'unlabelled' END AS mark FROM flags f LEFT JOIN g ON g.session_id = f.session_id AND g.name = f.norm",
    "missed_gaps": f"WITH {GOLD_SQL} SELECT DISTINCT session_id, name FROM gold WHERE is_gap AND NOT EXISTS (SELECT 1 FROM flags f WHERE f.session_id = gold.session_id AND f.norm = gold.name)",
    "gold_cover": f"WITH {LOG_SQL} SELECT event_id, event_id % 2 = 1 AS covers FROM log WHERE {ENC}",
    "ngram_contains": "SELECT p_partkey, ends_with(p_name, ' ring') AS found FROM part",
    "interval_locate": f"WITH {UNITS_SQL} SELECT p.key, p.line, arg_min(unit, (CASE WHEN first = line THEN 0 ELSE 1 END) * 1000000000000 + (last - first) * 100000000 + unit) AS unit FROM points p LEFT JOIN units u ON u.key = p.key AND line BETWEEN first AND last GROUP BY p.key, p.line",
    "leave_one_out": f"WITH {LOG_SQL} SELECT event_id, key, value, CASE WHEN count(value) OVER w > 1 THEN (sum(value) OVER w - value) / (count(value) OVER w - 1) END AS others FROM log WINDOW w AS (PARTITION BY key)",
    "seeded_split": f"WITH {LOG_SQL} SELECT event_id, key, row_number() OVER (PARTITION BY key ORDER BY sha256('11:' || event_id), event_id) <= floor(count(*) OVER (PARTITION BY key) * 0.4) AS revealed FROM log",
    "pair_shuffle_flip": f"WITH {LOG_SQL}, f AS (SELECT event_id, key, k, CAST('0x' || left(sha256('5:' || key || ':' || k), 4) AS BIGINT) % 2 = 1 AS flipped FROM log) SELECT event_id, CASE WHEN flipped THEN k ELSE key END AS a, CASE WHEN flipped THEN key ELSE k END AS b, flipped FROM f",
    "job_expansion": "SELECT n_nationkey, r_regionkey AS setting, CAST(r AS INTEGER) AS repeat, s AS swapped FROM nation, region, (VALUES (0, false), (1, false), (2, false), (0, true)) v(r, s)",
    "source_membership": f"WITH {LOG_SQL}, t AS (SELECT DISTINCT k FROM log) SELECT CAST(k AS VARCHAR) AS term, coalesce(nullif(concat_ws(',', CASE WHEN k IN (SELECT k FROM log WHERE {ENC} AND k % 2 = 0) THEN 'seen' END, CASE WHEN k IN (SELECT k FROM log WHERE event_type = 'session_analysed' AND k % 3 = 0) THEN 'asked' END), ''), 'hand') AS sources FROM t",
    "gloss_subquery": f"WITH {LOG_SQL}, {JUDGMENT_SQL}, e AS (SELECT k, arg_max('p' || event_id, event_id) AS gloss, bool_or(coalesce(judgment = 'confirmed', false)) AS confirmed FROM log LEFT JOIN judgments USING (key) WHERE {ENC} GROUP BY k) SELECT k AS concept_id, gloss, confirmed FROM (SELECT DISTINCT k FROM log) LEFT JOIN e USING (k)",
    "spot_check_record": f"WITH {JUDGED_SQL}, {JUDGMENT_SQL} SELECT count(*) AS answered, count(*) FILTER (judgment = 'dismissed') AS known FROM v JOIN judgments ON key = session_id WHERE verdict = 'spot_check' AND judgment IS NOT NULL",
    "guard_depth1": f"WITH {LOG_SQL}, c AS (SELECT key, count(*) FILTER ({ENC}) AS n FROM log GROUP BY key) SELECT key, CASE WHEN key % 5 <> 0 THEN n END AS encounter_count, CASE WHEN key % 5 = 0 OR n = 0 THEN 'never encountered' END AS refused FROM c",
    "ungraded": f"WITH {LOG_SQL}, g AS (SELECT event_id - event_id % 3 AS id, arg_max(CASE WHEN k % 4 <> 0 THEN 'listed' ELSE '' END, event_id) AS l FROM log WHERE event_type = 'session_analysed' GROUP BY ALL) SELECT event_id AS explanation_id FROM log LEFT JOIN g ON id = event_id WHERE {ENC} AND coalesce(l, '') = ''",
    "path_allowlist": f"WITH {LOG_SQL} SELECT event_id, k % 3 = 0 AND k % 4 <> 0 AND k % 2 = 0 AS ok FROM log",
    "concept_units": f"WITH {LOG_SQL} SELECT k AS concept_id, count(*) AS encounters, count(DISTINCT CASE WHEN event_id % 3 <> 0 THEN CAST(key AS VARCHAR) ELSE 'manual-' || event_id END) AS sessions FROM log WHERE {ENC} GROUP BY k",
    "usage_normalise": "SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 7 ELSE event_id % 100 END AS DOUBLE) AS tokens_in, CAST(event_id % 50 AS DOUBLE) AS tokens_out, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END AS cost FROM events",
    "number_coerce": f"WITH {LOG_SQL} SELECT event_id, CASE WHEN k % 4 > 1 THEN CAST(k AS DOUBLE) END AS n FROM log",
    "difficulty_bucket": f"WITH {LOG_SQL}, x AS (SELECT event_id, k % 5 + 1 AS d, key % 4 AS l FROM log) SELECT event_id, CASE WHEN l = 0 THEN 'outside' WHEN d <= l - 1 THEN 'easy' WHEN d = l THEN 'boundary_known' WHEN d = l + 1 THEN 'boundary_unknown' ELSE 'hard' END AS bucket FROM x",
    "question": "SELECT n_nationkey, 'In your own words, what is ' || n_name || ' and why does it matter here?' AS text FROM nation",
    "render_windows": "SELECT conv_id AS session_id, string_agg('[' || (turn + 1) || '] ' || text, chr(10) ORDER BY turn) AS block FROM conversations GROUP BY conv_id",
    "map_fingerprint": """WITH s AS (SELECT CAST(n_regionkey % 2 AS VARCHAR) AS side, string_agg('"' || n_name || '"', ', ' ORDER BY n_name) AS l FROM nation GROUP BY side) SELECT left(sha256('{' || string_agg('"' || side || '": [' || l || ']', ', ' ORDER BY side) || '}'), 16) AS fingerprint FROM s""",
    "backticked": "SELECT n_nationkey, 'a b|' || n_name AS code FROM nation",
    "clean_markdown": "SELECT n_nationkey, 'Head ' || n_name || ' see now item' AS text FROM nation",
    "mean_sd_format": f"WITH {LOG_SQL}, m AS (SELECT key, floor(avg(k)) AS m, floor(CASE WHEN count(*) > 1 THEN stddev_samp(k) END) AS sd FROM log GROUP BY key) SELECT key, CASE WHEN sd IS NULL THEN printf('%.2f', m) ELSE printf('%.2f ± %.2f', m, sd) END AS text FROM m",
    "camel": "SELECT p_partkey, p_partkey % 2 = 0 AS is_camel FROM part",
    "since_string": "SELECT event_id FROM events WHERE strftime(ts, '%Y-%m-%dT%H:%M:%S') >= '2024-01-20'",
    "key_union": f"WITH {SETS_SQL} SELECT * FROM captured UNION SELECT * FROM done",
    "intersect_done": f"WITH {SETS_SQL} SELECT * FROM captured INTERSECT SELECT * FROM done",
    "except_todo": f"WITH {SETS_SQL} SELECT * FROM captured EXCEPT SELECT * FROM done",
}
