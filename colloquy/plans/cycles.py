"""Queries of repairs, the grading cycle, regeneration and trial measures."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from colloquy.functions import names as N
from colloquy.operators import fold as D, grading as G, probes as P, regeneration as A, repair as R
from colloquy.operators.dml import USER_ACTOR
from colloquy.plans.exchanges import STRIP, WINDOWS_SQL
from colloquy.plans.folds import JUDGMENT_SQL
from colloquy.plans.graphs_terms import TERMS_SQL, terms_of
from colloquy.plans.naming import norm_sql, stem_sql
from colloquy.sources.domain import LOG_SQL, TURNS_SQL, log, table, turns
from colloquy.state import new_dir

REC = "event_type = 'encounter_recorded'"


def text_of(name: str):
    return F.col(name).cast("string")


def graph_repair(s, d):
    """Dismissals correct the judgment logged just before them: some merge, some split, some cannot be made."""
    e, k = log(s, d), F.col("k")
    before = lambda n: F.concat(F.lit("e"), (F.col("event_id") - n).cast("string"))
    asked = e.where("event_type = 'encounter_dismissed'").select(
        F.col("event_id").alias("origin"), F.concat(F.lit("j"), (F.col("event_id") - 1).cast("string")).alias("target"), F.concat(F.lit("r"), text_of("k")).alias("reasoning"),
        F.when(k % 3 == 0, (k % 7).cast("string")).alias("merge_into"), F.when(k % 3 == 1, before(1)).when(k % 10 == 0, before(2)).alias("split_out"),
    )
    rec = e.where(REC)
    judged = rec.select(F.concat(F.lit("j"), text_of("event_id")).alias("target"), text_of("k").alias("concept_id"), F.when(F.col("event_id") % 2 == 0, "alias").otherwise("existing").alias("decision"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("A"), text_of("k"))).alias("alias"), F.when(k % 5 != 0, F.concat(F.lit(" Term "), text_of("key"))).alias("input_text"))
    met = rec.select(F.concat(F.lit("e"), text_of("event_id")).alias("encounter_id"), text_of("k").alias("at_concept"), F.lit("detector").alias("source"), F.concat(F.lit("p"), text_of("k")).alias("paraphrase"), text_of("key").alias("session_id"), F.col("occurred_at").alias("met_at"), "event_id")
    events, refused = R.correct(asked, judged, met)
    shown = events.select("origin", "event_type", F.array_join(F.transform(F.array_sort(F.map_entries("payload")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("payload"), "supersedes")
    return shown.unionByName(refused.select("origin", F.lit("refused").alias("event_type"), F.col("error").alias("payload"), F.lit(None).cast("string").alias("supersedes")))


NEW_ID = f"left(replace({norm_sql('name')}, ' ', '-'), 48) || '-' || left(sha256(target || name), 6)"
REPAIR_SQL = f"""WITH {LOG_SQL}, rec AS (SELECT * FROM log WHERE {REC}),
 c AS (SELECT event_id AS origin, 'j' || (event_id - 1) AS target, 'r' || k AS reasoning, CASE WHEN k % 3 = 0 THEN CAST(k % 7 AS VARCHAR) END AS merge_into, CASE WHEN k % 3 = 1 THEN 'e' || (event_id - 1) WHEN k % 10 = 0 THEN 'e' || (event_id - 2) END AS split_out FROM log WHERE event_type = 'encounter_dismissed'),
 j AS (SELECT 'j' || event_id AS target, CAST(k AS VARCHAR) AS concept_id, event_id % 2 = 0 AS is_alias, CASE WHEN event_id % 4 = 0 THEN 'A' || k END AS alias, CASE WHEN k % 5 <> 0 THEN 'Term ' || key ELSE 'untitled' END AS name FROM rec),
 m AS (SELECT 'e' || event_id AS split_out, CAST(k AS VARCHAR) AS at_concept, k, key, event_id FROM rec),
 x AS (SELECT *, {NEW_ID} AS new_id, CASE WHEN merge_into IS NOT NULL AND split_out IS NOT NULL THEN 'merge and split' WHEN concept_id IS NULL THEN 'no judgment' WHEN split_out IS NOT NULL AND at_concept IS NULL THEN 'no encounter' WHEN split_out IS NOT NULL AND at_concept <> concept_id THEN 'not under that concept' END AS error FROM c LEFT JOIN j USING (target) LEFT JOIN m USING (split_out)),
 g AS (SELECT * FROM x WHERE error IS NULL)
 SELECT origin, 'refused' AS event_type, error AS payload, CAST(NULL AS VARCHAR) AS supersedes FROM x WHERE error IS NOT NULL
 UNION ALL SELECT origin, 'resolver_judgment_corrected', 'reasoning=' || reasoning || ';target=' || target, target FROM g
 UNION ALL SELECT origin, 'concept_merged', 'from_concept_id=' || concept_id || ';into_concept_id=' || merge_into || ';reasoning=Corrected by hand: ' || reasoning, NULL FROM g WHERE merge_into <> concept_id
 UNION ALL SELECT origin, 'concept_created', 'canonical_name=' || name || ';concept_id=' || new_id, NULL FROM g WHERE split_out IS NOT NULL
 UNION ALL SELECT origin, 'alias_removed', 'alias=' || coalesce(alias, name) || ';concept_id=' || concept_id, NULL FROM g WHERE split_out IS NOT NULL AND is_alias
 UNION ALL SELECT origin, 'encounter_recorded', 'concept_id=' || new_id || ';encounter_id=' || split_out || ';paraphrase=p' || k || ';session_id=' || key || ';source=detector', CAST(event_id AS VARCHAR) FROM g WHERE split_out IS NOT NULL"""


def submitted(s, d):
    answers = log(s, d).select(F.col("event_id").alias("answer_id"), (F.col("k") % 30).alias("concept_id"), F.when(F.col("k") % 5 == 0, "  \n").when(F.col("k") % 7 != 0, F.concat(F.lit(" said "), text_of("k"), F.lit("\t"))).alias("raw_text"), F.when(F.col("event_id") % 2 == 0, "What is it?").alias("prompt_text"))
    return G.submit(answers, table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("concept_id"), F.col("n_name").alias("canonical_name")))


def explained(s, d):
    """User turns as explanations of their conversation's concept, assistant turns as grades of long ago."""
    c = table(s, d, "conversations")
    payload = F.create_map(F.lit("raw_text"), F.coalesce("text", F.lit("")), F.lit("prompt_text"), F.lit("What is it?"), F.lit("concept_id"), text_of("conv_id"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), F.when(F.col("role") == "user", "explanation_submitted").when(F.col("role") == "assistant", "explanation_graded").otherwise("session_analysed").alias("event_type"), payload.alias("payload"))


def said_sql(text: str, words: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(' ' || lower({text}) || ' ', ' {w} ')" for w in words)


LEVEL_SQL = r"""CASE WHEN {1} THEN 'causal' WHEN len(list_filter(regexp_split_to_array({0}, '[.;,]'), lambda c: length(trim(c)) > 0)) > 1 OR len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')) > 18 THEN 'listed' ELSE 'isolated' END"""


def graded(s, d):
    rows = table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", N.keyword_grade(F.coalesce("text", F.lit("")), ("the", "and")).alias("level"))
    return G.history(rows, "conv_id", "turn")


GRADED_SQL = f"t AS (SELECT conv_id, turn, coalesce(text, '') AS a FROM conversations WHERE role = 'user'), g AS (SELECT conv_id, turn, {LEVEL_SQL.format('a', said_sql('a', ('the', 'and')))} AS level FROM t)"


def filed(s, d):
    """Events as rows of a store: a session for each k, an encounter for each key; a grade's record may name none."""
    e = log(s, d)
    kind = F.when(F.col("event_type") == "encounter_judgment_retracted", "familiarity_judged").otherwise(F.col("event_type"))
    return e.select("event_id", kind.alias("event_type"), F.col("k").alias("session_id"), F.when(F.col("event_id") % 4 != 0, F.col("key")).alias("encounter_id"))


def judged(s, d):
    return D.latest_judgment(log(s, d)).where("judgment is not null").select(F.col("key").alias("encounter_id"))


def ranked(s, d):
    """Keys and ks list each other by how often they meet."""
    both = log(s, d).groupBy("key", "k").agg(F.count(F.lit(1)).alias("n"))
    rank = lambda by, other: F.row_number().over(P.Window.partitionBy(by).orderBy(F.desc("n"), other)).cast("long")
    name = lambda c: F.concat(F.lit(f"{c}:"), text_of(c))
    return both.select(name("key").alias("query"), name("k").alias("target"), rank("key", "k").alias("rank")).unionByName(both.select(name("k").alias("query"), name("key").alias("target"), rank("k", "key").alias("rank")))


def parts(s, d):
    return table(s, d, "part")


def chained(s, d):
    return log(s, d).select(F.col("event_type").alias("extractor"), F.col("key").alias("session_id"), (F.col("value") > 100).alias("is_gold"), (F.col("k") % 2 == 0).alias("even"), (F.col("k") % 3 == 0).alias("third"))


def long_answers(s, d):
    """What a detector finds: assistant turns of over 500 characters."""
    said = table(s, d, "conversations").where("role = 'assistant' AND length(text) > 500")
    return said.select(F.col("conv_id").cast("string").alias("session_id"), "turn", F.left("text", F.lit(40)).alias("term"))


def regeneration_resumed(s, d):
    """All conversations in thirds; the run stops after the first one, and another goes on from the ledger."""
    sessions = table(s, d, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    folder, wave = new_dir(s, "regeneration"), sessions.count() // 3 + 1
    work = lambda todo: long_answers(s, d).join(todo, "session_id", "left_semi")
    A.Regeneration(s, folder, "v1").run(sessions, work, wave, most_waves=1)
    again = A.Regeneration(s, folder, "v1")
    again.run(sessions, work, wave)
    terms = again.found().groupBy("session_id").agg(F.min("term").alias("first_term"), F.max("turn").alias("last_turn"))
    return again.ledger().select("session_id", "found").join(terms, "session_id", "left")


def detections_recorded(s, d):
    """Long answers by turn, two of a session emitted; every conversation was examined."""
    every = table(s, d, "conversations")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("turn"))
    ranked = long_answers(s, d).withColumn("rank", place.cast("long")).withColumns({"line_start": F.col("turn"), "line_end": F.col("turn") + 1, "emitted": F.col("rank") <= 2})
    sessions = every.select(F.col("conv_id").cast("string").alias("session_id"))
    windows = sessions.groupBy("session_id").agg(F.count(F.lit(1)).alias("windows_examined"))
    listed = F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["rank"].cast("string"), c["line_start"].cast("string"), F.coalesce(c["encounter_id"], F.lit("-")))), "|")
    return A.record_detection(sessions, windows, ranked).select("session_id", "windows_examined", "candidates_found", "n_emitted", listed.alias("candidates"))


QUERIES = {
    "regeneration_resumed": regeneration_resumed,
    "record_detection": detections_recorded,
    "graph_repair": graph_repair,
    "concept_merges": lambda s, d: R.merge(log(s, d).select(F.col("event_id").alias("origin"), text_of("k").alias("from_concept_id"), F.floor(F.col("k") / 2).cast("string").alias("into_concept_id"), F.lit("same").alias("reasoning"))).select("origin", F.element_at("payload", "from_concept_id").alias("src"), F.element_at("payload", "into_concept_id").alias("dst")),
    "submit_answers": submitted,
    "regrade": lambda s, d: G.regrade(explained(s, d))[1],
    "regrade_delete": lambda s, d: G.regrade(explained(s, d))[0].groupBy("event_type").agg(F.count(F.lit(1)).alias("n")),
    "grade_history": graded,
    "regeneration_plan": lambda s, d: A.plan(filed(s, d).select("session_id"), log(s, d).where("event_type = 'session_analysed'").select(F.col("k").alias("session_id"), F.concat(F.lit("v"), (F.col("event_id") % 9).cast("string")).alias("version")), log(s, d).where(REC).select(F.col("key"), F.col("k").alias("session_id")).join(D.latest_judgment(log(s, d)), "key", "left"), "v1"),
    "regeneration_cleared": lambda s, d: A.cleared(filed(s, d), filed(s, d).where("session_id % 3 = 0").select("session_id"), judged(s, d)).select("event_id"),
    "events_by_actor": lambda s, d: P.by_actor(log(s, d)).groupBy("actor", "event_type").agg(F.count(F.lit(1)).alias("n")),
    "session_shapes": lambda s, d: P.session_shapes(turns(s, d)),
    "old_pairing": lambda s, d: P.old_pairing(turns(s, d)),
    "next_waiting": lambda s, d: P.next_waiting(log(s, d).where(REC).select("key", F.col("k").alias("concept_id"), "event_id").join(D.latest_judgment(log(s, d)), "key", "left")),
    "umbrella_opportunity_rates": lambda s, d: P.opportunity_rates(log(s, d).select(F.col("event_type").alias("source"), (F.col("k") % 5).alias("unit"), F.col("key").alias("session_id")), log(s, d).select(F.col("event_type").alias("source"), F.col("key").alias("session_id"))),
    "shortlist_hit": lambda s, d: P.shortlist_hit(ranked(s, d), log(s, d).select(F.concat(F.lit("key:"), text_of("key")).alias("a"), F.concat(F.lit("k:"), text_of("k")).alias("b")).distinct()),
    "title_state": lambda s, d: P.title_state(parts(s, d).select(F.concat("p_name", F.lit("s")).alias("term")).distinct(), parts(s, d).groupBy("p_name").agg(F.min("p_partkey").alias("k")).select(F.when(F.col("k") % 2 == 0, F.initcap("p_name")).otherwise(F.concat("p_name", F.lit("z"))).alias("title"), F.when(F.col("k") % 4 == 0, "disambiguation").otherwise("article").alias("state"))),
    "in_repo": lambda s, d: P.in_repo(parts(s, d).select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("repo"), F.concat("p_name", F.lit("s")).alias("term")), parts(s, d).where("p_size > 25").select(F.col("p_brand").alias("repo"), F.concat(F.lit("the "), "p_name", F.lit(" of "), F.lower("p_type")).alias("text"))),
    "filter_chains": lambda s, d: P.filter_chains(chained(s, d), {"none": (), "even": ("even",), "both": ("even", "third")}),
    "chunk_terms": lambda s, d: P.contained(table(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text"), terms_of(s, d), "id", "text"),
    "on_list_filter": lambda s, d: P.on_list(parts(s, d).select("p_brand", F.upper("p_name").alias("term")), parts(s, d).where("p_size > 25").select(F.concat("p_name", F.lit(" -")).alias("term")), "p_brand", "term"),
    "group_validate": lambda s, d: P.valid_groups(table(s, d, "supplier").select(F.col("s_nationkey").alias("group_id"), F.col("s_suppkey").alias("place"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit(" "), F.upper("s_name"))).otherwise("none").alias("member")), table(s, d, "supplier").select(F.col("s_name").alias("name"))),
    "truth_rule": lambda s, d: P.truth(log(s, d).select("event_id", "key", (F.col("k") % 10).alias("area"), (F.col("k") % 4).alias("depth")), log(s, d).groupBy("key", (F.col("event_id") % 7).alias("area")).agg(F.max(F.col("k") % 3).alias("level")), "key", "area").select("event_id", "knows"),
    "probe_masks": lambda s, d: P.probe_masks(log(s, d).select(F.col("event_id").alias("item"), (F.col("k") % 10).alias("area"), F.col("key").alias("depth"))),
    "probe_consistency": lambda s, d: P.probe_consistency(log(s, d).select("key", (F.col("k") > 3).alias("correct"), F.lit("x").alias("decision"), F.floor(F.col("k") / 60).alias("target")), "key"),
    "side_by_side": lambda s, d: P.side_by_side(
        log(s, d).where(REC).select((F.col("event_id") % 2).alias("run"), F.col("key").alias("session_id"), F.col("event_id").alias("place"), F.lit("t").alias("term"), F.when(F.col("k") % 2 == 0, "hit").otherwise("known").alias("mark"), F.concat(F.lit("n"), (F.col("k") % 20).cast("string")).alias("name")),
        log(s, d).where("event_type = 'session_analysed'").select(F.col("key").alias("session_id"), F.concat(F.lit("n"), (F.col("k") % 20).cast("string")).alias("name"), (F.col("k") % 2 == 0).alias("is_gap")),
    ),
    "answer_cache": lambda s, d: P.cached(log(s, d).select("event_id", F.concat(F.lit("ask "), text_of("k")).alias("request")), log(s, d).where("k % 3 = 0").select(F.sha2(F.concat(F.lit("ask "), text_of("k")), 256).alias("sha"), F.concat(F.lit("a"), text_of("k")).alias("answer")).distinct(), "request").select("event_id", "held", "answer"),
    "meter_tags": lambda s, d: P.tagged(log(s, d).select("event_id", F.when(F.col("k") % 2 == 0, "live").alias("scope")), scope="trial", run="r1"),
    "secret_mask": lambda s, d: P.secret_status(table(s, d, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "  ").when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("key-"), "s_name")).otherwise("short").alias("value"))),
}

WORDS_OF = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
REPO_GRAMS = " UNION ALL ".join(f"SELECT repo, array_to_string(ss[i:i + {n - 1}], ' ') AS run FROM (SELECT repo, ss, unnest(range(1, len(ss) - {n - 2})) AS i FROM stemmed WHERE len(ss) >= {n})" for n in range(1, 5))

LONG_SQL = "said AS (SELECT conv_id::varchar AS session_id, turn, left(text, 40) AS term FROM conversations WHERE role = 'assistant' AND length(text) > 500)"

ORACLE_SQL = {
    "regeneration_resumed": f"WITH {LONG_SQL} SELECT c.session_id, count(turn) AS found, min(term) AS first_term, max(turn) AS last_turn FROM (SELECT DISTINCT conv_id::varchar AS session_id FROM conversations) c LEFT JOIN said USING (session_id) GROUP BY c.session_id",
    "record_detection": f"""WITH {LONG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS rank FROM said), w AS (SELECT conv_id::varchar AS session_id, count(*) AS windows_examined FROM conversations GROUP BY ALL),
 c AS (SELECT session_id, count(*) AS candidates_found, count(*) FILTER (rank <= 2) AS n_emitted, string_agg(rank || ':' || turn || ':' || CASE WHEN rank <= 2 THEN 'e-' || upper(left(sha256(session_id || '|' || turn || '|' || (turn + 1) || '|' || {norm_sql('term')}), 26)) ELSE '-' END, '|' ORDER BY rank) AS candidates FROM r GROUP BY session_id)
 SELECT session_id, windows_examined, coalesce(candidates_found, 0) AS candidates_found, coalesce(n_emitted, 0) AS n_emitted, coalesce(candidates, '') AS candidates FROM w LEFT JOIN c USING (session_id)""",
    "graph_repair": REPAIR_SQL,
    "concept_merges": f"WITH {LOG_SQL} SELECT event_id AS origin, CAST(k AS VARCHAR) AS src, CAST(k // 2 AS VARCHAR) AS dst FROM log WHERE k <> k // 2",
    "submit_answers": f"""WITH {LOG_SQL}, a AS (SELECT event_id AS answer_id, k % 30 AS concept_id, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN '' ELSE 'said ' || k END AS raw_text, coalesce(CASE WHEN event_id % 2 = 0 THEN 'What is it?' END, 'In your own words, what is ' || n_name || ' and why does it matter here?') AS prompt_text FROM log LEFT JOIN nation ON n_nationkey = k % 30)
 SELECT *, CASE WHEN raw_text = '' THEN 'empty' WHEN prompt_text IS NULL THEN 'no concept' END AS error FROM a""",
    "regrade": "WITH t AS (SELECT conv_id * 1000 + turn AS explanation_id, coalesce(text, '') AS a FROM conversations WHERE role = 'user') SELECT explanation_id, " + LEVEL_SQL.format("a", said_sql("a", N.CONNECTIVES)) + " AS level FROM t",
    "regrade_delete": "SELECT CASE role WHEN 'user' THEN 'explanation_submitted' ELSE 'session_analysed' END AS event_type, count(*) AS n FROM conversations WHERE role <> 'assistant' GROUP BY 1",
    "grade_history": f"WITH {GRADED_SQL} SELECT conv_id, turn, level, row_number() OVER w AS place, list_position(['isolated', 'listed', 'causal'], level) > lag(list_position(['isolated', 'listed', 'causal'], level)) OVER w AS better FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "regeneration_plan": f"""WITH {LOG_SQL}, {JUDGMENT_SQL}, p AS (SELECT k, count(*) AS n FROM log JOIN judgments USING (key) WHERE {REC} AND judgment IS NOT NULL GROUP BY k), d AS (SELECT DISTINCT k FROM log WHERE event_type = 'session_analysed' AND event_id % 9 = 1)
 SELECT s.k AS session_id, CASE WHEN d.k IS NULL THEN 'run' ELSE 'done' END AS status, coalesce(n, 0) AS protected FROM (SELECT DISTINCT k FROM log) s LEFT JOIN d ON d.k IS NOT DISTINCT FROM s.k LEFT JOIN p ON p.k = s.k""",
    "regeneration_cleared": f"""WITH {LOG_SQL}, {JUDGMENT_SQL}, r AS (SELECT event_id, event_type, k, CASE WHEN event_id % 4 <> 0 THEN key END AS enc FROM log)
 SELECT event_id FROM r WHERE NOT coalesce(k % 3 = 0 AND (event_type = 'session_analysed' OR event_type IN ('encounter_recorded', 'encounter_judgment_retracted') AND (enc IS NULL OR enc NOT IN (SELECT key FROM judgments WHERE judgment IS NOT NULL))), false)""",
    "events_by_actor": f"WITH {LOG_SQL} SELECT CASE WHEN event_type IN ({', '.join(repr(x) for x in USER_ACTOR)}) THEN 'user' ELSE 'system' END AS actor, event_type, count(*) AS n FROM log GROUP BY ALL",
    "session_shapes": f"""WITH {WINDOWS_SQL}, c AS (SELECT session_id, count(*) AS turns, count(*) FILTER (role = 'user' AND NOT is_meta) AS human, count(*) FILTER (role = 'assistant') AS assistant, CAST(0 AS BIGINT) AS sidechain FROM turns GROUP BY session_id),
 w AS (SELECT session_id, count(*) AS windows, count(*) FILTER (human_line IS NULL) AS unpaired, max(length(human_text)) AS biggest FROM windows GROUP BY session_id)
 SELECT session_id, turns, human, assistant, sidechain, coalesce(windows, 0) AS windows, coalesce(unpaired, 0) AS unpaired, CAST(coalesce(biggest, 0) AS BIGINT) AS biggest_human FROM c LEFT JOIN w USING (session_id)""",
    "old_pairing": f"WITH {TURNS_SQL} SELECT session_id, line_no AS assistant_line, (SELECT min(h.line_no) FROM turns h WHERE h.session_id = a.session_id AND h.line_no > a.line_no AND h.role = 'user' AND NOT h.is_meta) AS human_line FROM turns a WHERE role = 'assistant'",
    "next_waiting": f"WITH {LOG_SQL}, {JUDGMENT_SQL}, e AS (SELECT k, event_id, judgment FROM log LEFT JOIN judgments USING (key) WHERE {REC}), c AS (SELECT k, max(event_id) AS met, min(CASE WHEN judgment IS NULL THEN event_id END) AS event_id FROM e GROUP BY k) SELECT k AS concept_id, event_id FROM c WHERE event_id IS NOT NULL ORDER BY met DESC, k LIMIT 1",
    "umbrella_opportunity_rates": f"WITH {LOG_SQL}, w AS (SELECT event_type, count(DISTINCT key) AS whole FROM log GROUP BY event_type), u AS (SELECT event_type, k % 5 AS unit, count(*) AS n, count(DISTINCT key) AS sessions FROM log GROUP BY ALL) SELECT event_type AS source, unit, n, sessions, sessions / whole AS rate FROM u JOIN w USING (event_type)",
    "shortlist_hit": f"WITH {LOG_SQL}, b AS (SELECT key, k, count(*) AS n FROM log GROUP BY ALL), r AS (SELECT key, k, row_number() OVER (PARTITION BY key ORDER BY n DESC, k) AS x, row_number() OVER (PARTITION BY k ORDER BY n DESC, key) AS y FROM b) SELECT 'key:' || key AS a, 'k:' || k AS b, nullif(least(CASE WHEN x <= 12 THEN x ELSE 99 END, CASE WHEN y <= 12 THEN y ELSE 99 END), 99) AS rank FROM r",
    "title_state": """WITH p AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name), t AS (SELECT p_name, upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS cap, k FROM p)
 SELECT p_name || 's' AS term, CASE WHEN k % 2 <> 0 THEN 'missing' WHEN k % 4 = 0 THEN 'disambiguation' ELSE 'article' END AS state FROM t""",
    "in_repo": f"""WITH texts AS (SELECT row_number() OVER () AS r, p_brand AS repo, {WORDS_OF.format("'the ' || p_name || ' of ' || lower(p_type)")} AS ws FROM part WHERE p_size > 25), asked AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS repo, p_name || 's' AS term, {WORDS_OF.format("p_name || 's'")} AS ws FROM part),
 words AS (SELECT DISTINCT unnest(ws) AS word FROM (SELECT ws FROM texts UNION ALL SELECT ws FROM asked)), {stem_sql('words')}, tw AS (SELECT r, repo, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM texts), aw AS (SELECT id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM asked),
 stemmed AS (SELECT r, any_value(repo) AS repo, list(stem ORDER BY i) AS ss FROM tw JOIN st USING (word) GROUP BY r), runs AS (SELECT DISTINCT repo, run FROM ({REPO_GRAMS})), q AS (SELECT id, string_agg(stem, ' ' ORDER BY i) AS run FROM aw JOIN st USING (word) GROUP BY id)
 SELECT a.id, a.repo, a.term, CASE WHEN a.repo IS NOT NULL THEN r.run IS NOT NULL END AS in_repo FROM asked a JOIN q USING (id) LEFT JOIN runs r ON r.repo = a.repo AND r.run = q.run""",
    "filter_chains": f"""WITH {LOG_SQL}, c AS (SELECT event_type AS extractor, key, value > 100 AS gold, unnest(['none', 'even', 'both']) AS chain, unnest([true, k % 2 = 0, k % 2 = 0 AND k % 3 = 0]) AS kept FROM log)
 SELECT extractor, chain, count(*) FILTER (kept) AS kept, count(*) FILTER (kept AND gold) / nullif(count(*) FILTER (gold), 0) AS recall, count(*) FILTER (kept) / nullif(count(DISTINCT CASE WHEN kept THEN key END), 0) AS mean_size FROM c GROUP BY ALL""",
    "chunk_terms": f"WITH {TERMS_SQL} SELECT conv_id * 100 + turn AS id, term FROM conversations JOIN terms ON contains(lower(text), lower(term))",
    "on_list_filter": f"WITH l AS (SELECT DISTINCT {norm_sql('p_name')} AS n FROM part WHERE p_size > 25) SELECT p_brand, count(l.n) AS kept, count(*) - count(l.n) AS off_list FROM part LEFT JOIN l ON l.n = {norm_sql('p_name')} GROUP BY p_brand",
    "group_validate": "WITH g AS (SELECT s_nationkey AS group_id, list(s_name ORDER BY s_suppkey) AS m FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY s_nationkey) SELECT group_id, array_to_string(m[:8], '|') AS members, len(m) AS n_members FROM g WHERE len(m) >= 3",
    "truth_rule": f"WITH {LOG_SQL}, l AS (SELECT key, event_id % 7 AS area, max(k % 3) AS level FROM log GROUP BY ALL) SELECT event_id, k % 4 <= coalesce(level, 0) AS knows FROM log LEFT JOIN l ON l.key = log.key AND l.area = k % 10",
    "probe_masks": f"WITH {LOG_SQL}, n AS (SELECT k % 10 AS area, key AS depth, count(*) AS n FROM log GROUP BY ALL), h AS (SELECT a.area, a.depth, sum(b.n) AS hidden FROM n a JOIN n b ON a.area = b.area AND b.depth >= a.depth GROUP BY ALL) SELECT event_id AS item, (SELECT count(*) FROM log) - 1 AS others, CAST((SELECT count(*) FROM log) - hidden AS BIGINT) AS not_deeper FROM log JOIN h ON h.area = k % 10 AND h.depth = key",
    "probe_consistency": f"WITH {LOG_SQL} SELECT key, bool_and(k > 3) AS all_correct, count(DISTINCT k // 60) = 1 AS one_answer FROM log GROUP BY key",
    "side_by_side": f"""WITH {LOG_SQL}, f AS (SELECT event_id % 2 AS run, key AS session_id, string_agg(CASE WHEN k % 2 = 0 THEN 'hit' ELSE 'known' END, ',' ORDER BY event_id) AS marks, list('n' || (k % 20)) AS hit FROM log WHERE {REC} GROUP BY ALL),
 g AS (SELECT key AS session_id, list(DISTINCT 'n' || (k % 20)) AS gaps FROM log WHERE event_type = 'session_analysed' AND k % 2 = 0 GROUP BY key)
 SELECT run, session_id, marks, coalesce(array_to_string(list_sort(list_filter(gaps, lambda x: NOT list_contains(hit, x))), ','), '') AS missed FROM f LEFT JOIN g USING (session_id)""",
    "answer_cache": f"WITH {LOG_SQL} SELECT event_id, k % 3 = 0 AS held, CASE WHEN k % 3 = 0 THEN 'a' || k END AS answer FROM log",
    "meter_tags": f"WITH {LOG_SQL} SELECT event_id, CASE WHEN k % 2 = 0 THEN 'live' ELSE 'trial' END AS scope, 'r1' AS run FROM log",
    "secret_mask": "SELECT s_name AS name, s_suppkey % 3 <> 0 AS is_set, CASE WHEN s_suppkey % 3 = 1 THEN '...' || right(s_name, 4) END AS hint FROM supplier",
}
