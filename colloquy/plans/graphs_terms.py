"""Queries of graphs and terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import graph as G, terms as T
from colloquy.plans.naming import stem_sql
from colloquy.sources.domain import LOG_SQL, log, table


def merges(s, d):
    """Customers merge into a lower one of their nation, some in small cycles."""
    return table(s, d, "customer").select(F.col("c_custkey").alias("src"), F.when(F.col("c_custkey") % 50 == 1, F.col("c_custkey") + 1).when(F.col("c_custkey") % 50 == 2, F.col("c_custkey") - 1).otherwise(F.floor(F.col("c_custkey") / 2)).alias("dst"))


MERGES_SQL = "merges AS (SELECT c_custkey AS src, CASE c_custkey % 50 WHEN 1 THEN c_custkey + 1 WHEN 2 THEN c_custkey - 1 ELSE c_custkey // 2 END AS dst FROM customer)"


def edges(s, d):
    """Every order links its customer with another of the same twenty."""
    return table(s, d, "orders").select(F.col("o_custkey").alias("a"), (F.floor(F.col("o_custkey") / 20) * 20 + F.pmod(F.col("o_orderkey") * F.col("o_custkey"), F.lit(20))).alias("b"))


EDGES_SQL = "edges AS (SELECT o_custkey AS a, o_custkey // 20 * 20 + (o_orderkey * o_custkey) % 20 AS b FROM orders)"


def small_edges(s, d):
    return log(s, d).select((F.col("key") % 60).alias("a"), (F.col("k") % 60).alias("b")).where("a % 2 <> b % 3")


SMALL_SQL = f"{LOG_SQL}, edges AS (SELECT DISTINCT least(key % 60, k % 60) AS a, greatest(key % 60, k % 60) AS b FROM log WHERE (key % 60) % 2 <> (k % 60) % 3 AND key % 60 <> k % 60)"


def short_texts(s, d):
    return table(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")


WS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
STOP_RE = "|".join(T.STOP)
PHRASES_SQL = f"""texts AS (SELECT conv_id * 100 + turn AS id, text FROM conversations), sentences AS (SELECT id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9 ]+')) AS s FROM texts),
 runs AS (SELECT id, unnest(string_split(array_to_string(list_transform(list_filter(regexp_split_to_array(s, ' +'), lambda w: w <> ''), lambda w: CASE WHEN w IN ({', '.join(repr(x) for x in T.STOP)}) THEN '|' ELSE w END), ' '), '|')) AS p FROM sentences),
 phrases AS (SELECT id, trim(p) AS phrase FROM runs WHERE trim(p) <> '' AND len(string_split(trim(p), ' ')) <= 4)"""
GRAM_SQL = " UNION ALL ".join(f"SELECT id, array_to_string(ws[i:i + {n - 1}], ' ') AS run FROM (SELECT id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w WHERE len(ws) >= {n})" for n in range(1, 5))


def terms_of(s, d):
    """Phrases of the benchmark's texts and a few of stop words."""
    own = s.range(1).select(F.explode(F.array(*map(F.lit, ("that", "the of", "is the", "en la", "Der Die", "de la", "nothing at all", "with the")))).alias("term"))
    return own.union(T.phrases(table(s, d, "benchmark"), "item_id", "text").select(F.col("phrase").alias("term"))).distinct()


TERMS_SQL = f"""bs AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9 ]+')) AS s FROM benchmark),
 br AS (SELECT unnest(string_split(array_to_string(list_transform(list_filter(regexp_split_to_array(s, ' +'), lambda w: w <> ''), lambda w: CASE WHEN w IN ({', '.join(repr(x) for x in T.STOP)}) THEN '|' ELSE w END), ' '), '|')) AS p FROM bs),
 terms AS (SELECT unnest(['that', 'the of', 'is the', 'en la', 'Der Die', 'de la', 'nothing at all', 'with the']) AS term UNION SELECT trim(p) FROM br WHERE trim(p) <> '' AND len(string_split(trim(p), ' ')) <= 4)"""

def unit_items(s, d):
    """What a user did, as terms: a unit is a kind of event of one user in one week."""
    return log(s, d).select(F.col("event_type").alias("source"), F.col("key").alias("session_id"), F.weekofyear("occurred_at").cast("long").alias("unit"), F.concat(F.when(F.col("event_id") % 2 == 0, "T").otherwise("t"), (F.col("k") % 23).cast("string")).alias("term"))


def verdicts(s, d):
    """Verdicts on pairs of terms that some unit holds; some are missing."""
    terms = unit_items(s, d).select(F.lower("term").alias("t")).distinct()
    x, y = (F.substring(c, 2, 9).cast("long") for c in ("a", "b"))
    low, high = F.least(x, y), F.greatest(x, y)
    said = F.when((low * 7 + high) % 11 == 0, "identity").when((low + high) % 6 == 0, "related").when((low + high) % 13 == 0, "a_extends_b").when(low % 4 != 0, "unrelated")
    return G.pairs(terms.withColumn("one", F.lit(1)), "one", "t").select("a", "b", said.alias("verdict"))


UNIT = ["source", "session_id", "unit"]

QUERIES = {
    "umbrella_units": lambda s, d: G.unit_graphs(unit_items(s, d).withColumn("term", F.lower("term")), UNIT, "term", verdicts(s, d)),
    "umbrella_rates": lambda s, d: G.umbrella_rates(G.unit_graphs(unit_items(s, d).withColumn("term", F.lower("term")), UNIT, "term", verdicts(s, d)), "source", "session_id"),
    "umbrella_unjudged": lambda s, d: G.unjudged(unit_items(s, d), UNIT, "term", verdicts(s, d)),
    "merge_chain": lambda s, d: G.merge_chain(merges(s, d)),
    "components": lambda s, d: G.components(edges(s, d)),
    "component_sizes": lambda s, d: G.component_sizes(G.components(edges(s, d))),
    "triangles": lambda s, d: G.triangles(small_edges(s, d)),
    "relation_verdict": lambda s, d: log(s, d).select("event_id", G.relation(F.col("k") % 2 == 0, F.col("k") % 3 == 0, F.col("k") % 5 == 0).alias("verdict"), G.unswap(G.relation(F.col("k") % 2 == 0, F.col("k") % 3 == 0, F.col("k") % 5 == 0)).alias("swapped")),
    "pair_generation": lambda s, d: G.pairs(log(s, d), "key", "k"),
    "umbrella_pick": lambda s, d: G.round_robin(log(s, d).select("event_id", "key"), "key", ["event_id"], 200).select("event_id", "key", "depth"),
    "ngrams": lambda s, d: short_texts(s, d).select("id", F.explode(T.ngrams(T.clean_words(F.col("text")))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n")),
    "rake": lambda s, d: T.rake(short_texts(s, d), "id", "text"),
    "c_value": lambda s, d: T.c_value(short_texts(s, d), "id", "text"),
    "mentions_exact": lambda s, d: T.mentions(terms_of(s, d), short_texts(s, d), "id", "text"),
    "persistence_summary": lambda s, d: T.persistence(T.mentions(terms_of(s, d), short_texts(s, d), "id", "text"), terms_of(s, d), "id"),
    "mention_matrix": lambda s, d: T.mention_matrix(terms_of(s, d), table(s, d, "documents"), "doc_id", "source", "text"),
    "passages": lambda s, d: T.passages(table(s, d, "benchmark"), table(s, d, "documents"), "item_id", "doc_id"),
    "clean_term": lambda s, d: table(s, d, "part").select("p_partkey", T.clean_term(F.concat(F.when(F.col("p_partkey") % 2 == 0, " The a ").otherwise("x"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name")))).alias("clean")),
    "code_shape": lambda s, d: table(s, d, "part").select("p_partkey", T.code_shape(F.when(F.col("p_partkey") % 3 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).when(F.col("p_partkey") % 3 == 1, F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))).otherwise(F.col("p_name"))).alias("is_code")),
    "title_variants": lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(T.title_variants(F.concat("p_name", F.lit("s"))), "|").alias("variants")),
    "surface_dedupe": lambda s, d: T.first_spelling(table(s, d, "part").withColumn("t", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))), "t", "p_partkey"),
    "rarity_min": lambda s, d: T.rarity_min(table(s, d, "part").select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("term")).distinct(), table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.log10(F.count(F.lit(1))).alias("zipf")).where("zipf > 2.4")),
    "unit_union": lambda s, d: T.unit_union(log(s, d).select("key", "event_id", F.array(F.col("k"), F.col("k") % 7, F.col("k")).alias("items")), "key", "event_id", "items"),
}

MATRIX_SQL = f"""WITH {TERMS_SQL}, docs AS (SELECT doc_id AS id, source AS unit, doc_id <> min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS copy, {WS.format('text')} AS ws FROM documents),
 asked AS (SELECT term, {WS.format('term')} AS ws FROM terms),
 words AS (SELECT DISTINCT unnest(ws) AS word FROM (SELECT ws FROM docs UNION ALL SELECT ws FROM asked)), {stem_sql('words')},
 dp AS (SELECT id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM docs), ds AS (SELECT id, list(stem ORDER BY p) AS ws FROM dp JOIN st USING (word) GROUP BY id),
 ap AS (SELECT term, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM asked), ta AS (SELECT term, list(stem ORDER BY p) AS ws FROM ap JOIN st USING (word) GROUP BY term),
 seqs AS (SELECT 'exact' AS form, id, ws FROM docs UNION ALL SELECT 'stem', id, ws FROM ds), want AS (SELECT 'exact' AS form, term, ws FROM asked UNION ALL SELECT 'stem', term, ws FROM ta),
 runs AS (SELECT DISTINCT form, id, array_to_string(ws[i:i + n - 1], ' ') AS run FROM (SELECT form, id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM seqs, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(ws) >= n)),
 hits AS (SELECT DISTINCT w.term, r.form, r.id, unit, copy FROM want w JOIN runs r ON r.form = w.form AND r.run = array_to_string(w.ws, ' ') JOIN docs USING (id))
 SELECT term, {', '.join(f"count(*) FILTER (form = '{form}'{extra}) AS mentions_{form}{name}, count(DISTINCT unit) FILTER (form = '{form}'{extra}) AS units_{form}{name}" for form in ('exact', 'stem') for name, extra in (('', ''), ('_dedup', ' AND NOT copy')))} FROM (SELECT DISTINCT term FROM terms) LEFT JOIN hits USING (term) GROUP BY term"""

ITEMS_SQL = f"""{LOG_SQL}, items AS (SELECT DISTINCT event_type AS source, key AS session_id, weekofyear(occurred_at) AS unit, k % 23 AS t FROM log),
 pr AS (SELECT a.source || '|' || a.session_id || '|' || a.unit AS u, a.t AS a, b.t AS b, CASE WHEN (a.t * 7 + b.t) % 11 = 0 THEN 'identity' WHEN (a.t + b.t) % 6 = 0 OR (a.t + b.t) % 13 = 0 THEN 'related' WHEN a.t % 4 <> 0 THEN 'unrelated' END AS v FROM items a JOIN items b ON a.source = b.source AND a.session_id = b.session_id AND a.unit = b.unit AND a.t < b.t)"""
UNITS_SQL = f"""{ITEMS_SQL}, n AS (SELECT source || '|' || session_id || '|' || unit AS u, * FROM items), same AS (SELECT u, a, b FROM pr WHERE v = 'identity' UNION SELECT u, b, a FROM pr WHERE v = 'identity'),
 r1 AS (SELECT u, t AS node, t AS r FROM n UNION SELECT r1.u, same.b, r1.r FROM r1 JOIN same ON same.u = r1.u AND same.a = r1.node), lab AS (SELECT u, node, min(r) AS c FROM r1 GROUP BY ALL),
 e AS (SELECT DISTINCT pr.u, x.c AS a, y.c AS b FROM pr JOIN lab x ON x.u = pr.u AND x.node = a JOIN lab y ON y.u = pr.u AND y.node = b WHERE v = 'related' AND x.c <> y.c), e2 AS (SELECT u, a, b FROM e UNION SELECT u, b, a FROM e),
 r2 AS (SELECT u, a AS node, a AS r FROM e2 UNION SELECT r2.u, e2.b, r2.r FROM r2 JOIN e2 ON e2.u = r2.u AND e2.a = r2.node), g AS (SELECT u, c, count(*) AS size FROM (SELECT u, node, min(r) AS c FROM r2 GROUP BY ALL) GROUP BY ALL),
 cl AS (SELECT u, count(*) AS clusters FROM g WHERE size >= 3 GROUP BY u), tri AS (SELECT DISTINCT p.u FROM e2 p JOIN e2 q ON q.u = p.u AND q.a = p.b JOIN e2 z ON z.u = p.u AND z.a = p.a AND z.b = q.b WHERE p.a < p.b AND p.b < q.b),
 units AS (SELECT source, session_id, unit, count(*) AS n_terms, count(DISTINCT c) AS distinct_concepts, count(*) - count(DISTINCT c) AS identity_merges, coalesce(any_value(clusters), 0) AS clusters, coalesce(any_value(clusters), 0) > 0 AS connected, bool_or(tri.u IS NOT NULL) AS clique
  FROM n JOIN lab ON lab.u = n.u AND lab.node = n.t LEFT JOIN cl ON cl.u = n.u LEFT JOIN tri ON tri.u = n.u GROUP BY ALL)"""

ORACLE_SQL = {
    "umbrella_units": f"WITH RECURSIVE {UNITS_SQL} SELECT * FROM units",
    "umbrella_rates": f"WITH RECURSIVE {UNITS_SQL} SELECT source, count(*) AS units_total, count(*) FILTER (n_terms >= 3) AS units_with_3plus, count(*) FILTER (n_terms >= 3 AND connected) AS connected, count(*) FILTER (n_terms >= 3 AND clique) AS clique, count(DISTINCT session_id) FILTER (n_terms >= 3 AND connected) AS sessions_with_connected FROM units GROUP BY source",
    "umbrella_unjudged": f"WITH {ITEMS_SQL} SELECT DISTINCT least('t' || a, 't' || b) AS a, greatest('t' || a, 't' || b) AS b FROM pr WHERE v IS NULL",
    "mention_matrix": MATRIX_SQL,
    "merge_chain": f"""WITH RECURSIVE {MERGES_SQL}, walk AS (SELECT src, dst, [src] AS seen FROM merges UNION ALL SELECT w.src, m.dst, list_append(w.seen, w.dst) FROM walk w JOIN merges m ON m.src = w.dst WHERE NOT list_contains(w.seen, w.dst))
  SELECT src, arg_max(dst, len(seen)) AS dst FROM walk GROUP BY src""",
    "components": f"WITH RECURSIVE {EDGES_SQL}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT a AS node, a AS r FROM both_ways WHERE a IN (SELECT a FROM both_ways WHERE a <> b) UNION SELECT t.b, reach.r FROM reach JOIN both_ways t ON t.a = reach.node WHERE reach.r <= t.b) SELECT node, min(r) AS component FROM reach GROUP BY node",
    "component_sizes": f"WITH RECURSIVE {EDGES_SQL}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT a AS node, a AS r FROM both_ways WHERE a IN (SELECT a FROM both_ways WHERE a <> b) UNION SELECT t.b, reach.r FROM reach JOIN both_ways t ON t.a = reach.node), c AS (SELECT node, min(r) AS component FROM reach GROUP BY node) SELECT component, count(*) AS size FROM c GROUP BY component HAVING count(*) >= 3",
    "triangles": f"WITH {SMALL_SQL} SELECT x.a, x.b, y.b AS c FROM edges x JOIN edges y ON y.a = x.b JOIN edges z ON z.a = x.a AND z.b = y.b",
    "relation_verdict": f"""WITH {LOG_SQL} SELECT event_id, CASE WHEN k % 15 = 0 THEN 'same' WHEN k % 3 = 0 THEN 'narrower' WHEN k % 5 = 0 THEN 'broader' WHEN k % 2 = 0 THEN 'related' ELSE 'unrelated' END AS verdict,
  CASE WHEN k % 15 = 0 THEN 'same' WHEN k % 3 = 0 THEN 'broader' WHEN k % 5 = 0 THEN 'narrower' WHEN k % 2 = 0 THEN 'related' ELSE 'unrelated' END AS swapped FROM log""",
    "pair_generation": f"WITH {LOG_SQL}, i AS (SELECT DISTINCT key, k FROM log) SELECT a.key, a.k AS a, b.k AS b FROM i a JOIN i b ON a.key = b.key AND a.k < b.k",
    "umbrella_pick": f"WITH {LOG_SQL}, n AS (SELECT event_id, key, row_number() OVER (PARTITION BY key ORDER BY event_id) AS depth FROM log) SELECT * FROM n ORDER BY depth, key LIMIT 200",
    "ngrams": f"WITH w AS (SELECT conv_id * 100 + turn AS id, {WS.format('text')} AS ws FROM conversations), g AS ({GRAM_SQL}) SELECT run, count(*) AS n FROM g GROUP BY run",
    "rake": f"WITH {PHRASES_SQL}, words AS (SELECT id, phrase, unnest(string_split(phrase, ' ')) AS w, len(string_split(phrase, ' ')) AS n FROM phrases), score AS (SELECT id, w, sum(n) / count(*) AS score FROM words GROUP BY ALL), d AS (SELECT id, phrase, unnest(string_split(phrase, ' ')) AS w FROM (SELECT DISTINCT * FROM phrases)) SELECT id, phrase, sum(score) AS score FROM d JOIN score USING (id, w) GROUP BY id, phrase",
    "c_value": f"""WITH {PHRASES_SQL}, f AS (SELECT phrase, count(*) AS f, len(string_split(phrase, ' ')) AS n FROM phrases GROUP BY phrase), nested AS (SELECT a.phrase, avg(b.f) AS mean FROM f a JOIN f b ON b.n > a.n AND contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' ') GROUP BY a.phrase)
  SELECT phrase, f, log2(n + 1.0) * (f - coalesce(mean, 0)) AS c_value FROM f LEFT JOIN nested USING (phrase)""",
    "mentions_exact": f"WITH {TERMS_SQL}, w AS (SELECT conv_id * 100 + turn AS id, {WS.format('text')} AS ws FROM conversations), g AS ({GRAM_SQL}) SELECT term, id, count(*) AS n FROM g JOIN terms ON run = lower(term) GROUP BY ALL",
    "persistence_summary": f"WITH {TERMS_SQL}, w AS (SELECT conv_id * 100 + turn AS id, {WS.format('text')} AS ws FROM conversations), g AS ({GRAM_SQL}), u AS (SELECT term, count(DISTINCT id) AS units FROM terms LEFT JOIN g ON run = lower(term) GROUP BY term) SELECT count(*) FILTER (units >= 2) AS persistent, count(*) FILTER (units = 0) AS never, count(*) AS terms FROM u",
    "passages": f"""WITH a AS (SELECT item_id, {WS.format('text')} AS ws FROM benchmark), b AS (SELECT doc_id, {WS.format('text')} AS ws FROM documents), ra AS (SELECT DISTINCT item_id, ws[i:i + 7] AS r FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM a)), rb AS (SELECT DISTINCT doc_id, ws[i:i + 7] AS r FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM b))
  SELECT item_id, doc_id, count(*) AS shared FROM ra JOIN rb USING (r) GROUP BY ALL""",
    "clean_term": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 3 <> 0 THEN lower(p_name) END WHEN p_partkey % 3 <> 0 THEN 'x' || lower(p_name) END AS clean FROM part",
    "code_shape": "SELECT p_partkey, p_partkey % 3 < 2 AS is_code FROM part",
    "title_variants": "SELECT p_partkey, p_name || 's|' || p_name || '|' || t || 's|' || t AS variants FROM (SELECT p_partkey, p_name, upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS t FROM part)",
    "surface_dedupe": "SELECT lower(p_name) AS norm, arg_min(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, p_partkey) AS spelling, count(*) AS n FROM part GROUP BY lower(p_name)",
    "rarity_min": "WITH freq AS (SELECT word, log10(count(*)) AS zipf FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word HAVING log10(count(*)) > 2.4), t AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS term FROM part), w AS (SELECT term, unnest(string_split(term, ' ')) AS word FROM t) SELECT term, coalesce(min(zipf), 8.0) AS rarity FROM w LEFT JOIN freq USING (word) GROUP BY term",
    "unit_union": f"WITH {LOG_SQL}, x AS (SELECT key, event_id, unnest([k, k % 7, k]) AS item, unnest([0, 1, 2]) AS p FROM log), f AS (SELECT key, item, min(event_id * 10 + p) AS first FROM x GROUP BY ALL) SELECT key, item, row_number() OVER (PARTITION BY key ORDER BY first) AS place FROM f",
}
