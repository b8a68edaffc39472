"""Queries of the matching family. Concepts are the distinct part names with their type in brackets."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import names as N
from colloquy.operators import resolve as R
from colloquy.sources.domain import LOG_SQL, log, table

#: Words whose forms the stemmer has to bring together, and probes of the matcher.
WORDS = tuple("idempotent idempotency caches cache boxes processes types transactional transaction notarisation notarization organised organizing analyse analyzed colour colors centre center catalogue rebase rebasing committed commit client clients status bus class k8s 502 parties abilities running stopped happiness quickly readable visible dependency dependencies blocking locking serverless".split())
PROBES = ("red widgets", "bolt blue", "econmy ring", "small", "rw", "promo-ring vs standard bolt", "s3l", "gadgets (large)", "nothing here", "", "widget handling", "xyz")


def word_rows(s, d):
    own = s.range(1).select(F.explode(F.array(*map(F.lit, WORDS))).alias("word"))
    return own.union(table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("word"))).distinct()


WORDS_SQL = f"words AS (SELECT DISTINCT word FROM (SELECT unnest([{', '.join(repr(w) for w in WORDS)}]) AS word UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part))"


def concepts(s, d):
    p = table(s, d, "part").groupBy("p_name", "p_type").agg(F.count(F.lit(1)).alias("encounter_count"), F.min("p_partkey").alias("concept_id"))
    return p.select("concept_id", F.concat("p_name", F.lit(" ("), F.lower("p_type"), F.lit(")")).alias("canonical_name"), F.array(F.concat(F.upper("p_name"), F.lit("-"), F.lower("p_type"))).alias("aliases"), "encounter_count")


CONCEPTS_SQL = "concepts AS (SELECT min(p_partkey) AS concept_id, p_name || ' (' || lower(p_type) || ')' AS canonical_name, upper(p_name) || '-' || lower(p_type) AS alias, count(*) AS encounter_count FROM part GROUP BY p_name, p_type)"


def submissions(s, d, one_in=1):
    own = s.range(1).select(F.posexplode(F.array(*map(F.lit, PROBES))).alias("submission_id", "text")).withColumn("submission_id", F.col("submission_id").cast("long"))
    named = table(s, d, "part").where(F.col("p_partkey") % one_in == 0).select((F.col("p_partkey") + 1000).alias("submission_id"), F.concat(F.initcap("p_name"), F.lit("  "), F.lower("p_type"), F.lit("!")).alias("text"))
    return own.union(named)


def kits(s, d):
    """The submissions, and a kit of every part, which no concept names."""
    kit = table(s, d, "part").select((F.col("p_partkey") + 10_000_000).alias("submission_id"), F.concat("p_name", F.lit(" kit "), (F.col("p_partkey") % 4).cast("string")).alias("text"))
    return submissions(s, d).unionByName(kit).withColumn("source", F.lit("transcript"))


def files_kits():
    """Kits of an even number are another name of concept 1, what begins with r names a concept that is not there, the rest is undecided."""

    def decide(text: str, offered: list[str]) -> dict:
        if text.endswith((" kit 0", " kit 2")):
            return {"decision": "alias", "concept_id": "1"}
        return {"decision": "existing", "concept_id": "none such"} if text.startswith("r") else {}

    return decide


SUBMISSIONS_SQL = f"""submissions AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{p}')" for k, p in enumerate(PROBES))}) t(submission_id, text)
  UNION ALL SELECT p_partkey + 1000, upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) || '  ' || lower(p_type) || '!' FROM part)"""


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def stem_sql(source: str) -> str:
    """CTEs that stem column word of source into st(word, stem)."""
    spelled = " ".join(f"WHEN word LIKE '%{a}' AND length(word) >= {len(a) + 2} THEN left(word, length(word) - {len(a)}) || '{b}'" for a, b in N.SPELLING)
    ending = f"^(.{{4,}}?)(?:{'|'.join(N.SUFFIXES)})$"
    return f"""s1 AS (SELECT word, CASE {spelled} ELSE word END AS w FROM {source}),
 s2 AS (SELECT word, CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, -3) || 'y' WHEN regexp_matches(w, '(sses|xes|zzes|ches|shes)$') THEN left(w, -2) WHEN w LIKE '%s' AND length(w) > 3 AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, -1) ELSE w END AS w FROM s1),
 s3 AS (SELECT word, regexp_replace(regexp_replace(w, '{ending}', '\\1'), '{ending}', '\\1') AS w FROM s2),
 s4 AS (SELECT word, CASE WHEN w LIKE '%e' AND length(w) > 4 THEN left(w, -1) ELSE w END AS w FROM s3),
 st AS (SELECT word, CASE WHEN regexp_matches(word, '[0-9]') THEN word WHEN length(w) > 4 AND right(w, 1) = substr(w, length(w) - 1, 1) AND regexp_matches(right(w, 1), '[a-z]') AND right(w, 1) NOT IN ('l', 's', 'z') THEN left(w, -1) ELSE w END AS stem FROM s4)"""


VARIANTS_SQL = r"""forms AS (SELECT concept_id, canonical_name, unnest([canonical_name, regexp_replace(canonical_name, '\([^)]*\)', ' ', 'g'), regexp_extract(canonical_name, '\(([^)]*)\)', 1)]) AS form FROM concepts),
 variants AS (SELECT DISTINCT concept_id, trim(regexp_replace(lower(form), '[^a-z0-9]+', ' ', 'g')) AS v FROM forms)"""
GRAMS = "list_distinct(list_transform(range(1, length({0}) + 1), lambda i: substr(' ' || {0} || ' ', i, 3)))"
NAME_STEMS_SQL = f"""{CONCEPTS_SQL}, every AS (SELECT concept_id, canonical_name AS name FROM concepts UNION ALL SELECT concept_id, alias FROM concepts),
 parts AS (SELECT concept_id, unnest([name, regexp_replace(name, '\\([^)]*\\)', ' ', 'g'), regexp_extract(name, '\\(([^)]*)\\)', 1)]) AS form FROM every),
 names AS (SELECT DISTINCT concept_id, unnest(string_split({norm_sql('form')}, ' ')) AS word FROM parts), {stem_sql("(SELECT DISTINCT word FROM names WHERE word <> '')")}"""

QUERIES = {
    "normalise": lambda s, d: table(s, d, "supplier").select("s_suppkey", N.normalise(F.concat(F.lit(" --"), "s_name", F.lit("/(Á) x "))).alias("norm")),
    "name_variants": lambda s, d: concepts(s, d).select("concept_id", F.array_join(F.array_sort(N.variants(F.col("canonical_name"))), "|").alias("variants")),
    "stem": lambda s, d: word_rows(s, d).select("word", N.stem_token(F.col("word")).alias("stem")),
    "tokens": lambda s, d: concepts(s, d).select("concept_id", F.array_join(F.array_sort(N.tokens(N.normalise("canonical_name"))), "|").alias("tokens")),
    "idf_rarity": lambda s, d: R.rarity(concepts(s, d)),
    "char_trigrams": lambda s, d: word_rows(s, d).select("word", F.array_join(F.array_sort(N.grams(F.col("word"))), "|").alias("grams")),
    "trigram_dice": lambda s, d: word_rows(s, d).alias("l").join(word_rows(s, d).alias("r"), (F.col("l.word") < F.col("r.word")) & (F.substring("l.word", 1, 2) == F.substring("r.word", 1, 2))).select(F.col("l.word").alias("a"), F.col("r.word").alias("b"), N.likeness(F.col("l.word"), F.col("r.word")).alias("likeness")),
    "abbreviates": lambda s, d: concepts(s, d).select("concept_id", N.abbreviates(F.lit("swe"), N.normalise("canonical_name")).alias("is_swe"), N.abbreviates(F.lit("s3l"), N.normalise("canonical_name")).alias("is_s3l")),
    "exact_match": lambda s, d: R.exact_match(submissions(s, d), concepts(s, d)),
    "shortlist_topk": lambda s, d: R.shortlist(submissions(s, d, 100), concepts(s, d)),
    "resolve_all": lambda s, d: R.resolve_all(submissions(s, d), concepts(s, d)),
    "resolve_decided": lambda s, d: R.resolve_in_order(kits(s, d), concepts(s, d), files_kits()).select("submission_id", "decision", "concept_id", "canonical_name", "alias", "used_model", "recorded"),
    "resolve_reference": lambda s, d: R.resolve_references(table(s, d, "part").select(F.col("p_partkey").alias("submission_id"), F.col("p_type").alias("text")), concepts(s, d), lambda text, offered: {}).select("submission_id", "decision", "concept_id", "canonical_name", "recorded"),
    "slug_id": lambda s, d: concepts(s, d).select("concept_id", N.slug(F.col("canonical_name")).alias("slug")),
    "fingerprint": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", N.fingerprint(F.col("conv_id"), F.col("turn"), F.col("turn") + 1, F.col("text")).alias("content_id")),
    "spot_check": lambda s, d: table(s, d, "part").select("p_partkey", N.spot_hash(F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))).alias("spot")),
    "ulid_decode": lambda s, d: log(s, d).select("event_id", N.ulid_decode(N.ulid_encode(F.lit(1704067200000) + F.col("event_id") * 977, F.col("key").cast("string"))).alias("ms")),
    "model_of": lambda s, d: table(s, d, "supplier").select("s_suppkey", N.model_of(F.when(F.col("s_suppkey") % 4 == 0, F.col("s_name")).otherwise(F.concat_ws("+", F.lit("detector/3"), "s_name", F.lit("x"), F.lit("p1")))).alias("model")),
    "repo_name": lambda s, d: table(s, d, "pages").select("page_id", N.repo_name(F.regexp_replace("url", r"[?#].*$", "")).alias("repo")),
    "html_strip": lambda s, d: table(s, d, "pages").select("page_id", N.html_strip(F.col("html")).alias("text")),
    "verify_page": lambda s, d: (lambda t: t.withColumn("_at", F.locate("the", F.lower("text"))).where("_at > 0").select("page_id", F.substring("text", F.greatest(F.col("_at") - 260, F.lit(1)), F.lit(800)).alias("excerpt")))(table(s, d, "pages").select("page_id", N.html_strip(F.col("html")).alias("text"))),
    "keyword_grade": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", N.keyword_grade(F.col("text"), ("the", "and", "de la")).alias("level")),
    "name_as_met": lambda s, d: table(s, d, "part").select("p_partkey", N.name_as_met(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  "), F.upper("p_name"))).otherwise(F.concat("p_name", F.lit("  x"))), F.col("p_name")).alias("met")),
    "plural_count": lambda s, d: table(s, d, "nation").select("n_nationkey", N.plural_count(F.col("n_regionkey"), "session").alias("text")),
    "citation_check": lambda s, d: table(s, d, "nation").select("n_nationkey", N.citation_check(F.concat(F.lit("see [S"), F.col("n_regionkey").cast("string"), F.lit("] and [S1]")), F.lit(3)).alias("ok")),
    "list_join": lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("l")).select("n_regionkey", N.list_join(F.col("l")).alias("text")),
    "prose": lambda s, d: table(s, d, "nation").select("n_nationkey", N.prose(F.concat("n_name", F.lit(" ```a\nb``` tail ```open "), "n_name")).alias("text")),
}

IN_ORDER_SQL = f"""every AS (SELECT concept_id, canonical_name, canonical_name AS name FROM concepts UNION ALL SELECT concept_id, canonical_name, alias FROM concepts),
 named AS (SELECT {norm_sql('name')} AS norm, min((canonical_name, concept_id)) AS hit FROM every GROUP BY ALL),
 n AS (SELECT submission_id, trim(text) AS text, {norm_sql('text')} AS norm FROM asked),
 m AS (SELECT n.*, hit, row_number() OVER (PARTITION BY n.norm ORDER BY submission_id) AS place, first_value(submission_id) OVER (PARTITION BY n.norm ORDER BY submission_id) AS maker, first_value(text) OVER (PARTITION BY n.norm ORDER BY submission_id) AS made FROM n LEFT JOIN named ON named.norm = n.norm AND n.norm <> ''),
 r AS (SELECT *, norm <> '' AND (hit IS NOT NULL OR place > 1) AS is_known, CASE WHEN norm = '' THEN submission_id ELSE maker END AS owner, CASE WHEN norm = '' THEN text ELSE made END AS said FROM m),
 x AS (SELECT *, hit IS NULL AND (said LIKE '% kit 0' OR said LIKE '% kit 2') AS filed, left(replace({norm_sql('said')}, ' ', '-'), 48) || '-' || left(sha256({norm_sql('said')} || '|' || owner), 6) AS new_id, (SELECT canonical_name FROM concepts WHERE concept_id = 1) AS one FROM r)
 SELECT submission_id, CASE WHEN is_known THEN 'existing' WHEN filed THEN 'alias' ELSE 'new' END AS decision, CASE WHEN hit IS NOT NULL THEN hit[2]::varchar WHEN filed THEN '1' ELSE new_id END AS concept_id, CASE WHEN hit IS NOT NULL THEN hit[1] WHEN filed THEN one ELSE said END AS canonical_name"""

ORACLE_SQL = {
    "resolve_decided": f"WITH {CONCEPTS_SQL}, {SUBMISSIONS_SQL}, asked AS (SELECT * FROM submissions UNION ALL SELECT p_partkey + 10000000, p_name || ' kit ' || (p_partkey % 4) FROM part), {IN_ORDER_SQL}, CASE WHEN NOT is_known AND filed THEN text END AS alias, NOT is_known AS used_model, true AS recorded FROM x",
    "resolve_reference": f"WITH {CONCEPTS_SQL}, asked AS (SELECT p_partkey AS submission_id, p_type AS text FROM part), {IN_ORDER_SQL}, false AS recorded FROM x",
    "normalise": f"SELECT s_suppkey, {norm_sql(chr(39) + ' --' + chr(39) + ' || s_name || ' + chr(39) + '/(Á) x ' + chr(39))} AS norm FROM supplier",
    "name_variants": f"WITH {CONCEPTS_SQL}, {VARIANTS_SQL} SELECT concept_id, string_agg(v, '|' ORDER BY v) AS variants FROM variants WHERE v <> '' GROUP BY concept_id",
    "stem": f"WITH {WORDS_SQL}, {stem_sql('words')} SELECT word, stem FROM st",
    "tokens": f"WITH {CONCEPTS_SQL}, w AS (SELECT concept_id, unnest(string_split({norm_sql('canonical_name')}, ' ')) AS word FROM concepts), {stem_sql('(SELECT DISTINCT word FROM w)')}, t AS (SELECT DISTINCT concept_id, stem FROM w JOIN st USING (word)) SELECT concept_id, string_agg(stem, '|' ORDER BY stem) AS tokens FROM t GROUP BY concept_id",
    "idf_rarity": f"WITH {NAME_STEMS_SQL} SELECT stem, count(DISTINCT concept_id) AS df, 1 + ln(((SELECT count(*) FROM concepts) + 1) / (count(DISTINCT concept_id) + 1)) AS weight FROM names JOIN st USING (word) GROUP BY stem",
    "char_trigrams": f"WITH {WORDS_SQL} SELECT word, array_to_string(list_sort({GRAMS.format('word')}), '|') AS grams FROM words",
    "trigram_dice": f"""WITH {WORDS_SQL}, g AS (SELECT word, {GRAMS.format('word')} AS gs FROM words), p AS (SELECT a.word AS a, b.word AS b, CASE WHEN least(length(a.word), length(b.word)) < 5 OR regexp_matches(a.word || b.word, '[^a-z]') THEN 0.0 ELSE 2.0 * len(list_intersect(a.gs, b.gs)) / (len(a.gs) + len(b.gs)) END AS dice FROM g a JOIN g b ON a.word < b.word AND left(a.word, 2) = left(b.word, 2))
  SELECT a, b, CAST(CASE WHEN dice >= 0.75 THEN dice ELSE 0 END AS DOUBLE) AS likeness FROM p""",
    "abbreviates": f"""WITH {CONCEPTS_SQL}, n AS (SELECT concept_id, string_split({norm_sql('canonical_name')}, ' ') AS ws FROM concepts)
  SELECT concept_id, array_to_string(list_transform(ws, lambda w: left(w, 1)), '') = 'swe' OR array_to_string(list_transform(ws, lambda w: left(w, 1)), '') = 'sw' AND false AS is_swe,
  len(list_filter(list_append(ws, array_to_string(ws, '')), lambda w: length(w) = 5 AND left(w, 1) = 's' AND right(w, 1) = 'l')) > 0 AS is_s3l FROM n""",
    "exact_match": f"""WITH {CONCEPTS_SQL}, {SUBMISSIONS_SQL}, every AS (SELECT concept_id, canonical_name, canonical_name AS name FROM concepts UNION ALL SELECT concept_id, canonical_name, alias FROM concepts),
  one AS (SELECT {norm_sql('name')} AS norm, arg_min(concept_id, canonical_name) AS concept_id FROM every GROUP BY norm), a AS (SELECT submission_id, text, {norm_sql('text')} AS norm FROM submissions)
  SELECT submission_id, text, norm, concept_id FROM a LEFT JOIN one USING (norm)""",
    "resolve_all": f"""WITH {CONCEPTS_SQL}, {SUBMISSIONS_SQL}, every AS (SELECT concept_id, canonical_name, canonical_name AS name FROM concepts UNION ALL SELECT concept_id, canonical_name, alias FROM concepts),
  one AS (SELECT {norm_sql('name')} AS norm, arg_min(concept_id, canonical_name) AS concept_id FROM every GROUP BY norm), a AS (SELECT submission_id, text, {norm_sql('text')} AS norm FROM submissions),
  j AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY submission_id) AS n FROM a LEFT JOIN one USING (norm))
  SELECT submission_id, text, CASE WHEN norm = '' THEN 'unclear' WHEN concept_id IS NOT NULL OR n > 1 THEN 'existing' ELSE 'new' END AS decision,
  CASE WHEN norm <> '' THEN coalesce(CAST(concept_id AS VARCHAR), left(replace(norm, ' ', '-'), 48) || '-' || left(sha256(norm), 6)) END AS concept_id FROM j""",
    "slug_id": f"WITH {CONCEPTS_SQL} SELECT concept_id, left(replace({norm_sql('canonical_name')}, ' ', '-'), 48) AS slug FROM concepts",
    "fingerprint": f"SELECT conv_id, turn, 'e-' || upper(left(sha256(conv_id || '|' || turn || '|' || (turn + 1) || '|' || {norm_sql('text')}), 26)) AS content_id FROM conversations",
    "spot_check": "SELECT p_partkey, CAST(('0x' || left(sha256(p_name || '#' || p_partkey), 8)) AS BIGINT) % 5 = 0 AS spot FROM part",
    "ulid_decode": "SELECT event_id, 1704067200000 + event_id * 977 AS ms FROM events",
    "model_of": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_name || '+x' END AS model FROM supplier",
    "repo_name": r"SELECT page_id, nullif(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/')[-1], '') AS repo FROM pages",
    "html_strip": r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages",
    "verify_page": r"WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages) SELECT page_id, substr(text, greatest(strpos(lower(text), 'the') - 260, 1), 800) AS excerpt FROM t WHERE strpos(lower(text), 'the') > 0",
    "keyword_grade": r"""WITH t AS (SELECT conv_id, turn, text AS a FROM conversations) SELECT conv_id, turn, CASE WHEN contains(' ' || lower(a) || ' ', ' the ') OR contains(' ' || lower(a) || ' ', ' and ') OR contains(' ' || lower(a) || ' ', ' de la ') THEN 'causal'
  WHEN len(list_filter(regexp_split_to_array(a, '[.;,]'), lambda c: length(trim(c)) > 0)) > 1 OR len(list_filter(regexp_split_to_array(a, '\s+'), lambda w: w <> '')) > 18 THEN 'listed' ELSE 'isolated' END AS level FROM t""",
    "name_as_met": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN p_name || ' x' END AS met FROM part",
    "plural_count": "SELECT n_nationkey, n_regionkey || CASE WHEN n_regionkey = 1 THEN ' session' ELSE ' sessions' END AS text FROM nation",
    "citation_check": "SELECT n_nationkey, n_regionkey BETWEEN 1 AND 3 AS ok FROM nation",
    "list_join": "WITH l AS (SELECT n_regionkey, list_sort(list(n_name)) AS l FROM nation GROUP BY n_regionkey) SELECT n_regionkey, CASE WHEN len(l) <= 1 THEN array_to_string(l, '') ELSE array_to_string(l[:-2], ', ') || ' and ' || l[-1] END AS text FROM l",
    "prose": "SELECT n_nationkey, n_name || '   tail  ' AS text FROM nation",
}
