"""Measures of trial runs: shapes of sessions, filters, probes, marks side by side, memoised answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions import names as N
from colloquy.operators import exchange as X, terms as T
from colloquy.operators.dml import USER_ACTOR
from colloquy.state import cut, small

#: Best first.
TITLE_STATES = ("article", "disambiguation", "missing")


def by_actor(log: DataFrame) -> DataFrame:
    """Adds actor: user for what a person said, system for what is derived."""
    return log.withColumn("actor", F.when(F.col("event_type").isin(*USER_ACTOR), "user").otherwise("system"))


def session_shapes(turns: DataFrame) -> DataFrame:
    """Per session: its turns by kind, its exchanges, how many had no reply, and the longest reply."""
    human = (F.col("role") == "user") & ~F.col("is_meta") & ~F.col("is_sidechain") & (F.col("seq") == 0)
    counts = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(human).alias("human"), F.count_if(F.col("role") == "assistant").alias("assistant"), F.count_if("is_sidechain").alias("sidechain"))
    pairs = X.exchanges(turns).groupBy("session_id").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("human_line").isNull()).alias("unpaired"), F.max(F.length("human_text")).cast("long").alias("biggest_human"))
    none = F.lit(0).cast("long")
    return counts.join(pairs, "session_id", "left").select("session_id", "turns", "human", "assistant", "sidechain", *[F.coalesce(c, none).alias(c) for c in ("windows", "unpaired", "biggest_human")])


def old_pairing(turns: DataFrame) -> DataFrame:
    """The earlier pairing: each assistant line with the next user line that is no meta line, whatever stands between."""
    w = Window.partitionBy("session_id").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    follows = F.first(F.when((F.col("role") == "user") & ~F.col("is_meta"), F.col("line_no")), ignorenulls=True).over(w)
    return turns.withColumn("human_line", follows).where("role = 'assistant'").select("session_id", F.col("line_no").alias("assistant_line"), "human_line")


def next_waiting(encounters: DataFrame) -> DataFrame:
    """The first unjudged encounter of the concept that was met last. encounters: concept_id, event_id, judgment."""
    open_ = encounters.groupBy("concept_id").agg(F.max("event_id").alias("met"), F.min(F.when(F.col("judgment").isNull(), F.col("event_id"))).alias("event_id")).where("event_id is not null")
    return open_.orderBy(F.desc("met"), "concept_id").limit(1).select("concept_id", "event_id")


def opportunity_rates(units: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per source and unit: occurrences, distinct sessions, and their share of the source's sessions.

    units: source, unit, session_id; sessions: source, session_id (also those that hold no unit).
    """
    whole = sessions.groupBy("source").agg(F.countDistinct("session_id").alias("whole"))
    found = units.groupBy("source", "unit").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions"))
    return found.join(whole, "source").select("source", "unit", "n", "sessions", (F.col("sessions") / F.col("whole")).alias("rate"))


def shortlist_hit(ranked: DataFrame, pairs: DataFrame, most: int = 12) -> DataFrame:
    """The better rank of each pair's either side in the other's list, null if neither is within most.

    ranked: query, target, rank; pairs: a, b.
    """
    near = ranked.where(F.col("rank") <= most)
    there = near.select(F.col("query").alias("a"), F.col("target").alias("b"), F.col("rank").alias("there"))
    back = near.select(F.col("query").alias("b"), F.col("target").alias("a"), F.col("rank").alias("back"))
    return pairs.join(there, ["a", "b"], "left").join(back, ["a", "b"], "left").select("a", "b", F.least("there", "back").alias("rank"))


def title_state(terms: DataFrame, titles: DataFrame) -> DataFrame:
    """The best state of any spelling of a term among titles; missing if none is there. titles: title, state."""
    order = F.array(*map(F.lit, TITLE_STATES))
    spelled = terms.select("term", F.explode(T.title_variants(F.col("term"))).alias("title"))
    best = spelled.join(titles, "title", "left").groupBy("term").agg(F.min(F.array_position(order, F.coalesce("state", F.lit(TITLE_STATES[-1])))).alias("at"))
    return best.select("term", F.element_at(order, F.col("at").cast("int")).alias("state"))


def in_repo(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """Whether a term's stems stand in a run in its repository's texts; null without one. terms: id, repo, term; texts: repo, text."""
    # stems are made once a distinct term and text of a repository, and written, as every lookup reads them
    asked = cut(terms.where("repo is not null").select("repo", "term").distinct().withColumn("ws", T.stems(F.col("term"))), "asked-terms")
    said = texts.where("repo is not null").select("repo", "text").distinct().select("repo", T.stems(F.col("text")).alias("ws"))
    found = T.matched(asked, said, [], ("repo",)).distinct().withColumn("found", F.lit(True))
    there = asked.withColumn("run", F.array_join("ws", " ")).join(found, ["repo", "run"], "left_semi").select("repo", "term").withColumn("found", F.lit(True))
    return terms.join(small(cut(there, "found-terms")), ["repo", "term"], "left").select("id", "repo", "term", F.when(F.col("repo").isNotNull(), F.coalesce("found", F.lit(False))).alias("in_repo"))


def filter_chains(items: DataFrame, chains: dict[str, tuple[str, ...]]) -> DataFrame:
    """Per extractor and chain of boolean columns: kept, recall of gold items, kept items a session.

    items: extractor, session_id, is_gold and the chains' columns.
    """
    all_of = lambda names: F.lit(True) if not names else F.array_min(F.array(*map(F.col, names)))
    held = F.array(*[F.struct(F.lit(name).alias("chain"), all_of(names).alias("kept")) for name, names in chains.items()])
    rows = items.select("extractor", "session_id", "is_gold", F.inline(held))
    gold = F.count_if("is_gold")
    return rows.groupBy("extractor", "chain").agg(F.count_if("kept").alias("kept"), F.try_divide(F.count_if(F.col("kept") & F.col("is_gold")), gold).alias("recall"), F.try_divide(F.count_if("kept"), F.countDistinct(F.when(F.col("kept"), F.col("session_id")))).alias("mean_size"))


#: Characters of a key gram, and of the pieces in which texts are searched.
GRAM, PIECE = 3, 1_024


def char_grams(text: Column, sizes: list[int]) -> Column:
    """Distinct runs of so many characters; the text is taken apart once."""
    none = F.array().cast("array<string>")
    of = lambda cs, n: F.when(F.size(cs) >= n, F.transform(F.sequence(F.lit(1), F.size(cs) - n + 1), lambda i: F.array_join(F.slice(cs, i, F.lit(n)), ""))).otherwise(none)
    return N.let(F.array_remove(F.split(text, ""), ""), lambda cs: F.array_distinct(F.concat(*[of(cs, n) for n in sizes])))


def contained(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, most: int = 200_000) -> DataFrame:
    """(id, term) for every text row and every term that is a substring of it, case aside. terms: term, any number of them.

    An inverted index on the rarest gram of each term: texts are cut into pieces that overlap by the longest term, term
    grams are counted over the pieces, and each term is filed under its rarest one (a term with a gram that no piece has
    is in no text). Pieces meet terms on that gram alone, and what meets is compared as a whole. Tables of up to ``most``
    rows are broadcast; larger ones are joined by a shuffle.
    """
    low = terms.where("term <> ''").select("term", F.lower("term").alias("low")).distinct()
    found = low.agg(F.coalesce(F.max(F.length("low")), F.lit(1)).alias("longest"), F.collect_set(F.least(F.length("low"), F.lit(GRAM))).alias("sizes")).first()
    longest, sizes = found["longest"], sorted(found["sizes"]) or [GRAM]
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("text"))
    parts = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{max(PIECE, longest)}}}"), 0)
    pieces = N.let(parts, lambda ps: F.transform(ps, lambda p, k: F.concat(p, F.left(F.coalesce(F.get(ps, k + 1), F.lit("")), F.lit(longest - 1)))))
    rows = cut(numbered.select("row", "id", F.posexplode(pieces).alias("n", "piece")), "pieces")
    own = F.when(F.length("low") < GRAM, F.array("low")).otherwise(char_grams(F.col("low"), [GRAM]))
    filed = low.select("low").distinct().select("low", F.explode(own).alias("gram"))
    there = rows.select("row", "n", F.explode(char_grams(F.col("piece"), sizes)).alias("gram")).join(small(filed.select("gram").distinct(), most), "gram", "left_semi")
    there = cut(there, "grams")
    counts = there.groupBy("gram").agg(F.count(F.lit(1)).alias("seen"))
    rarest = filed.join(counts, "gram", "left").groupBy("low").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "gram")).alias("key")).where("key.seen > 0")
    near = there.join(small(cut(rarest.select("low", "key.gram"), "rarest"), most), "gram").select("row", "n", "low")
    met = rows.join(near, ["row", "n"]).where(F.contains("piece", F.col("low"))).select("row", "id", "low").distinct()
    return met.join(small(low, most), "low").select("id", "term")


def on_list(proposals: DataFrame, listed: DataFrame, key: str, term: str) -> DataFrame:
    """Per key: proposals whose normal form is on the list, and how many are not."""
    names = listed.select(N.normalise(term).alias("_norm")).distinct().withColumn("_on", F.lit(True))
    marked = proposals.withColumn("_norm", N.normalise(term)).join(names, "_norm", "left")
    return marked.groupBy(key).agg(F.count_if(F.col("_on")).alias("kept"), F.count_if(F.col("_on").isNull()).alias("off_list"))


def valid_groups(proposed: DataFrame, names: DataFrame, least: int = 3, most: int = 8) -> DataFrame:
    """Groups by the real spelling of their members: at least so many, the first so many kept.

    proposed: group_id, place, member; names: name.
    """
    real = names.select(F.lower("name").alias("_low"), "name").groupBy("_low").agg(F.min("name").alias("name"))
    found = proposed.withColumn("_low", F.lower(F.trim("member"))).join(small(real), "_low").groupBy("group_id", "name").agg(F.min("place").alias("place"))
    gathered = found.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("m")).where(F.size("m") >= least)
    return gathered.select("group_id", F.array_join(F.transform(F.slice("m", 1, most), lambda x: x["name"]), "|").alias("members"), F.size("m").cast("long").alias("n_members"))


def truth(items: DataFrame, levels: DataFrame, person: str, area: str) -> DataFrame:
    """A person knows an item if its depth is no more than their level in its area (0 where none is stated)."""
    return items.join(levels, [person, area], "left").withColumn("knows", F.col("depth") <= F.coalesce("level", F.lit(0)))


def probe_masks(items: DataFrame) -> DataFrame:
    """What each probe may see: all others (leave one out), and all but those of its area at its depth or deeper.

    items: item, area, depth. Both counts come from running counts in an area; items never meet pairwise.
    """
    deeper = F.count(F.lit(1)).over(Window.partitionBy("area").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, 0))
    n = items.agg(F.count(F.lit(1)).alias("_all"))
    return items.withColumn("_hidden", deeper).join(F.broadcast(n)).select("item", (F.col("_all") - 1).alias("others"), (F.col("_all") - F.col("_hidden")).alias("not_deeper"))


def probe_consistency(answers: DataFrame, probe: str) -> DataFrame:
    """Whether all answers to a probe are right, and all the same. answers: probe, correct, decision, target."""
    return answers.groupBy(probe).agg(F.bool_and("correct").alias("all_correct"), (F.countDistinct(F.struct("decision", "target")) == 1).alias("one_answer"))


def side_by_side(flags: DataFrame, gold: DataFrame) -> DataFrame:
    """Per run and session: marks of its flags in order, and the gaps that it missed.

    flags: run, session_id, place, term, mark, name (the gold name it hit); gold: session_id, name, is_gap.
    """
    marks = flags.groupBy("run", "session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "mark"))), lambda x: x["mark"]), ",").alias("marks"), F.collect_set("name").alias("hit"))
    gaps = gold.where("is_gap").groupBy("session_id").agg(F.collect_set("name").alias("gaps"))
    none = F.array().cast("array<string>")
    return marks.join(gaps, "session_id", "left").select("run", "session_id", "marks", F.array_join(F.array_sort(F.array_except(F.coalesce("gaps", none), "hit")), ",").alias("missed"))


def cached(requests: DataFrame, cache: DataFrame, request: str) -> DataFrame:
    """Requests with their SHA-256, whether an answer is held, and that answer. cache: sha, answer."""
    return requests.withColumn("sha", F.sha2(request, 256)).join(cache, "sha", "left").withColumn("held", F.col("answer").isNotNull())


def tagged(calls: DataFrame, **tags: str) -> DataFrame:
    """Calls made in a scope carry its tags; one that a call has already is kept."""
    own = {name: F.coalesce(F.col(name), F.lit(value)) if name in calls.columns else F.lit(value) for name, value in tags.items()}
    return calls.withColumns(own)


def secret_status(settings: DataFrame) -> DataFrame:
    """name, is_set and hint (the last four characters of long values) of each setting, never its value."""
    value = F.trim(F.coalesce("value", F.lit("")))
    return settings.select("name", (value != "").alias("is_set"), F.when(F.length(value) >= 12, F.concat(F.lit("..."), F.right(value, F.lit(4)))).alias("hint"))


def last_days(rows: DataFrame, day: str, days: int = 14) -> DataFrame:
    """Rows of the last so many days up to the newest one. day: a date or its text."""
    newest = rows.agg(F.max(F.col(day).cast("date")).alias("_newest"))
    return rows.join(F.broadcast(newest)).where(F.col(day).cast("date") > F.date_sub("_newest", days)).drop("_newest")


def bucket_accuracy(rows: DataFrame) -> DataFrame:
    """Per bucket the mean over seeds of the share that was right, and its deviation. rows: bucket, seed, correct."""
    one = rows.groupBy("bucket", "seed").agg(F.avg(F.col("correct").cast("double")).alias("a"))
    return one.groupBy("bucket").agg(F.avg("a").alias("accuracy"), F.when(F.count(F.lit(1)) > 1, F.stddev_samp("a")).alias("sd"), F.count(F.lit(1)).alias("seeds"))


def known_level(level: Column, levels: tuple[str, ...]) -> Column:
    """A level of the catalogue, the lowest for anything else: comprehension is never credited by mistake."""
    clean = F.lower(F.trim(level))
    return F.when(clean.isin(*levels), clean).otherwise(levels[0])


def without_fixtures(rows: DataFrame, origin: str = "origin", fixture: str = "fixture") -> tuple[DataFrame, DataFrame]:
    """Rows that are no fixtures (an unknown origin is none), and one row: how many were kept and how many excluded."""
    real = ~F.coalesce(F.col(origin) == fixture, F.lit(False))
    return rows.where(real), rows.agg(F.count_if(real).alias("kept"), F.count_if(~real).alias("excluded"))


def materials_of(materials: DataFrame, bridge: DataFrame) -> DataFrame:
    """Material of each concept, newest first. materials: material_id, generated_at; bridge: material_id, concept_id."""
    w = Window.partitionBy("concept_id").orderBy(F.desc("generated_at"), F.desc("material_id"))
    return bridge.distinct().join(materials, "material_id").withColumn("place", F.row_number().over(w).cast("long")).select("concept_id", "material_id", "place")


def resolvable(sessions: DataFrame, kept: DataFrame) -> DataFrame:
    """Whether a copy of each session is kept."""
    return sessions.join(kept.select("session_id").distinct().withColumn("_kept", F.lit(True)), "session_id", "left").select("session_id", F.col("_kept").isNotNull().alias("resolvable"))


def extractor_union(lists: list[DataFrame], unit: str) -> DataFrame:
    """Terms of several extractors as one list a unit: in the order of the extractors, then of their own lists.

    lists: frames of unit, term and place.
    """
    every = lists[0].select(unit, "term", F.struct(F.lit(0).alias("e"), F.col("place").alias("p")).alias("at"))
    for k, more in enumerate(lists[1:], 1):
        every = every.unionByName(more.select(unit, "term", F.struct(F.lit(k).alias("e"), F.col("place").alias("p")).alias("at")))
    first = every.groupBy(unit, "term").agg(F.min("at").alias("at"))
    return first.select(unit, "term", F.row_number().over(Window.partitionBy(unit).orderBy("at")).cast("long").alias("place"))


def undone(judgments: DataFrame, key: str, order: str, at: str, is_undo: Column, seconds: int) -> DataFrame:
    """Of each answer whether the next event of its key takes it back, within so many seconds."""
    w = Window.partitionBy(key).orderBy(order)
    near = F.timestamp_diff("SECOND", F.col(at), F.lead(at).over(w)) <= seconds
    staged = judgments.withColumn("_undo", is_undo)
    return staged.withColumn("undone", F.coalesce(F.lead("_undo").over(w) & near, F.lit(False))).where("not _undo").select(key, order, "undone")


def funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """stage_no, stage, n: how many are left at each stage, a row each."""
    out = None
    for k, (name, rows) in enumerate(stages):
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).cast("long").alias("stage_no"), F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def read_model(concepts: DataFrame, encounters: DataFrame) -> DataFrame:
    """Each concept with its encounters below it, newest first. encounters: concept_id, event_id, judgment (null: waiting)."""
    child = F.struct("event_id", F.coalesce("judgment", F.lit("waiting")).alias("judgment"))
    nested = encounters.groupBy("concept_id").agg(F.sort_array(F.collect_list(child), asc=False).alias("children"), F.count_if(F.col("judgment").isNull()).alias("waiting"))
    joined = concepts.join(nested, "concept_id", "left")
    return joined.select(*concepts.columns, F.coalesce("waiting", F.lit(0).cast("long")).alias("waiting"), F.coalesce("children", F.array().cast("array<struct<event_id:bigint,judgment:string>>")).alias("children"))
