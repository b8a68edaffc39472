"""Term extraction and mention counting over texts: n-grams, RAKE, C-value, mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.functions.names import let, stem_token
from colloquy.state import cut, small

#: Words that end a phrase.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "de", "der", "die", "for", "from", "in", "is", "it", "la", "le", "of", "on", "or", "that", "the", "this", "to", "und", "was", "with")
LONGEST = 4


def clean_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^a-z0-9]+"), "")


def stems(text: Column) -> Column:
    return let(clean_words(text), lambda ws: F.transform(ws, stem_token))


def ngrams(ws: Column, most: int = LONGEST) -> Column:
    """Every run of 1 to most words, joined by a space. The words are bound once, so a text is split once, not once a run."""
    sizes = F.array(*[F.lit(n) for n in range(1, most + 1)])
    none = F.array().cast("array<string>")
    of = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(none)
    return let(ws, lambda w: F.flatten(F.transform(sizes, lambda n: of(w, n))))


def phrases(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Runs of words between stop words and punctuation, of at most LONGEST words: id, sentence, island, phrase words.

    Sentences are exploded whole and their islands found by array functions, so no window over a text is needed.
    """
    stop = F.array(*map(F.lit, STOP))
    parts = docs.select(F.col(id_col).alias("id"), F.explode(F.split(F.lower(text_col), r"[^a-z0-9 ]+")).alias("s"))
    ws = F.array_remove(F.split("s", " +"), "")
    runs = F.split(F.array_join(F.transform(ws, lambda w: F.when(F.array_contains(stop, w), "|").otherwise(w)), " "), r"\|")
    found = parts.select("id", F.explode(runs).alias("p")).select("id", F.trim("p").alias("phrase")).where("phrase <> ''")
    return found.where(F.size(F.split("phrase", " ")) <= LONGEST)


def rake(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per text and phrase: the sum of its words' degree over frequency (degree: words in phrases with it)."""
    found = phrases(docs, id_col, text_col)
    words = found.select("id", "phrase", F.explode(F.split("phrase", " ")).alias("w"), F.size(F.split("phrase", " ")).alias("n"))
    score = words.groupBy("id", "w").agg((F.sum("n") / F.count(F.lit(1))).alias("score"))
    distinct = found.distinct().select("id", "phrase", F.explode(F.split("phrase", " ")).alias("w"))
    return distinct.join(score, ["id", "w"]).groupBy("id", "phrase").agg(F.sum("score").alias("score"))


def c_value(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per phrase over all texts: log2(length + 1) * (f - mean f of the longer phrases that contain it).

    Containment is an equi join of a phrase with the sub-runs of longer ones.
    """
    freq = phrases(docs, id_col, text_col).groupBy("phrase").agg(F.count(F.lit(1)).alias("f"))
    ws = F.split("phrase", " ")
    inner = freq.select(F.col("phrase").alias("longer"), F.col("f").alias("fl"), F.explode(F.array_distinct(ngrams(ws))).alias("phrase")).where("phrase <> longer")
    nested = inner.groupBy("phrase").agg(F.avg("fl").alias("mean"))
    return freq.join(nested, "phrase", "left").select("phrase", "f", (F.log2(F.size(ws) + 1.0) * (F.col("f") - F.coalesce("mean", F.lit(0.0)))).alias("c_value"))


def matched(asked: DataFrame, texts: DataFrame, keep: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Every place of a text at which an asked run of words stands: keep, by, run. asked and texts: ws (array of words) and by.

    Two lookups on the small side come before any run is made: a place goes on only if its word begins an asked run, and
    then makes only the runs of the lengths that are asked for after that word. So the work follows the words and the
    hits; a place carries as many words as the longest run has.
    """
    clean = asked.where(F.size("ws") > 0).select(*by, F.get("ws", F.lit(0)).alias("first"), F.size("ws").alias("n"), F.array_join("ws", " ").alias("run")).distinct()
    longest = clean.agg(F.max("n")).first()[0] or 1
    lengths = clean.groupBy(*by, "first").agg(F.collect_set("n").alias("sizes"))
    ahead = let(F.col("ws"), lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.slice(w, i, F.lit(longest)))).otherwise(F.array().cast("array<array<string>>")))
    places = texts.select(*keep, *by, F.explode(ahead).alias("ahead")).withColumn("first", F.get("ahead", F.lit(0)))
    near = places.join(small(lengths), [*by, "first"]).select(*keep, *by, "ahead", F.explode("sizes").alias("n")).where(F.size("ahead") >= F.col("n"))
    runs = near.select(*keep, *by, F.array_join(F.slice("ahead", F.lit(1), F.col("n")), " ").alias("run"))
    return runs.join(small(clean.select(*by, "run")), [*by, "run"], "left_semi")


def mentions(terms: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """How often each term occurs in each text: term, id, n. terms: term, of any number of words."""
    asked = terms.select("term", clean_words(F.col("term")).alias("ws"))
    found = matched(asked, docs.select(F.col(id_col).alias("id"), clean_words(F.col(text_col)).alias("ws")), ["id"]).groupBy("id", "run").agg(F.count(F.lit(1)).alias("n"))
    spelled = asked.select("term", F.array_join("ws", " ").alias("run")).distinct()
    return found.join(small(spelled), "run").select("term", "id", "n")


def known_stems(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """word and stem of those words of the texts (column text) whose stem is asked (column stem). Each distinct word is stemmed once."""
    words = cut(texts.select(F.explode(clean_words(F.col("text"))).alias("word")).distinct(), "vocabulary")
    return cut(words.withColumn("stem", stem_token(F.col("word"))).join(small(asked.select("stem").distinct()), "stem", "left_semi").select("word", "stem"), "stems")


def matched_forms(asked: DataFrame, texts: DataFrame, keep: list[str]) -> DataFrame:
    """Which asked runs of words stand in a text: keep and run_id, distinct. asked: run_id, form (exact or stem) and ws, distinct by form and ws; texts: text and keep.

    One pass finds both forms: a place looks up its first word and then its second, as they are spelled, in tables of
    those spellings that begin an asked run; only what follows the second word of a place that got so far is stemmed there.
    """
    clean = asked.where(F.size("ws") > 0).select("run_id", "form", F.get("ws", F.lit(0)).alias("first"), F.get("ws", F.lit(1)).alias("second"), F.size("ws").alias("n"), F.array_join("ws", " ").alias("run"))
    longest = clean.agg(F.max("n")).first()[0] or 1
    known = known_stems(clean.where("form = 'stem'").select(F.explode(F.array_compact(F.array("first", "second"))).alias("stem")), texts)

    def spelled(table: DataFrame, of: str, word: str) -> DataFrame:
        """The rows of a table of runs, once for each spelling (word) of the word in column of."""
        exact = table.where("form = 'exact'").withColumn(word, F.col(of))
        return exact.unionByName(table.where("form = 'stem'").join(known.select(F.col("stem").alias(of), F.col("word").alias(word)), of))

    # runs of several words that share form, first word and length go by the least of their numbers until the second word is looked up
    several = clean.where("n > 1").join(clean.where("n > 1").groupBy("form", "first", "n").agg(F.min("run_id").alias("at")), ["form", "first", "n"])
    starts = clean.where("n = 1").select("form", "first", "n", F.col("run_id").alias("at")).unionByName(several.select("form", "first", "n", "at").distinct())
    begins = spelled(starts, "first", "w1").groupBy("w1").agg(F.collect_list(F.struct("n", "at")).alias("runs"))
    seconds = several.groupBy("form", "first", "n", "at", "second").agg(F.min(F.when(F.col("n") == 2, F.col("run_id"))).alias("two"))
    follow = spelled(seconds, "second", "w2").select("at", "w2", "two", F.struct("form", "first", "second").alias("head"))
    whole = clean.where("n > 2").select(F.col("run_id").alias("more"), F.col("form").alias("f"), F.col("run").alias("r"))

    names = [f"w{k + 1}" for k in range(max(longest, 2))]
    shifted = F.arrays_zip("ws", *[F.when(F.size("ws") > k, F.slice("ws", F.lit(k + 1), F.size("ws"))).otherwise(F.array().cast("array<string>")) for k in range(1, len(names))])
    places = texts.select(*keep, clean_words(F.col("text")).alias("ws")).select(*keep, F.inline(shifted)).toDF(*keep, *names)
    ahead = F.array(*names)
    near = places.join(small(begins), "w1").select(*keep, *names, F.inline("runs")).where(F.get(ahead, F.col("n") - 1).isNotNull())
    near = near.join(small(follow), ["at", "w2"], "left").where("n = 1 or head is not null")
    rest = F.slice(ahead, F.lit(3), F.greatest(F.col("n") - 2, F.lit(0)))
    rest = F.when(F.col("head.form") == "stem", F.transform(rest, stem_token)).otherwise(rest)
    near = near.withColumn("r", F.when(F.col("n") > 2, F.array_join(F.concat(F.array("head.first", "head.second"), rest), " "))).withColumn("f", F.col("head.form"))
    found = F.when(F.col("n") == 1, F.col("at")).when(F.col("n") == 2, F.col("two")).otherwise(F.col("more"))
    return near.join(small(whole), ["f", "r"], "left").select(*keep, found.alias("run_id")).where("run_id is not null").distinct()


def mention_matrix(terms: DataFrame, docs: DataFrame, id_col: str, unit_col: str, text_col: str) -> DataFrame:
    """Per term: texts with it and their units, by exact words and by stems, over all texts and over first copies only.

    A text is a copy if one of a smaller id has the same content. Both forms are found in one pass, by content.
    """
    forms = lambda text: F.array(F.struct(F.lit("exact").alias("form"), clean_words(text).alias("ws")), F.struct(F.lit("stem").alias("form"), stems(text).alias("ws")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(unit_col).alias("unit"), F.col(text_col).alias("text"), F.unhex(F.sha2(F.coalesce(text_col, F.lit("")), 256)).alias("content"))
    first = texts.groupBy("content").agg(F.min("id").alias("first"))
    rows = texts.select("content", "id", "unit").join(first, "content").select("content", "id", "unit", (F.col("id") != F.col("first")).alias("copy"))
    asked = cut(terms.distinct().select("term", F.inline(forms(F.col("term")))), "asked")
    runs = cut(asked.groupBy("form", "ws").agg(F.collect_set("term").alias("terms")).withColumn("run_id", F.monotonically_increasing_id()), "runs")
    hits = matched_forms(runs, texts.select("content", "text"), ["content"]).join(rows, "content").select("id", "unit", "copy", "run_id").distinct()
    units = hits.groupBy("run_id", "unit").agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.col("copy")).alias("kept"))
    met = lambda c: F.count_if(F.col("unit").isNotNull() & (F.col(c) > 0))
    counts = units.groupBy("run_id").agg(F.sum("all").alias("mentions"), met("all").alias("units"), F.sum("kept").alias("mentions_dedup"), met("kept").alias("units_dedup"))
    found = runs.join(counts, "run_id").select(F.explode("terms").alias("term"), "form", *counts.columns[1:])
    cells = [F.coalesce(F.sum(F.when(F.col("form") == form, F.col(f"{c}{name}"))), F.lit(0).cast("long")).alias(f"{c}_{form}{name}") for form in ("exact", "stem") for name in ("", "_dedup") for c in ("mentions", "units")]
    counted = found.groupBy("term").agg(*cells)
    none = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counted.columns if c != "term"]
    return terms.select("term").distinct().join(counted, "term", "left").select("term", *none)


def persistence(found: DataFrame, terms: DataFrame, unit: str) -> DataFrame:
    """One row: terms met in two units or more, and those never met. found: term, unit."""
    per = terms.select("term").distinct().join(found.groupBy("term").agg(F.countDistinct(unit).alias("units")), "term", "left")
    return per.agg(F.count_if(F.col("units") >= 2).alias("persistent"), F.count_if(F.col("units").isNull()).alias("never"), F.count(F.lit(1)).alias("terms"))


def passages(needles: DataFrame, docs: DataFrame, item: str, id_col: str, words: int = 8) -> DataFrame:
    """Which texts hold a run of so many words of which needle: item, id, shared runs."""
    runs = lambda c: F.array_distinct(F.get(F.transform(F.array(clean_words(F.col(c))), lambda ws: F.when(F.size(ws) >= words, F.transform(F.sequence(F.lit(1), F.size(ws) - words + 1), lambda i: F.xxhash64(F.slice(ws, i, F.lit(words))))).otherwise(F.array().cast("array<long>"))), F.lit(0)))
    a = needles.select(item, F.explode(runs("text")).alias("h"))
    b = docs.select(id_col, F.explode(runs("text")).alias("h"))
    return b.join(small(a), "h").groupBy(item, id_col).agg(F.count(F.lit(1)).alias("shared"))


def code_shape(term: Column) -> Column:
    """Looks like an identifier: dots, slashes, underscores, calls, flags, or humps."""
    return term.rlike(r"[_/\\(){}=]|^--?\w|\w\.\w|[a-z][A-Z]")


def clean_term(term: Column) -> Column:
    """Without leading determiners; null if then empty, too long or a pronoun."""
    bare = F.trim(F.regexp_replace(F.lower(F.trim(term)), r"^((the|a|an|this|that|these|those|its|our|your|their) +)+", ""))
    return F.when((F.length(bare) >= 2) & (F.size(F.split(bare, " ")) <= 6) & ~bare.isin("it", "this", "that", "they", "we", "you"), bare)


def title_variants(term: Column) -> Column:
    single = F.regexp_replace(term, "s$", "")
    return F.array_distinct(F.array(term, single, F.initcap(term), F.initcap(single)))


def rarity_min(terms: DataFrame, freq: DataFrame) -> DataFrame:
    """The rarest word's frequency of each term; 8 where no word is known. freq: word, zipf."""
    ws = terms.select("term", F.explode_outer(clean_words(F.col("term"))).alias("word"))
    return ws.join(freq, "word", "left").groupBy("term").agg(F.coalesce(F.min("zipf"), F.lit(8.0)).alias("rarity"))


def first_spelling(rows: DataFrame, text: str, order: str) -> DataFrame:
    key = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return rows.withColumn("norm", key).where("norm <> ''").groupBy("norm").agg(F.min_by(text, order).alias("spelling"), F.count(F.lit(1)).alias("n"))


def unit_union(rows: DataFrame, unit: str, order: str, items: str) -> DataFrame:
    """Ordered union of a unit's lists, each item where it first stands."""
    one = rows.select(unit, order, F.posexplode(items).alias("p", "item")).groupBy(unit, "item").agg(F.min(F.struct(order, "p")).alias("at"))
    n = F.row_number().over(Window.partitionBy(unit).orderBy("at"))
    return one.select(unit, "item", n.cast("long").alias("place"))
