"""URL filter: fixed host and path rules first, association rules mined from labels for the rest.

Sets of URL tokens are mined level by level, from pairs up; a set whose confidence among all labelled URLs and whose
support among the bad ones reach their bounds becomes a rule. What cannot change a verdict is left out, for the number of
sets grows exponentially: tokens that always occur together count as one (the first by name), a token of every URL tells
nothing, a set of which a part is a rule already is none, and a set that occurs wherever one of its parts does is as good
or bad as that part, and so is every larger set compared with one that lacks the token. No set is left out otherwise,
however many tokens a URL has. Rules are a table, matched by inverted index: each rule is filed under
its rarest token, the distinct tokens of a URL look up that index, and a rule fits if the URL has all its tokens.

Defined cases: a null URL, or one without ://, has an empty host and path and no tokens, fits no rule and is allowed;
null labels and URLs without a label take no part in mining; without labels of either kind there are no mined rules;
repeated rows are judged alike; an empty table gives an empty result; extra columns are carried along unless they
have a name of the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.llm.common import cut, local_rows, ranked

#: Fixed values: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Rows of a table of tokens or rules up to which it is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 20_000


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first ://; empty without one."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    return F.when(F.locate("/", rest) > 0, F.substring(rest, F.locate("/", rest), F.length(rest))).otherwise(F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct items of one URL: labels of the host, segments and depth of the path, keys of the query, the scheme."""
    parts = F.transform(F.array_remove(F.split(host, r"\."), ""), lambda x: F.concat(F.lit("host="), x))
    segments = F.transform(F.array_remove(F.split(path, "/"), ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.array_remove(F.split(query, "&"), ""), lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1)))
    more = F.array(F.concat(F.lit("scheme="), F.coalesce(F.substring_index(url, "://", 1), F.lit(""))), F.concat(F.lit("depth="), F.size(segments).cast("string")))
    return F.when(F.locate("://", url) > 0, F.array_distinct(F.concat(parts, segments, keys, more))).otherwise(F.array().cast("array<string>"))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def mine_rules(labelled: DataFrame, least: int = 5, min_confidence: float = 0.6) -> DataFrame:
    """rule_id (from 0, best first), items, hits and confidence, from (items, bad).

    least: bad URLs that a rule must hit. A level holds one row a set and URL that has it; two sets of a level make one of
    the next if they differ in their last (most frequent) token, so of a set and a URL each row comes from one pair, and
    what meets under a key are at most the tokens of one URL. The number of sets can be exponential where URLs share many
    tokens in all combinations; a level is a written table then, and no task holds more than its share.
    """
    spark = labelled.sparkSession
    none = local_rows(spark, [], "rule_id long, items array<string>, hits long, confidence double")
    baskets = labelled.where("size(items) > 0 and bad is not null").select(F.monotonically_increasing_id().alias("basket"), F.array_distinct("items").alias("items"), F.col("bad").cast("int").alias("bad"))
    baskets = cut(baskets, "baskets")
    rows, bad = baskets.agg(F.count(F.lit(1)), F.sum("bad")).first()
    if not bad or bad == rows:
        return none
    found = baskets.select("basket", "bad", F.explode("items").alias("token"))
    seen = found.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("hits"), F.bit_xor(F.xxhash64("basket")).alias("where"))
    live = seen.where((F.col("hits") >= least) & (F.col("n") < rows))
    one = cut(live.groupBy("n", "hits", "where").agg(F.min("token").alias("token")).withColumn("confidence", F.col("hits") / F.col("n")), "tokens")
    single = one.where(F.col("confidence") >= min_confidence).select(F.array("token").alias("items"), "hits", "confidence")
    rest = one.where(F.col("confidence") < min_confidence).select("token", "n", "hits")

    # a token's number is its place by frequency, so a set is filed under its rarest tokens first
    rest = cut(ranked(rest, [F.asc("n"), F.asc("token")], "item").select("token", F.col("item").cast("int").alias("item"), "n", "hits"), "items")
    level = rest.select(F.array("item").alias("needs"), "n", "hits")
    covers = cut(found.join(_small(rest.select("token", "item")), "token").select("basket", "bad", F.array().cast("array<int>").alias("head"), F.col("item").alias("tail")), "covers")
    rules, size = single, 1
    while not covers.isEmpty():
        other = covers.select("basket", "head", F.col("tail").alias("next"))
        pairs = cut(covers.join(other, ["basket", "head"]).where("tail < next").select("basket", "bad", F.concat("head", F.array("tail")).alias("head"), F.col("next").alias("tail")), "pairs")
        size += 1
        counted = pairs.groupBy("head", "tail").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("hits")).where(F.col("hits") >= least)
        counted = counted.select(F.concat("head", F.array("tail")).alias("needs"), "head", "tail", "n", "hits")
        # every part with one token less must be a set that goes on, and occur more often
        parts = counted.select("needs", "n", F.explode(F.transform("needs", lambda x: F.array_remove("needs", x))).alias("part"))
        free = parts.join(_small(level.select(F.col("needs").alias("part"), F.col("n").alias("of"))), "part").where("n < of").groupBy("needs").agg(F.count(F.lit(1)).alias("parts")).where(F.col("parts") == size)
        counted = cut(counted.join(free.select("needs"), "needs").withColumn("confidence", F.col("hits") / F.col("n")), "sets")
        good = counted.where(F.col("confidence") >= min_confidence)
        named = good.select("needs", "hits", "confidence", F.explode("needs").alias("item")).join(_small(rest.select("token", "item")), "item")
        rules = rules.union(named.groupBy("needs", "hits", "confidence").agg(F.sort_array(F.collect_list("token")).alias("items")).select("items", "hits", "confidence"))
        level = counted.where(F.col("confidence") < min_confidence)
        covers = cut(pairs.join(_small(level.select("head", "tail")), ["head", "tail"]).select("basket", "bad", "head", "tail"), "covers")
    return ranked(rules, [F.desc("confidence"), F.desc("hits"), F.size("items").asc(), F.asc("items")], "rule_id").select("rule_id", "items", "hits", "confidence")


def matched(urls: DataFrame, rules: DataFrame, key: str = "_url") -> DataFrame:
    """key and the best (lowest) rule_id that fits, for each distinct value of key. urls: key, items."""
    index = rules.select("rule_id", "items", F.explode("items").alias("token"))
    rare = index.join(index.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token")
    filed = rare.groupBy("rule_id", F.col("items").alias("needs")).agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    looked = urls.select(key, "items", F.explode("items").alias("token")).join(_small(filed), "token")
    return looked.where(F.size(F.array_except("needs", "items")) == 0).groupBy(key).agg(F.min("rule_id").alias("mined_rule"))


def url_filter(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, url_col: str = "url", id_col: str = "page_id", **mining) -> DataFrame:
    """Every page with host, path, rule, mined_rule and verdict. labels: id_col and bad (0 or 1)."""
    url = F.col(url_col)
    base = pages.drop("host", "path", "rule", "verdict", "mined_rule", "_items", "_fixed", "_url").withColumns({"host": host_of(url), "path": path_of(url)})
    found = base.withColumn("_fixed", fixed_rule(F.col("host"), F.col("path"), rules)).withColumns({"rule": F.col("_fixed.rule"), "_items": tokens(url, F.col("host"), F.col("path"))})
    mined = None
    if labels is not None:
        known = labels.where("bad is not null").groupBy(id_col).agg(F.max("bad").alias("bad"))
        mined = mine_rules(found.select(id_col, F.col("_items").alias("items")).join(known, id_col).select("items", "bad"), **mining)
    if mined is None or mined.isEmpty():
        out = found.withColumn("mined_rule", F.lit(None).cast("long"))
    else:
        # rows that a fixed rule judges, and those without a URL, look nothing up
        asked = F.col("_fixed").isNull() & (F.size("_items") > 0)
        distinct = found.where(asked).select(url.alias("_url"), F.col("_items").alias("items")).distinct()
        hits = matched(distinct, mined)
        judged = found.where(asked).join(hits, url == F.col("_url"), "left").drop("_url")
        out = judged.unionByName(found.where(~asked).withColumn("mined_rule", F.lit(None).cast("long")))
    verdict = F.coalesce("_fixed.verdict", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).drop("_fixed", "_items")


def op4(spark, sf_dir: str) -> DataFrame:
    """Labels of a page: those of the document of the same id (bad: quality 0)."""
    from colloquy.llm.common import read

    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0).alias("bad"))
    return url_filter(read(spark, sf_dir, "pages").select("page_id", "url"), labels).select("page_id", "host", "path", "rule", "verdict", "mined_rule")
