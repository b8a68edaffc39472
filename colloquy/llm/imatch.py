"""I-Match fingerprints: hashes of randomised lexicon subsets.

The lexicon is every term whose inverse document frequency lies in a band; document frequencies are counted term by
term over all documents. A document's distinct terms of the lexicon are sorted (by hash) and looked at through GROUPS
randomised sub-lexicons that overlap (each term is in two of them, by independent bits of its hash); each sub-lexicon's
terms are hashed together. Sub-lexicons are thinned by halves with a text's length, until about two terms are left in
each; LEVELS neighbouring thinnings are kept, so that texts up to some 2**(LEVELS - 1) times apart in length can be
compared at the thinning of the longer. Likeness is the share of equal hashes among sub-lexicons that either text has
terms in.

A lexicon of up to MOST_TERMS terms is a literal of the plan: hash buckets whose entries are compared whole. A larger one
is joined to the documents' terms instead. Both are exact, so how large the lexicon is changes the plan and no result.

Defined cases: null and empty texts have no terms and the fingerprint of an empty text (likeness 1 to each other, 0 to
any other); a text without a term in the band uses all its terms; equal texts have equal fingerprints; equal ids are
ordered by their text's hash, null ids come last; rows repeated as a whole share one place in the order, each keeping
its row; a single document is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.llm.common import cut, let, lower_ascii, parts, ranked, text_of, words

GROUPS, LEVELS = 32, 4
#: Terms of the largest literal, some 2 MB of numbers and as many buckets.
MOST_TERMS = 1 << 18
#: The band, as powers of the number of documents: terms in more than N**0.3 and at most N**0.7 documents.
BAND = (0.3, 0.7)


def terms(text: Column | str) -> Column:
    """64-bit hashes of the distinct lower-case words."""
    return F.array_distinct(F.transform(words(lower_ascii(text)), lambda w: F.xxhash64(w)))


@dataclass(frozen=True)
class Lexicon:
    """The terms (hashes) of the band: as a table, and as a literal of 2**bits hash buckets if they are few enough."""

    table: DataFrame
    bits: int
    buckets: Column | None

    def held(self, df: DataFrame, texts: dict[str, str]) -> DataFrame:
        """df with an array column of the terms of each text that are in the lexicon. texts: new name -> text column."""
        if self.buckets is not None:
            mask = F.lit((1 << self.bits) - 1)
            inside = lambda t: F.array_contains(F.get(self.buckets, t.bitwiseAND(mask).cast("int")), F.shiftrightunsigned(t, self.bits))
            return df.withColumns({name: F.filter(terms(text), inside) for name, text in texts.items()})
        rows = cut(df.withColumn("_row", F.monotonically_increasing_id()), "texts")
        for name, text in texts.items():
            found = rows.select("_row", F.explode(terms(text)).alias("term")).join(self.table, "term", "left_semi").groupBy("_row").agg(F.collect_list("term").alias(name))
            rows = rows.join(found, "_row", "left").withColumn(name, F.coalesce(name, F.array().cast("array<bigint>")))
        return rows.drop("_row")


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND, most_terms: int = MOST_TERMS) -> Lexicon:
    n = docs.count()
    counted = docs.select(F.explode(terms(text_col)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    table = cut(counted.where((F.col("df") > n ** band[0]) & (F.col("df") <= max(2.0, n ** band[1]))).select("term"), "lexicon")
    size = table.count()
    bits = max(1, size.bit_length())
    if size > most_terms:
        return Lexicon(table, bits, None)
    buckets: list[list[int]] = [[] for _ in range(1 << bits)]
    for (term,) in table.collect():  # most_terms numbers at most; a bucket's place stands for the low bits
        buckets[term & ((1 << bits) - 1)].append((term & ((1 << 64) - 1)) >> bits)
    return Lexicon(table, bits, F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<array<bigint>>"))


def fingerprint(text: Column | str, held: Column | str) -> Column:
    """struct(level, hashes): those of the sub-lexicons at LEVELS thinnings, from the text's own level on; 0 for none."""
    held = F.col(held) if isinstance(held, str) else held

    def thinned(ts: Column) -> Column:
        level = F.greatest(F.lit(0), F.round(F.log2(F.greatest(F.size(ts), F.lit(1)) / F.lit(float(GROUPS))))).cast("int")
        keep = lambda xs, n: F.filter(xs, lambda t: F.shiftrightunsigned(t, 32).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1) == 0)
        # two numbers of a group in one: its bit is set in the mask of a term
        masks = lambda xs: F.transform(xs, lambda t: F.struct(t.alias("t"), F.shiftrightunsigned(t, 59).cast("int").alias("g"), F.shiftrightunsigned(t, 54).bitwiseAND(F.lit(GROUPS - 1)).cast("int").alias("o")))
        one = lambda ms, g: let(F.filter(ms, lambda m: (m["g"] == g) | (m["o"] == g)), lambda s: F.when(F.size(s) == 0, F.lit(0)).otherwise(F.hash(F.transform(s, lambda m: m["t"])).bitwiseOR(F.lit(1))))
        hashes = lambda xs: let(masks(xs), lambda ms: F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: one(ms, g)))

        def more(xs: Column, n: Column, left: int) -> Column:
            """Hashes at this thinning and at those after it, one array."""
            own = hashes(xs)
            return own if left == 1 else F.concat(own, let(keep(xs, n + 1), lambda ys: more(ys, n + 1, left - 1)))

        return let(level, lambda n: let(keep(ts, n), lambda xs: F.struct(n.alias("level"), more(xs, n, LEVELS).alias("hashes"))))

    return let(F.sort_array(F.when(F.size(held) > 0, held).otherwise(terms(text))), thinned)


def as_text(fp: Column) -> Column:
    four = F.array_join(F.transform(fp["hashes"], lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")
    return F.concat(F.lower(F.lpad(F.hex(fp["level"]), 2, "0")), F.lit("-"), four)


def likeness(x: Column, y: Column) -> Column:
    """Equal sub-lexicons over those with terms in either, at the longer text's level; 1 for two texts without terms.

    0 for texts LEVELS or more levels apart, of which the longer has some 2**(LEVELS - 0.5) times the terms at least.
    """
    apart = y["level"] - x["level"]
    at = lambda fp, back: F.slice(fp["hashes"], back * GROUPS + 1, F.lit(GROUPS))
    both = F.zip_with(at(x, F.greatest(apart, F.lit(0))), at(y, F.greatest(-apart, F.lit(0))), lambda p, q: F.when((p == 0) & (q == 0), F.lit(0)).when(p == q, F.lit(65537)).otherwise(F.lit(1)))
    share = let(F.aggregate(both, F.lit(0), lambda s, v: s + v), lambda s: F.when(s == 0, F.when(x["hashes"] == y["hashes"], 1.0).otherwise(0.0)).otherwise(F.shiftright(s, 16) / s.bitwiseAND(F.lit(65535))))
    return F.when(F.abs(apart) < LEVELS, share).otherwise(0.0).cast("double")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND, most_terms: int = MOST_TERMS) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and likeness to that and to the next document.

    Neighbours in the order are found on (id, hash, length) alone; then whole texts are shuffled once and the half that
    each text lends to its neighbour once more.
    """
    words_of = lexicon(docs, text_col, band, most_terms)
    first = -(1 << 63)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    keyed = rows.withColumns({"k": F.coalesce("doc_id", F.lit(first)), "h": F.xxhash64("text")})
    keys = keyed.select("k", "h", F.length("text").alias("n")).groupBy("k", "h", "n").agg(F.count(F.lit(1)).alias("copies"))
    place = cut(ranked(keys, [F.desc("k"), F.asc("h"), F.asc("n")], "rank"), "places")
    total, copies = place.agg(F.count(F.lit(1)), F.max("copies")).first()
    before = place.select((F.pmod(F.col("rank") + 1, F.lit(max(total, 1)))).alias("rank"), F.col("k").alias("to_k"), F.col("h").alias("to_h"), F.floor(F.col("n") / 2).cast("int").alias("half"))
    lends = place.select("k", "h", "rank").join(before, "rank").drop("rank")

    # one exchange for both sides of the join: the same columns, and nothing computed before it
    whole = keyed.repartition(parts(docs, 8), "k", "h")
    lent = words_of.held(whole.join(lends.hint("shuffle_hash"), ["k", "h"]), {"_held": "text"})
    lent = lent.select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), F.col("doc_id").alias("next_id"), F.expr("left(text, half)").alias("start"), fingerprint("text", "_held").alias("next_fp"))
    if (copies or 1) > 1:
        lent = lent.groupBy("k", "h").agg(F.first("next_id").alias("next_id"), F.first("start").alias("start"), F.first("next_fp").alias("next_fp"))
    n = F.length("text")
    edited = F.concat(F.left("text", n - F.floor(n / 2).cast("int")), F.col("start"))
    met = whole.join(lent.hint("shuffle_hash"), ["k", "h"]).select("doc_id", n.cast("long").alias("n_chars"), "next_id", "next_fp", "text", edited.alias("edited"))
    seen = words_of.held(met, {"_own": "text", "_edited": "edited"})
    seen = seen.select("doc_id", "n_chars", "next_id", "next_fp", fingerprint("text", "_own").alias("fp"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint("edited", "_edited").alias("edited_fp"))
    return seen.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "next_id",
    )


def op10(spark, sf_dir: str) -> DataFrame:
    from colloquy.llm.common import read

    return edited_likeness(read(spark, sf_dir, "documents"))
