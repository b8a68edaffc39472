"""Quality rules: a learned decision list.

Sequential covering over labelled statistics: each rule is a conjunction of threshold tests, grown test by test
for the gain in information, pruned on held-out rows, and kept only if it is precise there. The list becomes one
ordered Spark conditional expression; statistics and verdicts are computed with SQL functions alone.

Defined cases: a null text has no words and no lines; a null id is kept as it is; repeated rows are judged alike;
an empty table gives an empty result; without labels (or without a bad label) the list is empty and only the base
rules reject; columns of the input other than id and text are ignored, or kept together in one column ``_row``, so that no name of
theirs meets one of the statistics'.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.llm.common import let, text_of, words

WINDOW = 5
#: What the list may test, each a ratio or a count of one text.
FEATURES = ("n_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "mark_share", "mean_line_words")


def repeat_words(ws: Column) -> Column:
    """Words that lie in five-word windows found twice or more in the text.

    Windows are told apart by a 64-bit hash. Texts whose windows all differ, the usual case, end after one
    distinct; the others sort (hash, place) pairs, so the work is n log n in the text's words.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(ws, i + k) for k in range(WINDOW)]))

    def covered(hs: Column) -> Column:
        pairs = F.sort_array(F.arrays_zip(hs.alias("h"), F.sequence(F.lit(0), F.size(hs) - 1).alias("i")))

        def places(ps: Column) -> Column:
            hit = F.filter(ps, lambda p, k: (F.get(ps, k - 1)["h"] == p["h"]) | (F.get(ps, k + 1)["h"] == p["h"]))
            return F.sort_array(F.transform(hit, lambda p: p["i"]))

        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda x, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(at, k - 1))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        return let(let(pairs, places), total)

    repeated = let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(covered(hs)))
    return F.when(F.size(ws) < WINDOW + 1, F.lit(0).cast("long")).otherwise(repeated)


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """Base counts and the features of FEATURES for every text, in one pass without a shuffle; keep_row: and all input columns in _row."""
    text = text_of(text_col)
    count = lambda cls: F.length(F.regexp_replace(text, f"[^{cls}]+", ""))

    def of(ws: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.regexp_replace(x, r"[\x20\x09-\x0D]+", "")) > 0)
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            repeat_words(ws).alias("n_repeat_words"),
            F.size(F.array_distinct(ws)).cast("long").alias("n_distinct_words"),
            let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"))).alias("lines"),
        )

    held = [F.col(id_col).alias(id_col), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if keep_row else [])]
    found = docs.select(*held, let(words(text_col), of).alias("_s"), *(count(c).cast("long").alias(n) for n, c in (("n_symbols", r"#*$%&|<>"), ("n_upper", r"\p{Lu}"), ("n_digits", r"0-9"), ("n_marks", "!?"))))
    base = found.select(
        id_col, *(["_row"] if keep_row else []), "_s.n_words", "_s.word_chars", "n_symbols", F.col("_s.lines.dup").alias("n_dup_lines"), "_s.n_repeat_words", "n_upper", "n_digits", "n_marks",
        F.col("_s.n_distinct_words").alias("n_distinct_words"), F.col("_s.lines.n").alias("n_lines"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return base.withColumns({
        "mean_word_chars": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "distinct_share": share("n_distinct_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"), "digit_share": share("n_digits", "word_chars"), "mark_share": share("n_marks", "word_chars"), "mean_line_words": share("n_words", "n_lines"),
    })


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.cut if self.above else row[self.feature] <= self.cut

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut


@dataclass(frozen=True)
class Rule:
    """All tests hold: the document is bad. precision: of the rule on its held-out rows."""

    tests: tuple[Test, ...]
    precision: float

    def __str__(self) -> str:
        return " AND ".join(f"{t.feature} {'>' if t.above else '<='} {t.cut:.6g}" for t in self.tests)


def _cuts(rows: list[dict], feature: str, most: int) -> list[float]:
    values = sorted({r[feature] for r in rows})
    step = max(1, len(values) // most)
    return [(a + b) / 2 for a, b in zip(values[:-1:step], values[1::step], strict=False)]


def _counts(rows: list[dict], tests: tuple[Test, ...]) -> tuple[int, int]:
    hit = [r["bad"] for r in rows if all(t.holds(r) for t in tests)]
    return sum(hit), len(hit) - sum(hit)


def _grow(rows: list[dict], cuts: dict[str, list[float]], most_tests: int) -> tuple[Test, ...]:
    """Adds the test with the largest gain p1 * (log p1/(p1+n1) - log p0/(p0+n0)) until no bad-free row is left in."""
    tests: tuple[Test, ...] = ()
    held = rows
    while len(tests) < most_tests:
        p0 = sum(r["bad"] for r in held)
        if not p0 or p0 == len(held):
            break
        was, best = math.log(p0 / len(held)), None
        for feature, at in cuts.items():
            ordered = sorted(held, key=lambda r: r[feature])
            k = p = 0
            for c in at:
                while k < len(ordered) and ordered[k][feature] <= c:
                    p += ordered[k]["bad"]
                    k += 1
                for above, p1, n1 in ((False, p, k), (True, p0 - p, len(ordered) - k)):
                    if p1 and (gain := p1 * (math.log(p1 / n1) - was)) > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, Test(feature, above, c))
        if best is None:
            break
        tests += (best[1],)
        held = [r for r in held if best[1].holds(r)]
    return tests


def _prune(rows: list[dict], tests: tuple[Test, ...]) -> tuple[Test, ...]:
    """Drops final tests while (p - n) / (p + n) on the held-out rows does not fall."""
    worth = lambda ts: ((p - n) / (p + n) if (p + n) else -1.0) if (p := _counts(rows, ts)[0]) + (n := _counts(rows, ts)[1]) >= 0 else -1.0
    while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
        tests = tests[:-1]
    return tests


def fit_rules(stats: DataFrame, labels: DataFrame, max_rows: int = 4000, max_rules: int = 12, max_tests: int = 4, max_cuts: int = 64, min_precision: float = 0.95) -> list[Rule]:
    """Sequential covering on at most max_rows labelled rows (those of smallest hashed id, so that reruns agree).

    stats: doc_id, base_failed and FEATURES (of repeated ids the least row counts; what fails the base is left out);
    labels: doc_id and bad (0 or 1). Two rows in three grow rules, the third prunes and
    judges them; a rule under min_precision there ends the list. max_rows bounds what the driver holds.
    """
    sample = labels.where(F.col("bad").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("bad").alias("bad"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = stats.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "bad").agg(F.min(F.struct("base_failed", *FEATURES)).alias("s"))
    rows = sorted((r.asDict() for r in found.select("doc_id", "bad", "s.*").collect() if not r["base_failed"]), key=lambda r: r["doc_id"])
    return cover(rows, max_rules, max_tests, max_cuts, min_precision)


def cover(rows: list[dict], max_rules: int = 12, max_tests: int = 4, max_cuts: int = 64, min_precision: float = 0.95) -> list[Rule]:
    grow, prune = [r for k, r in enumerate(rows) if k % 3], [r for k, r in enumerate(rows) if k % 3 == 0]
    rules: list[Rule] = []
    while len(rules) < max_rules and sum(r["bad"] for r in grow):
        cuts = {f: _cuts(grow, f, max_cuts) for f in FEATURES}
        tests = _prune(prune, _grow(grow, cuts, max_tests))
        p, n = _counts(prune, tests)
        if not tests or not p or p / (p + n) < min_precision:
            break
        rules.append(Rule(tests, p / (p + n)))
        grow, prune = ([r for r in part if not all(t.holds(r) for t in tests)] for part in (grow, prune))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that a document meets, else null: one CASE in the list's order."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        hit = F.lit(True)
        for t in rules[k - 1].tests:
            hit = hit & t.column()
        out = F.when(hit, F.lit(k)).otherwise(out)
    return out


def bad_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0).alias("bad"))


def quality_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, keep_row: bool = False) -> DataFrame:
    """Every document with its statistics, base_failed, the number of the rule that rejects it, and kept; keep_row: and its row."""
    ids = bad_labels(labels)
    picked = ids.where("bad is not null and doc_id is not null").groupBy("doc_id").agg(F.max("bad").alias("bad")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    labelled = docs.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")
    rules = fit_rules(text_statistics(labelled).withColumn("base_failed", base_failed()), picked, max_rows)
    judged = text_statistics(docs, keep_row=keep_row).withColumn("base_failed", base_failed())
    return judged.withColumn("rule", F.when(~F.col("base_failed"), verdict(rules))).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op2(spark, sf_dir: str) -> DataFrame:
    from colloquy.llm.common import read

    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
