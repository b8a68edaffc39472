"""String kernels for matching names: all JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the matching rules.
STOPWORDS = ("a", "an", "and", "as", "for", "in", "of", "on", "or", "the", "to", "vs", "with")
SPELLING = (
    ("isations", "izations"), ("isation", "ization"), ("ising", "izing"), ("ised", "ized"), ("ises", "izes"), ("ise", "ize"),
    ("ysing", "yzing"), ("ysed", "yzed"), ("yse", "yze"), ("ours", "ors"), ("our", "or"), ("tre", "ter"), ("ogue", "og"),
)
SUFFIXES = (
    "izations", "ization", "ations", "ation", "ically", "ional", "ical", "encies", "ancies", "ences", "ances", "ities", "ments", "ness",
    "izing", "ings", "ency", "ancy", "ence", "ance", "ment", "ions", "ents", "ants", "ized", "izes", "able", "ible", "ity", "ize", "ing", "ion", "ent",
    "ant", "ers", "ive", "er", "ic", "ed", "ly",
)
MIN_STEM, FUZZY_FLOOR, FUZZY_MIN = 4, 0.75, 5
COMPACT_EQUAL, ABBREVIATION, CONTAINED, CONTAINED_MIN = 1.0, 0.9, 0.5, 4


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise(name: Column | str) -> Column:
    """Lower case, runs of anything but a-z and 0-9 to one space, no space at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))), "[^a-z0-9]+", " "))


def variants(name: Column) -> Column:
    """The name, what is left without its brackets, what they hold, and each side of a "vs", normalised and distinct."""
    inner = F.regexp_extract_all(name, F.lit(r"\(([^)]*)\)"), 1)
    forms = F.concat(F.array(name), F.when(F.size(inner) > 0, F.concat(F.array(F.regexp_replace(name, r"\([^)]*\)", " ")), inner)).otherwise(F.array().cast("array<string>")))
    parts = F.flatten(F.transform(forms, lambda f: let(normalise(f), lambda n: F.concat(F.array(n), F.transform(F.split(n, r"\b(?:vs|versus)\b"), F.trim)))))
    return F.array_distinct(F.array_remove(parts, ""))


def stem(word: Column) -> Column:
    """Spelling folded, plural off, at most two endings off (a stem of four stays), final e and double letter off."""
    word = _spelled(word)
    plural = let(word, lambda w: (
        F.when(w.endswith("ies") & (F.length(w) > 4), F.concat(_cut(w, 3), F.lit("y")))
        .when(w.rlike("(sses|xes|zzes|ches|shes)$"), _cut(w, 2))
        .when(w.endswith("s") & (F.length(w) > 3) & ~w.rlike("(ss|us|is)$"), _cut(w, 1)).otherwise(w)
    ))
    ending = f"^(.{{{MIN_STEM},}}?)(?:{'|'.join(SUFFIXES)})$"
    bare = F.regexp_replace(F.regexp_replace(plural, ending, "$1"), ending, "$1")
    no_e = let(bare, lambda w: F.when(w.endswith("e") & (F.length(w) > MIN_STEM), _cut(w, 1)).otherwise(w))
    single = F.regexp_replace(no_e, f"^(.{{{MIN_STEM - 1},}})([a-km-rt-y])\\2$", "$1$2")
    return single


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _spelled(word: Column) -> Column:
    """The first fold that fits; they are listed longest first."""

    def folded(w: Column) -> Column:
        out = w
        for old, new in reversed(SPELLING):
            out = F.when(w.endswith(old) & (F.length(w) >= len(old) + 2), F.concat(_cut(w, len(old)), F.lit(new))).otherwise(out)
        return out

    return let(word, folded)


def stem_token(word: Column) -> Column:
    """Tokens with a digit are identifiers and stay."""
    return F.when(word.rlike("[0-9]"), word).otherwise(stem(word))


def tokens(norm: Column) -> Column:
    """Distinct stems of a normalised name, without stop words unless nothing else is there."""
    stop = F.array(*map(F.lit, STOPWORDS))

    def of(ws: Column) -> Column:
        kept = F.filter(ws, lambda w: ~F.array_contains(stop, w))
        return F.array_distinct(F.transform(F.when(F.size(kept) > 0, kept).otherwise(ws), stem_token))

    return let(F.array_remove(F.split(norm, " "), ""), of)


def grams(word: Column) -> Column:
    """Distinct three-letter grams of the word between two spaces."""
    return let(F.concat(F.lit(" "), word, F.lit(" ")), lambda p: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal stems, the Dice coefficient of grams for long alphabetic ones if at least 0.75, else 0."""
    able = (F.least(F.length(a), F.length(b)) >= FUZZY_MIN) & ~F.concat(a, b).rlike("[^a-z]")
    dice = let(grams(a), lambda x: let(grams(b), lambda y: 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))))
    return F.when(a == b, 1.0).when(able, let(dice, lambda d: F.when(d >= FUZZY_FLOOR, d).otherwise(0.0))).otherwise(0.0)


def abbreviates(short: Column, long: Column) -> Column:
    """An initialism (three letters at least, a plural s allowed) or a numeronym of the other name."""
    words = F.split(long, " ")
    stop = F.array(*map(F.lit, STOPWORDS))
    initials = lambda ws: F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), "")
    numeric = short.rlike("^[a-z][0-9]{1,2}[a-z]$")
    count = F.regexp_extract(short, "^[a-z]([0-9]{1,2})[a-z]$", 1).try_cast("int")
    number = F.exists(F.concat(words, F.array(F.replace(long, F.lit(" "), F.lit("")))), lambda w: (F.length(w) == count + 2) & (F.substring(w, 1, 1) == F.substring(short, 1, 1)) & (F.right(w, F.lit(1)) == F.right(short, F.lit(1))))
    both = F.array(initials(words), initials(F.filter(words, lambda w: ~F.array_contains(stop, w))))
    letters = (F.size(words) >= 2) & (F.length(short) >= 3) & ~short.rlike("[^a-z]") & (F.array_contains(both, short) | (short.endswith("s") & F.array_contains(both, _cut(short, 1))))
    return ~short.contains(" ") & F.length(short).between(2, 8) & F.when(numeric, F.coalesce(number, F.lit(False))).otherwise(letters)


def prepare(name: Column) -> Column:
    """What scoring needs of a name, for each variant: its norm n, run together c and stems t."""
    return F.transform(variants(name), lambda v: F.struct(v.alias("n"), F.replace(v, F.lit(" "), F.lit("")).alias("c"), tokens(v).alias("t")))


def pair_score(left: Column, right: Column, rarity: Column) -> Column:
    """How much two prepared variants look like one thing. rarity: map of stem to weight ('' for any other stem)."""
    weight = lambda t: F.coalesce(F.try_element_at(rarity, t), F.try_element_at(rarity, F.lit("")), F.lit(1.0))
    total = lambda ts: F.aggregate(ts, F.lit(0.0), lambda s, t: s + weight(t))

    def soft(ls: Column, rs: Column) -> Column:
        best = lambda t: F.array_max(F.transform(rs, lambda o: F.struct(likeness(t, o).alias("s"), o.alias("o"))))
        matched = F.aggregate(ls, F.lit(0.0), lambda s, t: s + let(best(t), lambda b: F.when(b["s"] > 0, b["s"] * (weight(t) + weight(b["o"])) / 2).otherwise(0.0)))
        return let(matched, lambda m: let(total(ls) + total(rs) - m, lambda all_: F.when(all_ > 0, m / all_).otherwise(0.0)))

    def inside(a: Column, b: Column) -> Column:
        shorter, longer = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
        return (F.length(shorter) >= CONTAINED_MIN) & F.contains(longer, shorter)

    score = soft(left["t"], right["t"])
    return (
        F.when(left["c"] == right["c"], COMPACT_EQUAL).when(abbreviates(left["n"], right["n"]) | abbreviates(right["n"], left["n"]), ABBREVIATION)
        .when(inside(left["c"], right["c"]), F.greatest(score, F.lit(CONTAINED))).otherwise(score)
    )


def prepared_overlap(xs: Column, ys: Column, rarity: Column) -> Column:
    """Best score over the prepared variants of two names; 0 if either has none."""
    return F.coalesce(F.array_max(F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: pair_score(x, y, rarity))))), F.lit(0.0))


def overlap(a: Column, b: Column, rarity: Column) -> Column:
    """Best score over the variants of both names."""
    return let(prepare(a), lambda xs: let(prepare(b), lambda ys: prepared_overlap(xs, ys, rarity)))


def slug(name: Column) -> Column:
    return F.left(F.replace(normalise(name), F.lit(" "), F.lit("-")), F.lit(48))


def tidy(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def name_as_met(met: Column, canonical: Column) -> Column:
    """The spelling met, if it differs from the name kept in more than case and white space."""
    return F.when(F.lower(tidy(met)) != F.lower(tidy(canonical)), tidy(met))


def fingerprint(session: Column, start: Column, end: Column, term: Column) -> Column:
    """Content id: e- and 26 hex digits of a place and a normalised term."""
    joined = F.concat_ws("|", session.cast("string"), start.cast("string"), end.cast("string"), normalise(term))
    return F.concat(F.lit("e-"), F.upper(F.left(F.sha2(joined, 256), F.lit(26))))


def spot_hash(key: Column, every: int = 5) -> Column:
    """Whether a key falls in the reproducible share of one in so many."""
    return F.conv(F.left(F.sha2(key, 256), F.lit(8)), 16, 10).cast("long") % every == 0


CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid_encode(millis: Column, tail: Column) -> Column:
    """26 characters: ten of the time, sixteen of the tail (hex digits as base 32 here)."""
    digit = lambda v: F.substring(F.lit(CROCKFORD), (v + 1).cast("int"), F.lit(1))
    time = F.array_join(F.transform(F.sequence(F.lit(9), F.lit(0), F.lit(-1)), lambda i: digit(F.pmod(F.floor(millis / F.pow(F.lit(32.0), i)).cast("long"), F.lit(32)))), "")
    return F.concat(time, F.upper(F.rpad(F.left(F.sha2(tail, 256), F.lit(16)), 16, "0")))


def ulid_decode(ulid: Column) -> Column:
    """Milliseconds of the first ten characters."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0).cast("long"), lambda a, i: a * 32 + F.instr(F.lit(CROCKFORD), F.substring(ulid, i, F.lit(1))).cast("long") - 1)


def model_of(version: Column) -> Column:
    """The middle of ``component+model+prompt``; a plus inside the model stays."""
    return F.nullif(F.regexp_extract(version, r"^[^+]*\+(.*)\+[^+]*$", 1), F.lit(""))


def repo_name(path: Column) -> Column:
    return F.nullif(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1), F.lit(""))


def html_strip(html: Column) -> Column:
    """Script and style blocks out, then tags, white space to single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]+>", " "), r"\s+", " "))


def prose(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)```.*?(```|$)", " ")


CONNECTIVES = ("because", "so that", "therefore", "which means", "leads to", "due to", "since")


def keyword_grade(answer: Column, connectives: tuple[str, ...] = CONNECTIVES) -> Column:
    """causal with a connective, listed with a second clause or over 18 words, else isolated."""
    low = F.concat(F.lit(" "), F.lower(answer), F.lit(" "))
    said = F.exists(F.array(*map(F.lit, connectives)), lambda c: F.contains(low, F.concat(F.lit(" "), c, F.lit(" "))))
    clauses = F.size(F.filter(F.split(answer, r"[.;,]"), lambda c: F.length(F.trim(c)) > 0))
    return F.when(said, "causal").when((clauses > 1) | (F.size(F.filter(F.split(answer, r"\s+"), lambda w: w != "")) > 18), "listed").otherwise("isolated")


def list_join(items: Column) -> Column:
    """a, b and c"""
    return F.when(F.size(items) <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), F.size(items) - 1), ", "), F.lit(" and "), F.element_at(items, -1)))


def plural_count(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {noun}").otherwise(f" {noun}s"))


def seconds_between(start: Column, end: Column) -> Column:
    return F.round(F.timestamp_diff("MICROSECOND", start, end) / 1e6, 3)


def citation_check(body: Column, k: Column) -> Column:
    """Every [Sn] is one of the k sources, and at least one is cited."""
    cited = F.transform(F.regexp_extract_all(body, F.lit(r"\[S([0-9]+)\]"), 1), lambda n: n.cast("int"))
    return (F.size(cited) > 0) & F.forall(cited, lambda n: n.between(1, k))
