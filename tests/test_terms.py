"""Terms in texts: linear runs, mentions by words and stems, substrings of any number of terms."""

import random
import time

import pytest
from pyspark.sql import functions as F

from colloquy.operators import probes as P, terms as T


def seconds(spark, words: int) -> float:
    rows = spark.createDataFrame([(1, " ".join(f"w{k % 97}" for k in range(words)))], "id long, text string")
    query = rows.select(F.explode(T.ngrams(T.clean_words(F.col("text")))).alias("run")).agg(F.count("run"))
    query.collect()
    began = time.perf_counter()
    query.collect()
    return time.perf_counter() - began


def test_runs_take_linear_time(spark):
    assert seconds(spark, 40_000) < 40 * max(0.1, seconds(spark, 2_000))  # quadratic would be 400 times


def test_mentions_equal_a_plain_count(spark):
    rng = random.Random(3)
    words = ["cache", "Caches", "the", "index", "indexing", "b-tree", "x"]
    docs = [(k, rng.choice("uv"), None if k == 5 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for k in range(60)] + [(99, "v", "cache the index")] * 2
    terms = ["cache", "the cache", "Index", "b tree x the cache", "indexing the index", "none", "", "cache the cache the cache the cache"]
    docs_df, terms_df = spark.createDataFrame(docs, "id long, unit string, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    clean = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split() if w]
    stem = {"cache": "cach", "caches": "cach", "indexing": "index"}
    stems = lambda t: [stem.get(w, w) for w in clean(t)]
    hits = lambda ws, ts: sum(ws[i : i + len(ts)] == ts for i in range(len(ws) - len(ts) + 1)) if ts else 0
    got = {(r["term"], r["id"]): r["n"] for r in T.mentions(terms_df, docs_df, "id", "text").collect()}
    want = {}
    for i, _, text in docs:
        for t in terms:
            if n := hits(clean(text), clean(t)):
                want[t, i] = want.get((t, i), 0) + n
    assert got == want
    matrix = {r["term"]: r.asDict() for r in T.mention_matrix(terms_df, docs_df.dropDuplicates(["id"]), "id", "unit", "text").collect()}
    once, seen, copies = {i: (u, t) for i, u, t in docs}, set(), set()
    for i in sorted(once):
        key = once[i][1] or ""
        copies |= {i} if key in seen else set()
        seen.add(key)
    assert set(matrix) == set(terms)
    for t in terms:
        for form, of in (("exact", clean), ("stem", stems)):
            found = {i for i, (_, text) in once.items() if hits(of(text), of(t))}
            for name, ids in (("", found), ("_dedup", found - copies)):
                assert matrix[t][f"mentions_{form}{name}"] == len(ids) and matrix[t][f"units_{form}{name}"] == len({once[i][0] for i in ids}), (t, form, name)


@pytest.mark.parametrize("most", [200_000, 10])
def test_substrings_equal_a_plain_search(spark, most):
    """The same rows with the small sides joined by a shuffle instead of broadcast; terms longer than a piece too."""
    rng = random.Random(4)
    long = "".join(rng.choice("abcäß漢 ") for _ in range(5_000))
    texts = [(k, None if k == 3 else "".join(rng.choice("abAB äÄ.\n") for _ in range(rng.randint(0, 60)))) for k in range(80)] + [(7, "aba"), (7, "aba"), (100, long)]
    terms = sorted({"".join(rng.choice("abB ä.") for _ in range(rng.randint(1, 6))) for _ in range(40)} | {long[10:2_500], long[900:1_100].upper(), long[1_020:1_030], "zzz", "", "漢"})
    got = P.contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in terms] * 2, "term string"), "id", "text", most)
    want = sorted((i, t) for i, text in texts for t in terms if t and t.lower() in (text or "").lower())
    assert sorted(map(tuple, got.collect())) == want


def test_equal_terms_and_texts_of_a_repository_are_stemmed_once(spark, monkeypatch):
    from colloquy import state
    from colloquy.operators import probes

    written = []

    def counted(df, name):
        out = state.cut(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(probes, "cut", counted)
    terms = spark.range(400).selectExpr("id", "if(id % 4 = 0, null, 'r1') as repo", "if(id % 2 = 0, 'red boxes', 'blue box') as term")
    texts = spark.range(300).selectExpr("'r1' as repo", "'the red box of cards' as text")
    got = {r["id"]: r["in_repo"] for r in probes.in_repo(terms, texts).collect()}
    assert got == {k: None if k % 4 == 0 else k % 2 == 0 for k in range(400)}
    assert written and max(written) == 2


def test_each_distinct_word_of_texts_is_stemmed_once(spark, monkeypatch):
    written, made = {}, T.cut

    def counted(df, name):
        out = made(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(T, "cut", counted)
    docs = spark.range(400).selectExpr("id", "if(id % 2 = 0, 'u', 'v') as unit", "if(id % 4 = 0, 'red boxes of indexing cards sit', 'a red box of index card sits') as text")
    terms = spark.createDataFrame([("Red boxes of",), ("box",), ("index cards sits",), ("card sit",), ("red",)], "term string")
    got = {r["term"]: tuple(r)[1:] for r in T.mention_matrix(terms, docs, "id", "unit", "text").collect()}
    both, four, three = (400, 2, 2, 2), (100, 1, 1, 1), (300, 2, 1, 1)
    assert got == {"Red boxes of": four + both, "box": three + both, "index cards sits": (0, 0, 0, 0) + both, "card sit": (0, 0, 0, 0) + both, "red": both + both}
    assert written["vocabulary"] == 11 and written["stems"] == 11 - 2  # "a" and "of" begin no asked run and are no second word of one
