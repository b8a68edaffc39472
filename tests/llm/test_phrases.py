"""Phrase collocations against a plain count over whole texts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from colloquy.llm import phrases as P, queries


def plain(rows, least=10, longest=3, inside=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(ws)
            for size in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(ws[k : k + size]) for k in range(len(ws) - size + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {q for p, b in cand.items() for size in range(2, len(p)) for k in range(len(p) - size + 1) if (q := p[k : k + size]) and 100 * b >= inside * cand[q]}
        scored = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string")


def texts(seed: int, n: int):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "A", "the", "über", "x.y", "1", "漢", "\x00", "\x1f", "q", "the", "of"]
    one = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n", ""]) for _ in range(rng.randint(0, 30)))
    return [(one(), rng.choice(["en", "en", "en", None, "", "de"])) for _ in range(n)] + [(None, "en"), ("", None), (None, None), (" .\n", "fr"), ("a a a a a a a a a a a a", "aa")]


@pytest.mark.parametrize(("seed", "longest", "shard", "block"), [(1, 3, 8 << 20, 16 << 20), (2, 3, 60, 100), (3, 4, 300, 50), (4, 2, 1, 1)])
def test_equals_a_plain_count(spark, seed, longest, shard, block):
    rows = texts(seed, 120)
    got = P.collocations(table(spark, rows).repartition(3), longest=longest, shard_bytes=shard, block_bytes=block)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == plain(rows, longest=longest)


def test_bounds_are_upper_bounds(spark):
    """Each run that is frequent over all shards has its bit in every one of them."""
    rows = texts(9, 200)
    counted = {(r["lang"], r["phrase"]): r["f"] for r in P.phrase_counts(table(spark, rows).repartition(5), least=3, shard_bytes=40, block_bytes=64).where("words > 1").collect()}
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").lower()):
            ws = re.findall("[^\x20\x09]+", piece)
            for size in (2, 3):
                f["und" if lang is None else lang].update(" ".join(ws[k : k + size]) for k in range(len(ws) - size + 1))
    assert counted == {(lang, p): a for lang, c in f.items() for p, a in c.items() if a >= 3}


def test_planes_round_trip():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.int64), np.array([0]), np.array([2**32 - 1]), np.unique(rng.integers(0, 2**32, 1000))):
        assert (P.unpacked(P.packed(values)) == values).all()


def test_empty_and_clashing_columns(spark):
    rows = [("x y z " * 20, "en", 1, 2.0)] * 3
    got = P.collocations(spark.createDataFrame(rows, "text string, lang string, shard int, `f` double")).collect()
    assert [tuple(r[c] for c in ("lang", "phrase", "a")) for r in got] and sorted(r["rank"] for r in got) == list(range(1, len(got) + 1))
    assert P.collocations(table(spark, [])).collect() == []
    assert P.collocations(table(spark, [(None, None), ("", "en")])).collect() == []


def test_top_and_long_text(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(" ".join(words) + ". ", "en")] * 10 + [("alpha beta; " * 200_000, "xx")]
    got = sorted(map(tuple, P.collocations(table(spark, rows), inside=101, top=5, shard_bytes=100_000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == plain(rows, inside=101, top=5)


def test_op12_whole_table(spark, small):
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.QUERIES["op12_phrase_collocations"](spark, small)
    assert got.dtypes == [("lang", "string"), *[(c, "bigint") for c in ("rank",)], ("phrase", "string"), *[(c, "bigint") for c in ("a", "l", "r", "n", "score")]]
    assert sorted(map(tuple, got.collect())) == plain(rows)
