"""Phrase collocations: sketch upper bounds choose candidates, automata count them exactly, thresholds come last.

1. Texts are lower-cased and packed, where they lie, into shards of one language and some megabytes each.
2. Every shard hashes its distinct word runs to the cells of a sketch and sends (cell, count) lists by block of cells.
   A cell's sum over all shards is an upper bound of the count of every run in it. Each block answers each shard with
   one bit a cell: whether its bound reaches the least count. The sketch is a table that is dealt over blocks; its width
   follows the input (some six cells a run), no task holds more than a block, and nothing of it is broadcast.
3. The runs of a shard whose bit is set compile into an Aho-Corasick automaton of that shard. Patterns have a space on
   both sides and pieces are parted by a line feed of their own, so matches are whole words inside one piece; they may
   overlap. A run that is frequent over all shards has its bit in each, so the sums over shards are exact.
4. Scores, containment and ranks are joins and windows on the summed counts, which are few beside the text.

Defined cases: a null or empty text has no words; a null language is ``und``; repeated rows all count; a long text runs
over as many shards as it needs (cut between pieces; a piece without a delimiter stays in one); an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.llm.common import cut, ranked, read
from colloquy.shipping import ship

SHARD_BYTES = 4 << 20
#: Bytes of text whose runs meet in one block of the sketch.
BLOCK_BYTES = 16 << 20
#: What ends a piece, and what parts words besides the space.
ENDS, TAB = b".,;:!?\x0a\x0b\x0c\x0d", b"\t"
CLEAN = bytes.maketrans(ENDS + TAB, b"\n" * len(ENDS) + b" ")
SHARD, CELLS, BITS, COUNTS = "shard long, lang string, size long, body binary", "block long, shard long, cells binary, counts binary", "shard long, block long, bits binary, n long", "lang string, words int, phrase string, f long"


def shards(docs: DataFrame, text_col: str, lang_col: str, shard_bytes: int) -> DataFrame:
    """One row a shard: its language and the packed pieces of texts, a line feed after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, held, sizes, number = zstandard.ZstdCompressor(level=3).compress, {}, Counter(), TaskContext.get().partitionId() << 32

        def row(lang: str) -> pa.RecordBatch:
            nonlocal number
            body, number = b"\n".join(held.pop(lang)), number + 1
            return pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int64()), "lang": [lang], "size": pa.array([len(body)], pa.int64()), "body": pa.array([press(body)], pa.binary())})

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                if not (raw := text.as_buffer()):
                    continue
                lang, clean, start = lang.as_py(), raw.to_pybytes().lower().translate(CLEAN), 0
                while start < len(clean):
                    end = clean.find(b"\n", start + shard_bytes) if len(clean) - start > shard_bytes else -1
                    part = clean[start : end if end >= 0 else len(clean)]
                    start += len(part) + 1
                    held.setdefault(lang, []).append(part)
                    sizes[lang] += len(part)
                    if sizes[lang] >= shard_bytes:
                        yield row(lang)
                        del sizes[lang]
                    elif sizes.total() >= 4 * shard_bytes:  # many languages: the fullest goes early
                        full = sizes.most_common(1)[0][0]
                        yield row(full)
                        del sizes[full]
        for lang in list(held):
            yield row(lang)

    asked = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    return asked.mapInArrow(run, SHARD)


class Runs:
    """The distinct word runs of a shard. ids: each word's number, 0 between pieces."""

    def __init__(self, lang: str, body: bytes, longest: int, cell_bits: int):
        self.tokens = [w for w in zstandard.ZstdDecompressor().decompress(body).replace(b"\n", b" \n ").split(b" ") if w]
        known = {b"\n": 0}
        self.ids = np.fromiter((known.setdefault(w, len(known)) for w in self.tokens), np.int64, len(self.tokens))
        self.words = list(known)
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.words], np.uint64)
        firsts, cells, counts, self.sizes = [], [], [], []
        key, inside = self.ids, self.ids != 0
        for n in range(2, longest + 1):
            last = self.ids[n - 1 :]
            key, inside = key[: len(last)], inside[: len(last)] & (last != 0)
            at = np.flatnonzero(inside)
            _, first, place, count = np.unique((key[at] << 32) | last[at], return_index=True, return_inverse=True, return_counts=True)
            key = np.zeros(len(last), np.int64)
            key[at] = place + 1
            first = at[first]
            mixed = np.full(len(first), n, np.uint64)
            for k in range(n):
                mixed = (mixed ^ hashes[self.ids[first + k]]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            firsts.append(first)
            cells.append(mixed >> np.uint64(64 - cell_bits))
            counts.append(count)
            self.sizes.append(len(first))
        self.firsts = np.concatenate(firsts)
        self.lengths = np.repeat(np.arange(2, longest + 1), self.sizes)
        self.cells, self.cell_of = np.unique(np.concatenate(cells), return_inverse=True)
        self.cell_counts = np.bincount(self.cell_of, np.concatenate(counts), len(self.cells)).astype(np.int64)

    def blocks(self, block_bits: int, cell_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The blocks that hold a cell of the shard, and where in ``cells`` each begins (with the end)."""
        own, start = np.unique(self.cells >> np.uint64(cell_bits - block_bits), return_index=True)
        return own.astype(np.int64), np.append(start, len(self.cells))

    def phrase(self, k: int) -> bytes:
        return b" ".join(self.tokens[self.firsts[k] : self.firsts[k] + self.lengths[k]])


def packed(values: np.ndarray) -> bytes:
    """Ascending numbers below 2**32 as byte planes of their differences."""
    steps = np.diff(values, prepend=0).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view("u1").reshape(-1, 4).T).tobytes())


def unpacked(held: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(held), "u1").reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def sketch_bits(packs: DataFrame, least: int, longest: int, cell_bits: int, block_bits: int) -> DataFrame:
    """Per shard and block of cells: one bit for each of the shard's cells there, set where the sketch reaches ``least``."""
    top = min(least, 65_535)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for shard, lang, body in zip(batch["shard"], batch["lang"], batch["body"], strict=True):
                runs = Runs(lang, body, longest, cell_bits)
                own, start = runs.blocks(block_bits, cell_bits)
                low = (runs.cells & np.uint64((1 << (cell_bits - block_bits)) - 1)).astype(np.int64)
                counts = np.minimum(runs.cell_counts, top).astype("<u2")
                spans = list(zip(start[:-1], start[1:], strict=True))
                yield pd.DataFrame({"block": own, "shard": shard, "cells": [packed(low[a:b]) for a, b in spans], "counts": [press(counts[a:b].tobytes()) for a, b in spans]})

    def bounds(group: pd.DataFrame) -> pd.DataFrame:
        lists = [unpacked(x) for x in group["cells"]]
        counts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<u2") for x in group["counts"]]
        _, of = np.unique(np.concatenate(lists), return_inverse=True)
        reached = (np.bincount(of, np.concatenate(counts)) >= top)[of]
        ends = np.cumsum([len(x) for x in lists])
        bits = [np.packbits(x).tobytes() for x in np.split(reached, ends[:-1])]
        return pd.DataFrame({"shard": group["shard"], "block": group["block"], "bits": bits, "n": [len(x) for x in lists]})

    return packs.mapInPandas(cells, CELLS).groupBy("block").applyInPandas(bounds, BITS)


def phrase_counts(docs: DataFrame, least: int = 10, longest: int = 3, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, words, phrase, f: exact counts of all single words, and of all runs of 2 to longest words that occur at least ``least`` times."""
    ship(docs.sparkSession)
    packs = cut(shards(docs, text_col, lang_col, shard_bytes), "shards", "none")
    size = packs.agg(F.sum("size")).first()[0] or 0
    block_bits = max(4, (size // block_bytes).bit_length())
    cell_bits = min(62, max(20, size.bit_length() + 1, block_bits + 8))
    bits = sketch_bits(packs, least, longest, cell_bits, block_bits)
    masks = bits.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("block", "bits", "n"))).alias("blocks"))  # a bit for each run of a shard

    def rows(lang: str, sizes: np.ndarray, names: list[str], found: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(names), pa.string()), "words": pa.array(sizes, pa.int32()), "phrase": pa.array(names, pa.string()), "f": pa.array(found, pa.int64())})

    def frequent(runs: Runs, chosen: np.ndarray) -> tuple[list[str], list[int]]:
        import ahocorasick

        phrases = [runs.phrase(k).decode() for k in chosen]
        automaton = ahocorasick.Automaton()
        for k, phrase in enumerate(phrases):
            automaton.add_word(f" {phrase} ", k)
        automaton.make_automaton()
        counted = Counter(map(itemgetter(1), automaton.iter(f" {b' '.join(runs.tokens).decode()} ")))
        return phrases, [counted[k] for k in range(len(phrases))]

    def counts(lang: str, body: bytes, blocks: list | None) -> Iterator[pa.RecordBatch]:
        runs = Runs(lang, body, longest, cell_bits)
        yield rows(lang, np.ones(len(runs.words) - 1), [w.decode() for w in runs.words[1:]], np.bincount(runs.ids, minlength=len(runs.words))[1:])
        reached = np.concatenate([np.zeros(0, "u1"), *[np.unpackbits(np.frombuffer(b["bits"], "u1"), count=b["n"]) for b in blocks or ()]])
        chosen = np.flatnonzero(reached[runs.cell_of])
        if len(chosen):
            yield rows(lang, runs.lengths[chosen], *frequent(runs, chosen))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in zip(*batch.columns, strict=True):
                yield from counts(*(x.as_py() for x in shard))  # one shard's arrays and automaton are gone before the next

    found = packs.join(masks, "shard", "left").select("lang", "body", "blocks").mapInArrow(scan, COUNTS)
    return found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("words") == 1) | (F.col("f") >= least))


def _run(start: Column, size: Column) -> Column:
    """So many words of a phrase from a place on."""
    return F.array_join(F.slice(F.split("phrase", " "), start, size), " ")


def _runs(n: int) -> Column:
    """All runs of n words in a phrase."""
    return F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda at: _run(at, F.lit(n)))


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, inside: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score (floor(1000000 a a / (l r)) of the lowest cut).

    A candidate goes if a longer one that holds it reaches ``inside`` percent of its count. Counts up to 10**15 are exact.
    """
    counts = cut(phrase_counts(docs, least, longest, text_col, lang_col, shard_bytes, block_bytes), "phrases")
    totals = counts.where("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = counts.where(F.col("f") >= least)
    candidates = frequent.where("words > 1").withColumnRenamed("f", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "words", "phrase", "a", "k", _run(F.lit(1), F.col("k")).alias("left"), _run(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    left, right = frequent.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), frequent.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    exact = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")), wide("l") * wide("r"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", exact)
    lowest = scored.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    holds = [candidates.where(F.col("words") > n).select("lang", F.explode(F.array_distinct(_runs(n))).alias("phrase"), "a") for n in range(2, longest)]
    if holds:
        within = reduce(DataFrame.unionByName, holds).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        lowest = lowest.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100).cast("decimal(4,0)") * wide("longer") < F.lit(inside).cast("decimal(4,0)") * wide("a")))
    found = lowest.select("lang", "phrase", "a", "low.score", "low.l", "low.r")
    placed = cut(ranked(found, [F.asc("lang"), F.desc("score"), F.desc("a"), F.asc("phrase")], "_rank"), "placed")
    starts = placed.groupBy("lang").agg(F.min("_rank").alias("_start"))
    best = placed.join(starts, "lang").withColumn("rank", F.col("_rank") - F.col("_start") + 1).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents").select("lang", "text"))


def oracle_sql() -> str:
    """The same in DuckDB's SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    gram = lambda n: f"select lang, {n} as words, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i+{n - 1}], ' '))) as phrase from pieces where len(w) >= {n}"
    part = lambda a, b: f"array_to_string(string_split(phrase, ' ')[{a}:{b}], ' ')"
    return rf"""
with lowered as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{upper}', '{lower}') as t from documents),
 pieces as (select lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') as w from (select lang, unnest(string_split_regex(t, '[.,;:!?\n-\r]')) as p from lowered)),
 counts as (select lang, words, phrase, count(*) as f from (select lang, 1 as words, unnest(w) as phrase from pieces union all {gram(2)} union all {gram(3)}) group by all),
 totals as (select lang, sum(f) as n from counts where words = 1 group by lang),
 cand as (select lang, words, phrase, f as a from counts where words > 1 and f >= 10),
 cuts as (select lang, phrase, a, 1 as k, {part(1, 1)} as lp, {part(2, 'words')} as rp from cand union all select lang, phrase, a, 2, {part(1, 2)}, {part(3, 3)} from cand where words = 3),
 scored as (select c.lang, c.phrase, a, k, x.f as l, y.f as r, (1000000::hugeint * a * a) // (x.f::hugeint * y.f) as score from cuts c join counts x on x.lang = c.lang and x.phrase = c.lp join counts y on y.lang = c.lang and y.phrase = c.rp),
 low as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
 inner_ as (select lang, {part(1, 2)} as phrase, a from cand where words = 3 union all select lang, {part(2, 3)}, a from cand where words = 3),
 within_ as (select lang, phrase, max(a) as longer from inner_ group by all),
 kept as (select low.* from low left join within_ using (lang, phrase) where longer is null or 100::hugeint * longer < 50::hugeint * a),
 placed as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from placed join totals using (lang) where rank <= 2000
"""
