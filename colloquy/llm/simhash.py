"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits share a variant that differs from either in at most r. Every
distinct fingerprint therefore emits its ball of radius 1, the shuffle is on variants, and what meets there is
verified. Variants carry one bit each (which flip led there), so a meeting point is a fixed-width aggregate of two
long values whatever the group's size, and at most 65 distinct fingerprints can meet in one.

Copies count once: only distinct fingerprints are linked, their documents follow by a join.

Defined cases: null and empty texts, and texts of white space, have fingerprint zero and are linked like any other;
a null id never names a component while another id is there; repeated rows each come out with the same component;
extra columns are ignored by ``fingerprints``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from colloquy.llm.common import cut, let, lower_ascii, text_of, words
from colloquy.shipping import ship

BITS = 64
#: Hashes turned into bits at once; bounds the memory a long text takes.
BLOCK = 1 << 14


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The bits set in over half of the shingles' hashes, as a signed 64-bit integer."""
    ws = (text or "").encode().lower().split()  # of bytes: exactly A-Z, and exactly the six white-space bytes
    if not ws:
        return 0
    n = max(1, len(ws) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, "i8")
    for at in range(0, n, BLOCK):
        hs = np.fromiter((digest(b" ".join(ws[i : i + shingle]), seed) for i in range(at, min(n, at + BLOCK))), "<u8")
        votes += np.unpackbits(hs.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """id and fp (signed long) of every row; a map over the input's splits."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle, seed) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), F.pandas_udf(run, "long", F.PandasUDFType.SCALAR_ITER)(F.col(text_col)).alias("fp"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def ball_points(points: DataFrame, bits: int = BITS) -> DataFrame:
    """v and all: the points that lie in the balls of two or more distinct fingerprints (column fp), and those fingerprints."""
    masks = F.array(*[F.lit(1 << k if k < BITS - 1 else -(1 << k)).cast("long") for k in range(bits)])
    flips = F.transform(masks, lambda m: F.struct(F.col("fp").bitwiseXOR(m).alias("v"), m.alias("m")))
    own = F.array(F.struct(F.col("fp").alias("v"), F.lit(0).cast("long").alias("m")))
    spread = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a point becomes 65 rows
    ball = points.repartition(spread, "fp").select(F.inline(F.concat(own, flips)))
    met = ball.groupBy("v").agg(F.bit_or("m").alias("m"), F.max(F.col("m") == 0).alias("own"))
    met = met.where((F.bit_count("m") + F.col("own").cast("int")) > 1)
    members = F.concat(
        F.when(F.col("own"), F.array("v")).otherwise(F.array().cast("array<long>")),
        F.transform(F.filter(masks, lambda m: F.col("m").bitwiseAND(m) != 0), lambda m: F.col("v").bitwiseXOR(m)),
    )
    return met.select("v", members.alias("all"))


def links(points: DataFrame, bits: int = BITS) -> DataFrame:
    """Verified edges (a, b), a < b, between distinct fingerprints (column fp) at 2 or fewer differing bits of the lowest so many.

    One edge joins every member of a ball's meeting point to the smallest there; members of one meeting point are
    within 2 bits of each other, so no connection is lost, and there are fewer edges than members.
    """
    star = ball_points(points, bits).select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a < b")
    return star.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct()


def components(points: DataFrame, edges: DataFrame) -> DataFrame:
    """fp and label: the smallest id within reach. points: fp, id (its smallest); edges: a, b.

    Each round takes the least label among neighbours and then jumps to that of the label's own point. A point has at
    most 2,080 possible neighbours, so no neighbour list is hot. Each round is a written table, by as few tasks as its
    rows need; it ends when no label falls, which it does as labels are ids of the points.
    """
    both = cut(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")), "edges")
    n = both.count()
    if not n:
        return points.select("fp", F.col("id").alias("label"))
    none = F.lit((1 << 63) - 1)
    linked = both.select(F.col("x").alias("fp")).distinct()
    labels = cut(points.join(linked, "fp").select("fp", F.coalesce("id", none).alias("label")), "labels", rows=n)
    while True:
        least = both.join(labels, both.y == labels.fp).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(least, labels.fp == least.x).select("fp", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        step = cut(step, "labels", rows=n)
        if step.where("new < old").isEmpty():
            break
        jump = step.groupBy(F.col("old").alias("at")).agg(F.min("new").alias("to")).where("to < at")
        labels = cut(step.join(jump, step.new == jump["at"], "left").select("fp", F.coalesce("to", "new").alias("label")), "jumped", rows=n)
    found = step.select("fp", F.nullif("new", none).alias("label"))
    return points.join(found, "fp", "left").select("fp", F.coalesce("label", "id").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """id, fp and component of every row."""
    found = cut(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    points = cut(found.groupBy("fp").agg(F.min("id").alias("id")), "points")
    return found.join(components(points, links(points.select("fp"))), "fp").select("id", "fp", F.col("label").alias("component"))


# Near-duplicate texts at a stated similarity.
#
# One 64-bit fingerprint of shingles at 2 bits finds only texts that are almost equal: at a Jaccard similarity of 0.8
# some ten bits differ. Texts meet in two ways instead. Bands of minima of the shingles' hashes depend on the similarity
# alone, whatever kind of edit led to it: at 0.8 one of 16 bands of four agrees in 99.98 % of cases. Balls around four
# short fingerprints of the distinct words add what changes one word here and there. All that meets is verified.

#: Bits of a short fingerprint are fixed, so what meets does not depend on how many texts there are. Random meetings of n
#: texts are some n * 2.5e-7 a text (3.7 among 15 million); they cost a comparison of sketches each.
TABLES, TABLE_BITS = 4, 32
BANDS, BAND_ROWS = 16, 4
#: Bits of 128 in which sketches of texts at 0.8 may differ: one bit of each minimum, so 13 on average, 3.4 the
#: deviation; a pair at exactly 0.8 differs in more with a probability of 1e-6.
SKETCH_SLACK = 30
#: Members of a meeting up to which all pairs are compared at once; and members of a block, where larger ones are left.
SMALL, GRID = 32, 512
#: Hashes of a block's sets, 8 MB, on average: long texts make more blocks.
GRID_HASHES = 1 << 20
#: Shingles of a cell that are looked at at once.
COLUMNS = 1 << 12
#: Rounds of pivots at most, before what is still left is compared pair by pair in blocks.
PIVOT_ROUNDS = 6
_RANDOM = np.random.default_rng(301)
_FACTORS, _ADDENDS = _RANDOM.integers(0, 1 << 63, (2, 128), dtype="u8") * np.array([[2], [1]], "u8") + np.array([[1], [0]], "u8")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _votes(items: list[bytes], seeds: tuple[int, ...]) -> np.ndarray:
    """Majority bits of 64 for each seed."""
    votes = np.zeros(64 * len(seeds), "i8")
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(items), BLOCK):
        some = items[at : at + BLOCK]
        hs = np.array([[digest(x, s) for s in seeds] for x in some], "<u8")
        votes += np.unpackbits(hs.view("u1").reshape(len(some), -1), axis=1, bitorder="little").sum(0, dtype="i8")
    return 2 * votes > len(items)


def _minima(ws: list[bytes], shingle: int) -> np.ndarray:
    """The least of the shingles' hashes under each of 128 orders."""
    n = max(1, len(ws) - shingle + 1)
    low = np.full(128, np.iinfo("u8").max, "u8")
    digest, step = xxhash.xxh64_intdigest, 1 << 10  # a block stays in the cache
    for at in range(0, n, step):
        hs = np.fromiter((digest(b" ".join(ws[i : i + shingle]), 201) for i in range(at, min(n, at + step))), "u8")
        low = np.minimum(low, (hs[:, None] * _FACTORS + _ADDENDS).min(0))
    return low


def sketch(text: str | None, shingle: int, bits: int = TABLE_BITS) -> tuple[list[int], list[int], int, int]:
    """TABLES fingerprints of the distinct words (unsigned, of so many bits), BANDS keys, and two longs of one bit a minimum."""
    ws = (text or "").encode().lower().split()
    seeds, kind = ((101, 102), "<u4") if bits <= 32 else ((101, 102, 103, 104), "<u8")
    short = np.packbits(_votes(list(dict.fromkeys(ws)), seeds), bitorder="little").view(kind) if ws else [0] * TABLES
    low = _minima(ws, shingle)
    keys = [xxhash.xxh64_intdigest(low[k * BAND_ROWS : (k + 1) * BAND_ROWS].astype("<u8").tobytes(), k) for k in range(BANDS)]
    signs = np.packbits(((low * _MIX) >> np.uint64(63)).astype(bool), bitorder="little").view("<i8")
    return [int(x) & (1 << bits) - 1 for x in short], [k - (1 << 64) if k >> 63 else k for k in keys], int(signs[0]), int(signs[1])


def sketches(texts: DataFrame, shingle: int, bits: int = TABLE_BITS) -> DataFrame:
    """id, tables and bands (arrays of long), s1, s2 of every row of (id, text)."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in batches:
            yield pd.DataFrame([sketch(t, shingle, bits) for t in some], columns=["tables", "bands", "s1", "s2"])

    made = texts.select("id", F.pandas_udf(run, "tables array<long>, bands array<long>, s1 long, s2 long", F.PandasUDFType.SCALAR_ITER)("text").alias("_s"))
    return made.select("id", "_s.*")


def shingle_set(text: Column, shingle: int) -> Column:
    """Distinct hashes of the word shingles (of fewer words: of the whole sequence)."""
    return let(words(lower_ascii(text)), lambda ws: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - (shingle - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(ws, i, F.lit(shingle))))))


def jaccard(x: Column, y: Column) -> Column:
    """Of two arrays of distinct values."""
    return let(F.size(F.array_intersect(x, y)), lambda n: n / (F.size(x) + F.size(y) - n))


def band_meetings(sketched: DataFrame) -> DataFrame:
    """(key, id, fp: null) of all that share a band's key with another."""
    keys = sketched.select(F.explode("bands").alias("key"), "id")
    shared = keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key", "left_semi")
    return shared.withColumn("fp", F.lit(None).cast("long"))


def ball_meetings(sketched: DataFrame, labels: DataFrame, bits: int = TABLE_BITS) -> DataFrame:
    """(key, id, fp) of all of different labels (id, label) whose fingerprints in a table are within 2 bits: they meet at a point that lies in the balls of both.

    A node is (table, fingerprint). Distinct nodes emit their balls; a point in several balls is a meeting of the ids of
    those nodes, and a node that several texts have is one as well. Meetings are local, so a chain of fingerprints, each
    near the next, is many small meetings and never a large one. A node goes only to those points at which a pair of it is
    compared (``met_here``) and can be of different labels: a fingerprint of many near copies would meet them at every bit.
    """
    nodes = sketched.join(labels, "id").select("id", "label", F.posexplode("tables").alias("t", "f"))
    nodes = cut(nodes.select("id", "label", (F.col("t") * F.lit(1 << bits) + F.col("f")).alias("fp")), "nodes")
    points = cut(nodes.groupBy("fp").agg(F.min("label").alias("lo"), F.max("label").alias("hi")), "points")
    balls = ball_points(points.select("fp"), bits).select(F.col("v").alias("key"), F.explode("all").alias("fp")).join(points, "fp")
    balls = balls.groupBy("key").agg(F.collect_list(F.struct("fp", "lo", "hi")).alias("all"))  # so many as a fingerprint has bits, and one, at most
    apart = lambda a, b: (a["fp"] != b["fp"]) & (F.least(a["lo"], b["lo"]) < F.greatest(a["hi"], b["hi"]))
    here = lambda a, b: F.col("key") <= F.col("key").bitwiseXOR(a["fp"]).bitwiseXOR(b["fp"])
    asked = F.filter("all", lambda a: F.exists("all", lambda b: apart(a, b) & here(a, b)))
    met = balls.select("key", F.explode(F.transform(asked, lambda a: a["fp"])).alias("fp"))
    alone = points.where("lo < hi").select(F.col("fp").alias("key"), "fp")  # its texts are compared at its own point
    return nodes.join(met.unionByName(alone).distinct(), "fp").select("key", "id", "fp")


def met_here(x: str, y: str) -> Column:
    """Whether a pair with these fingerprints is compared at this key: equal ones at their own point, others at the smaller
    of the two points that their balls share. Meetings by other keys have no fingerprints and compare all their pairs."""
    a, b, key = F.col(x), F.col(y), F.col("key")
    return F.coalesce(F.when(a == b, key == a).otherwise(key <= key.bitwiseXOR(a).bitwiseXOR(b)), F.lit(True))


def verified(near: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of the pairs (a, b) those whose sets of shingles are at least so similar."""
    both = near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return both.where(jaccard(F.col("sa"), F.col("sb")) >= least).select("a", "b")


def blockwise(left: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between the members of each meeting (key), dealt over cells of two blocks of some GRID members.

    left: key, id, label and blocks, how many the meeting is dealt into. A task holds one cell with its sets of shingles; of a cell's pairs only a forest of those that are like comes out,
    so there are fewer links than members, however many pairs are compared.
    """
    ship(left.sparkSession)
    block = F.pmod(F.xxhash64("id", F.lit(11)), F.col("blocks")).cast("int")
    cells = left.withColumn("at", block).select("key", "id", "label", "at", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("to"))
    cells = cells.select("key", F.least("at", "to").alias("i"), F.greatest("at", "to").alias("j"), "at", "id", "label").join(sets, "id")

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(forest(cell["id"].to_numpy(), cell["label"].to_numpy(), cell["at"].to_numpy(), list(cell["set"]), cell["i"].iloc[0] == cell["j"].iloc[0], least), columns=["a", "b"])

    return cells.groupBy("key", "i", "j").applyInPandas(run, "a long, b long")


def forest(ids: np.ndarray, labels: np.ndarray, at: np.ndarray, sets: list, inside: bool, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of different labels (and, unless inside, of different blocks) that are like."""
    n, sizes = len(ids), np.array([len(x) for x in sets], "f8")
    values, owners = np.concatenate([np.asarray(x, "i8") for x in sets]), np.repeat(np.arange(n), sizes.astype("i8"))
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    several = count > 1  # what only one text has is in no intersection
    place = np.cumsum(several) - 1
    keep = several[column]
    owners, column = owners[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owners, column = owners[order], column[order]
    shared = np.zeros((n, n), "f8")
    for start in range(0, int(several.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (start, start + COLUMNS))
        part = np.zeros((n, COLUMNS), "f4")
        part[owners[lo:hi], column[lo:hi] - start] = 1
        shared += part @ part.T
    like = shared / np.maximum(sizes[:, None] + sizes[None, :] - shared, 1) >= least
    like &= np.triu(labels[:, None] != labels[None, :], 1)
    if not inside:
        like &= at[:, None] != at[None, :]
    root, out = list(range(n)), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(*map(np.ndarray.tolist, np.nonzero(like)), strict=True):
        x0, y0 = top(x), top(y)
        if x0 != y0:
            root[y0] = x0
            out.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
    return out


def close(s1: str, s2: str, t1: str, t2: str) -> Column:
    return F.bit_count(F.col(s1).bitwiseXOR(F.col(t1))) + F.bit_count(F.col(s2).bitwiseXOR(F.col(t2))) <= SKETCH_SLACK


def settle(meetings: DataFrame, labels: DataFrame, light: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """labels (id, label) after every pair of ids that meet and are not linked already was verified.

    meetings: key, id and fp, if there is one; light: id, s1, s2; sets: id and the distinct shingles. Small meetings compare all their pairs of
    different labels at once. A large one names pivots, compares them with all of its ids of other labels, and lets
    them go; from the second round on the ids that were linked most come first (the original of many copies). Links
    merge labels, and a meeting ends when what is left of it has one label, so likes need pairs in proportion to their
    number. When pivots merge little more, all pairs that are left are compared in blocks: nothing that meets is skipped.
    Where they merge nothing at all, that is done in the same round, for no meeting has changed but by its pivots.
    """
    if "fp" not in meetings.columns:
        meetings = meetings.withColumn("fp", F.lit(None).cast("long"))
    weighed = light.join(sets.select("id", F.size("set").cast("long").alias("w")), "id")
    held, degrees, before = meetings.join(weighed, "id"), None, None
    rows = meetings.count()
    key = F.xxhash64("id")
    for round_ in range(PIVOT_ROUNDS + 1):
        live = held.join(labels, "id")
        live = live.withColumn("deg", F.lit(0).cast("long")) if degrees is None else live.join(degrees, "id", "left").withColumn("deg", F.coalesce("deg", F.lit(0).cast("long")))
        live = cut(live.select("key", "id", "fp", "s1", "s2", "w", "label", "deg"), "live", rows=rows)
        it = F.struct("id", "fp", "s1", "s2", "label")
        hubs = [F.max_by(F.when(F.col("deg") > 0, it), F.when(key.bitwiseAND(1) == k, F.struct("deg", key.alias("k")))) for k in range(2)]
        picked = F.array_distinct(F.array_compact(F.array(F.min_by(it, key), F.min_by(it, F.struct("label", key.alias("k"))), F.max_by(it, F.struct("label", key.alias("k"))), *hubs)))
        blocks = F.greatest(F.ceil(F.count(F.lit(1)) / GRID), F.ceil(F.sum("w") / GRID_HASHES)).alias("blocks")
        found = cut(live.groupBy("key").agg(F.count(F.lit(1)).alias("n"), blocks, F.min("label").alias("lo"), F.max("label").alias("hi"), picked.alias("picked")).where("lo < hi").drop("lo", "hi"), "found", rows=rows)
        large = F.when(F.col("n") > SMALL, F.col("n").cast("double"))
        keys, pairs = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(large * large), F.lit(0.0))).first()
        if not keys:
            return labels
        last = not pairs or round_ == PIVOT_ROUNDS or before is not None and pairs > before / 2
        pivot = (F.col("n") <= SMALL) | (F.array_contains("picked.id", F.col("id")) & F.lit(not last))
        marked = cut(live.join(found, "key").select("key", "id", "fp", "label", "s1", "s2", "w", "blocks", pivot.alias("pivot"), (F.col("n") > SMALL).alias("large"), F.when((F.col("n") > SMALL) & F.lit(not last), F.col("picked")).alias("picked")), "marked", rows=rows)
        # in a small meeting all pairs are compared; a member of a large one carries its few pivots, so rows stay those of members
        few = marked.where("not large")
        one = few.select("key", F.col("id").alias("p"), F.col("label").alias("pl"), F.col("fp").alias("pf"), F.col("s1").alias("p1"), F.col("s2").alias("p2"))
        other = few.select("key", F.col("id").alias("q"), F.col("label").alias("ql"), F.col("fp").alias("qf"), "s1", "s2")
        alike = (F.col("pl") != F.col("ql")) & close("p1", "p2", "s1", "s2") & met_here("pf", "qf")
        met = one.join(other, "key").where((F.col("p") < F.col("q")) & alike).select("p", "q")
        bits = lambda x, s: F.bit_count(x[s].bitwiseXOR(F.col(s)))
        at_key = lambda x: F.coalesce(F.when(x["fp"] == F.col("fp"), F.col("key") == x["fp"]).otherwise(F.col("key") <= F.col("key").bitwiseXOR(x["fp"]).bitwiseXOR(F.col("fp"))), F.lit(True))
        fits = lambda x: (x["label"] != F.col("label")) & (bits(x, "s1") + bits(x, "s2") <= SKETCH_SLACK) & at_key(x) & (~F.col("pivot") | (x["id"] < F.col("id")))
        carried = marked.where("large").select(F.col("id").alias("q"), F.explode(F.filter("picked", fits)).alias("_p"))  # a row only for a pivot that is alike
        met = met.unionByName(carried.select(F.col("_p.id").alias("p"), "q"))
        near = cut(met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "near")
        edges = verified(near, sets, least)
        left = marked.where("large and not pivot")
        held = left.select("key", "id", "fp", "s1", "s2", "w")
        edges = cut(edges, "edges")
        if pairs and (last or edges.isEmpty()):
            edges, last = cut(edges.union(blockwise(left, sets, least)).distinct(), "edges"), True
        degrees, before = edges.select(F.col("a").alias("id")).union(edges.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("deg")), pairs
        named = edges.join(labels.toDF("a", "x"), "a").join(labels.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        named = cut(named, "named", rows=rows)
        points = named.select(F.col("a").alias("fp")).union(named.select("b")).distinct().select("fp", F.col("fp").alias("id"))
        moved = components(cut(points, "points", rows=rows), named).toDF("label", "to")
        labels = cut(labels.join(moved, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
        if last or not pairs:
            return labels
    return labels


def similar_texts(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, h (hash of the text), component and first of every row: texts at least so similar are linked.

    Equal texts are one class first; classes are linked by verified pairs. component is the smallest id of a group (null
    if it has none); first marks the rows of one (id, text) in each group: the one of smallest id, then of least hash,
    so an id with several texts stands for one of them only. Rows without an id are grouped by their texts like others.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).withColumn("h", F.unhex(F.sha2("text", 256)))
    # a class has a number of its own, for an id may come with several texts
    classes = cut(keyed.groupBy("h").agg(F.min("id").alias("first")).withColumn("class", F.monotonically_increasing_id()), "classes")
    rows, least_id = keyed.alias("k"), classes.alias("c")
    one = rows.join(least_id, (F.col("k.h") == F.col("c.h")) & F.col("k.id").eqNullSafe(F.col("c.first"))).select(F.col("class").alias("id"), "text")
    sketched = cut(sketches(one, shingle, TABLE_BITS).dropDuplicates(["id"]), "sketches")
    light, labels = sketched.select("id", "s1", "s2"), sketched.select("id", F.col("id").alias("label"))

    def settled(meetings: DataFrame, labels: DataFrame) -> DataFrame:
        meetings = cut(meetings, "meetings")
        asked = classes.join(meetings.select(F.col("id").alias("class")).distinct(), "class", "left_semi").alias("c")
        texts = rows.join(asked, (F.col("k.h") == F.col("c.h")) & F.col("k.id").eqNullSafe(F.col("c.first"))).select(F.col("class").alias("id"), "text").dropDuplicates(["id"])
        sets = cut(texts.select("id", shingle_set("text", shingle).alias("set")), "sets")  # once a text, not once a pair
        return settle(meetings, labels, light, sets, least)

    labels = settled(band_meetings(sketched), labels)
    labels = settled(ball_meetings(sketched, labels, TABLE_BITS), labels)
    named = labels.join(classes.select(F.col("class").alias("id"), "h", "first"), "id")
    order = F.struct(F.col("first").isNull().alias("none"), F.col("first"), F.col("h"))
    heads = named.groupBy("label").agg(F.min(order).alias("head"))
    groups = named.join(heads, "label").select("h", F.col("head.first").alias("component"), (F.col("head.h") == F.col("h")).alias("heads"))
    return keyed.select("id", "h").join(groups, "h").select("id", "h", "component", (F.col("heads") & F.col("id").eqNullSafe(F.col("component"))).alias("first"))


def op9(spark, sf_dir: str) -> DataFrame:
    from colloquy.llm.common import read

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
