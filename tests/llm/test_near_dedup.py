"""Near-dedup of many short texts of common words against a plain search of all pairs that share a shingle."""

import random
from collections import defaultdict

from colloquy.llm import simhash


def shingles(text: str) -> frozenset:
    ws = text.lower().split()
    return frozenset(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4)))


def plain(texts: dict[int, str], least: float = 0.8) -> tuple[dict[int, int], int]:
    """Smallest id of each text's group, and how many pairs link different texts."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    held, pairs = defaultdict(list), set()
    for i in sorted(texts):
        for s in sets[i]:
            pairs |= {(j, i) for j in held[s]}
            held[s].append(i)
    linked = 0
    for j, i in pairs:
        if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
            linked += texts[i] != texts[j]
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return {i: top(i) for i in texts}, linked


def test_5000_short_texts_of_common_words(spark):
    rng = random.Random(11)
    common = "the of and a to in is it that was for on are as with his they at be this".split()
    rare = [f"w{k}" for k in range(60)]
    word = lambda: rng.choice(common) if rng.random() < 0.75 else rng.choice(rare)
    texts = {k: " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 12, 20, 40]))) for k in range(4_000)}
    for k in range(4_000, 5_000):  # copies with a word more, less or other, at one end or within
        ws = texts[rng.randrange(4_000)].split()
        kind, at = rng.randrange(4), rng.randrange(len(ws))
        texts[k] = " ".join({0: [*ws, word()], 1: ws[1:] or ws, 2: [*ws[:at], word(), *ws[at + 1 :]], 3: ws}[kind])
    want, linked = plain(texts)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["id"]: r["component"] for r in simhash.similar_texts(rows).select("id", "component").collect()}
    wrong = [i for i in texts if got[i] != want[i]]
    assert linked > 100 and len(wrong) <= 0.01 * sum(want[i] != i for i in texts), (linked, len(wrong))
    assert all(want[got[i]] == want[i] for i in texts)  # nothing is linked that is not alike


def test_what_meets_does_not_depend_on_the_number_of_texts(spark, monkeypatch):
    """The width of short fingerprints is one for all sizes."""
    seen = []
    made = simhash.sketches
    monkeypatch.setattr(simhash, "TABLE_BITS", 16)
    monkeypatch.setattr(simhash, "sketches", lambda texts, shingle, bits: seen.append(bits) or made(texts, shingle, bits))
    for n in (3, 300):
        simhash.similar_texts(spark.range(n).selectExpr("id as doc_id", "concat('some words of text ', id) as text"))
    assert seen == [16, 16]


def test_fingerprints_meet_where_a_pair_of_other_labels_is_compared(spark):
    """Each pair of different labels within 2 bits meets at one point, and nobody is at a point without such a pair."""
    rng = random.Random(5)
    fps = {k: 0b1111 if k < 40 else 0b1111 ^ (1 << rng.randrange(8)) ^ (1 << rng.randrange(8)) if k < 80 else rng.getrandbits(8) for k in range(120)}
    labels = {k: 0 if k < 70 and k != 7 else k for k in fps}
    sketched = spark.createDataFrame([(k, [f]) for k, f in fps.items()], "id long, tables array<long>")
    met = simhash.ball_meetings(sketched, spark.createDataFrame(list(labels.items()), "id long, label long"), 8).collect()
    at = defaultdict(set)
    for r in met:
        at[r.key].add(r.id)
    here = lambda key, a, b: key == a if a == b else key <= key ^ a ^ b
    found = {(key, x): [y for y in ids if labels[x] != labels[y] and here(key, fps[x], fps[y])] for key, ids in at.items() for x in ids}
    pairs = sorted((x, y) for (_, x), ys in found.items() for y in ys if x < y)
    assert pairs == [(x, y) for x in fps for y in fps if x < y and labels[x] != labels[y] and (fps[x] ^ fps[y]).bit_count() <= 2]
    nodes = defaultdict(int)
    for (key, x), ys in found.items():
        nodes[key, fps[x]] += len(ys)
    assert len(met) == len(found) and all(nodes.values())


def test_a_meeting_whose_pivots_link_nothing_is_joined_once(spark, monkeypatch):
    rng, marked, made = random.Random(6), [], simhash.cut
    texts = [(k, " ".join(f"w{rng.randrange(9_000)}" for _ in range(12))) for k in range(200)]
    rows = spark.createDataFrame(texts, "id long, text string")
    light, sets = rows.selectExpr("id", "xxhash64(id) as s1", "xxhash64(text) as s2"), rows.select("id", simhash.shingle_set("text", 5).alias("set"))

    def counted(df, name, *args, **kwargs):
        out = made(df, name, *args, **kwargs)
        if name == "marked":
            marked.append(out.count())
        return out

    monkeypatch.setattr(simhash, "cut", counted)
    got = simhash.settle(rows.selectExpr("1L as key", "id"), rows.selectExpr("id", "id as label"), light, sets, 0.8).collect()
    assert marked == [200] and all(r.id == r.label for r in got) and len(got) == 200
