"""Each operator against a brute-force version, and on awkward rows."""

from __future__ import annotations

import collections
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm import bitplanes, decision_list, entropy_mix, external_shuffle, imatch, license_scan, pages, simhash, transducer, url_rules
from colloquy.llm.common import local_rows, ranked

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k % 997}x{k}" for k in range(30_000))
TEXTS = [
    (0, "the quick brown fox jumps over the lazy dog\nsecond line here\nsecond line here", "a"), (1, None, "a"), (2, "", None), (3, " \t\n ", "b"), (4, "one", "b"), (5, LONG, "c"),
    (6, "the quick brown fox jumps over the lazy dog\nsecond line here\nsecond line here", "c"), (7, "a b c d e a b c d e a b c d e f", "a"), (8, "Ünïcode ÄÖ ß 漢字 emoji 👍🏽 <|endoftext|> 's DON'T", "b"),
    (9, "|#*$ %& <> || ##", "c"), (None, "no id here at all", "c"), (7, "a b c d e a b c d e a b c d e f", "a"), (10, "x" * 5000, "a"), (11, "tail of the list with ten words or so in it\v\f\r more", "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns have names that operators use themselves
    rows = [(i, t, "en", s, 0, 1, "x", 2.0, True) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, rate double, kept boolean")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def word_list(t):
    return WORD.findall(t or "")


def test_text_statistics_are_those_of_a_plain_count(docs):
    rows = decision_list.text_statistics(docs.withColumn("k", F.monotonically_increasing_id()), "k").collect()
    plain = [t for _, t, _ in TEXTS]
    got = collections.Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    want = collections.Counter()
    for t in plain:
        ws = word_list(t)
        seen = collections.Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        inside = {i + j for i in range(len(ws) - 4) if seen[tuple(ws[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want[(len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside))] += 1
    assert got == want


def test_decision_list_learns_a_threshold_and_keeps_clean_rows(spark):
    rows = [(i, ("%% " if i % 5 == 0 else "") + " ".join(f"w{i}a{j}" + ("###" if i % 5 == 0 else "") for j in range(30)), 0 if i % 5 == 0 else 1) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    judged = decision_list.quality_rules(table.drop("quality"), table.select("doc_id", "quality"))
    assert {(r.doc_id % 5 == 0, r.kept) for r in judged.collect()} == {(True, False), (False, True)}


def test_decision_list_without_labels_or_rows(docs, empty, spark):
    none = spark.createDataFrame([(0, None), (1, 1)], "doc_id long, quality int")
    judged = decision_list.quality_rules(docs, none)
    assert judged.count() == len(TEXTS) and judged.where("rule is not null").isEmpty()
    assert decision_list.quality_rules(empty, none).isEmpty()


def test_held_out_precision_of_rules():
    rng = np.random.default_rng(3)
    rows = [{f: float(rng.random()) for f in decision_list.FEATURES} | {"doc_id": k} for k in range(900)]
    for r in rows:
        r["bad"] = int(r["symbol_share"] > 0.7 and r["n_words"] < 0.5 or r["upper_share"] > 0.9)
    rules = decision_list.cover(rows)
    fresh = [{f: float(rng.random()) for f in decision_list.FEATURES} for _ in range(2000)]
    said = [any(all(t.holds(r) for t in rule.tests) for rule in rules) for r in fresh]
    true = [r["symbol_share"] > 0.7 and r["n_words"] < 0.5 or r["upper_share"] > 0.9 for r in fresh]
    assert sum(a == b for a, b in zip(said, true, strict=True)) / 2000 > 0.95


@pytest.fixture(scope="module")
def word_bpe():
    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_transducer_equals_the_library(docs, word_bpe):
    path, library = word_bpe
    rows = transducer.encode_documents(docs.withColumn("ids", F.lit(0)), path, most_words=50).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.n_tokens == len(want) and r.decoded == library.decode(want, skip_special_tokens=False)


def test_transducer_on_nothing(empty, word_bpe):
    assert transducer.encode_documents(empty, word_bpe[0]).isEmpty()


def test_lexicon_shares_suffixes_and_finds_exactly_its_words():
    held = {w.encode(): [k, k + 1][: 1 + k % 2] for k, w in enumerate(sorted({a + b for a in ("", "un", "re", "é") for b in ("do", "doing", "make", "making", "makings")}))}
    lexicon = transducer.Lexicon.mapped(transducer.Lexicon.compile(held).dump())
    for w, ids in held.items():
        assert lexicon.find(w) == np.array(ids, "<u4").tobytes()
    for w in (b"", b"d", b"undoin", b"makingss", b"x", "é".encode()):
        assert lexicon.find(w) is None
    assert len(lexicon) == len(held) and len(lexicon.first) - 1 < sum(map(len, held)) / 3


def test_every_character_is_encoded_as_in_the_library(word_bpe):
    path, library = word_bpe
    content = open(path).read()
    codec = transducer.Codec(transducer.WordBpe(content), transducer.build(content, []))
    for at in range(1, 0x30000, 7):
        if not 0xD800 <= at < 0xE000:
            text = f"a{chr(at)}b {chr(at)} 'S"
            assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, hex(at)


def test_long_words_merge_like_short_ones(word_bpe):
    bpe = transducer.WordBpe(open(word_bpe[0]).read())
    for w in ("internationalisation", "aaaaaaaaaaaaaaaaab", "zxqjk" * 9, "é" * 20):
        assert bpe.merge(w) == bpe.merge_long(w)


def test_many_words_merge_as_one_by_one(word_bpe):
    bpe = transducer.WordBpe(open(word_bpe[0]).read())
    rng = np.random.default_rng(4)
    some = ["a", "é", "the", "漢字", "👍", *{"".join(rng.choice(list("abetinorsth漢é👍"), rng.integers(1, 30))) for _ in range(500)}]
    assert [np.frombuffer(b, "<u4").tolist() for b in bpe.merge_many(some)] == [bpe.merge(w) for w in some]
    assert bpe.merge_many([]) == []


@pytest.mark.parametrize("plane", ["bit", "byte"])
def test_bit_planes_round_trip(docs, spark, tmp_path, plane):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    out = f"file://{tmp_path}/{plane}"
    bitplanes.write_ids(docs, path, out, plane=plane, block=512)
    got = bitplanes.read_ids(spark, out).orderBy("start").collect()
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0))
    assert [r.doc_id for r in got] == [x[0] for x in order]
    at = 0
    for r, (_, t, _) in zip(got, order, strict=True):
        want = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert list(r.ids) == want and r.start == at and r.n_tokens == len(want)
        at += len(want)
    crc = {(r.start, r.ids_crc32) for r in bitplanes.read_ids(spark, out, digest=True).collect()}
    assert crc == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}


def test_bit_planes_of_nothing(empty, spark, tmp_path):
    bitplanes.write_ids(empty, public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/none")
    assert bitplanes.read_ids(spark, f"file://{tmp_path}/none").isEmpty()


def test_planes_of_edge_blocks():
    for ids in ([], [0], [0, 0, 0], [50256] * 9, list(range(70_000))):
        a = np.array(ids, "<u4")
        for plane in ("bit", "byte"):
            assert (bitplanes.from_planes(bitplanes.to_planes(a, plane), len(a), plane) == a).all()


def test_targets_are_capped_and_reshared():
    got = entropy_mix.targets([("a", 10), ("b", 1000), ("c", 1000), (None, 500)])
    assert got["a"] == 30 and math.isclose(sum(got.values()), 2510)
    assert all(v <= 3 * n for v, n in ((got["a"], 10), (got["b"], 1000), (got["c"], 1000), (got[None], 500)))
    assert math.isclose(got["b"] / got["c"], 2)


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 80))), f"s{k % 4}" if k % 9 else None) for k in range(4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = entropy_mix.mix(table).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    for rs in by.values():
        assert rs[0].source_size == sum(r.size for r in rs)
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 0.01 * rs[0].target + 80
        assert abs(sum(r.rate * r.size for r in rs) - rs[0].target) < 1e-3 * rs[0].target
    again = entropy_mix.mix(table.repartition(3)).collect()
    assert {(r.doc_id, r.copies) for r in got} == {(r.doc_id, r.copies) for r in again}


def test_sources_as_a_table_mix_like_those_of_the_driver(spark, docs, monkeypatch):
    rng = np.random.default_rng(15)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 60))), f"s{int(rng.integers(0, 12)) ** 2}" if k % 9 else None) for k in range(900)] + [(1000 + k, "", "none") for k in range(3)]
    for table in (spark.createDataFrame(rows, "doc_id long, text string, source string"), docs):
        few = entropy_mix.mix(table).collect()
        monkeypatch.setattr(entropy_mix, "MOST_SOURCES", 0)
        many = entropy_mix.mix(table).collect()
        monkeypatch.undo()
        plain = lambda rs: collections.Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), round(r.rate, 6), r.copies) for r in rs)
        assert plain(few) == plain(many)


def test_mix_of_awkward_rows(docs, empty):
    got = entropy_mix.mix(docs).collect()
    assert len(got) == len(TEXTS) and all(r.taken <= 3 * r.size for r in got)
    assert entropy_mix.mix(empty).isEmpty()
    mixed = entropy_mix.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert entropy_mix.mixed_documents(empty).isEmpty()


@pytest.mark.parametrize("bucket_bytes", [2000, 1 << 20])
def test_shards_are_even_and_whole(docs, tmp_path, bucket_bytes):
    got = external_shuffle.external_shuffle(docs, f"file://{tmp_path}/{bucket_bytes}", shards=4, bucket_bytes=bucket_bytes).collect()
    counts = collections.Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == {0, 1, 2, 3}
    for k in counts:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(counts[k]))
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter((i, t) for i, t, _ in TEXTS)


def test_shards_agree_over_reruns_and_mix(spark, tmp_path):
    table = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    a, b = (external_shuffle.external_shuffle(t, f"file://{tmp_path}/{k}", bucket_bytes=3000).collect() for k, t in enumerate((table, table.repartition(5))))
    assert {(r.doc_id, r.shard, r.slot) for r in a} == {(r.doc_id, r.shard, r.slot) for r in b}
    order = [r.doc_id for r in sorted(a, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order) and abs(np.corrcoef(order, range(500))[0, 1]) < 0.2


def test_copies_of_one_row_scatter(spark, tmp_path):
    table = spark.range(300_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one text").alias("text")).union(spark.range(3000).select("id", F.lit(None).cast("string")))
    got = external_shuffle.external_shuffle(table, f"file://{tmp_path}/hot", shards=8, bucket_bytes=100_000)
    by = got.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last"), F.count_if(F.col("text").isNull()).alias("others")).collect()
    assert len(by) == 8 and sum(r.n for r in by) == 303_000 and all(r.n == r.slots == r["last"] + 1 and 250 < r.others < 500 for r in by)
    buckets = external_shuffle.scattered(table, 17, "doc_id", "text").groupBy(F.pmod("_key", F.lit(50)).alias("b")).count().collect()
    assert len(buckets) == 50 and max(r["count"] for r in buckets) < 1.1 * 303_000 / 50


def test_shards_of_nothing(empty, tmp_path):
    assert external_shuffle.external_shuffle(empty, f"file://{tmp_path}/none").isEmpty()


def plain_fingerprint(t):
    ws = word_list(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_components_equal_all_pairs(spark, docs):
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{rng.integers(0, 5000)}" for _ in range(400)) for _ in range(40)]
    rows = [(i, t) for i, t, _ in TEXTS] + [(100 + k, base[k % 40] if k < 60 else base[k % 40].replace(" w", f" v{k} w", 1)) for k in range(140)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(table).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    assert collections.Counter((r.id, r.fp & (1 << 64) - 1) for r in got) == collections.Counter((i, f) for (i, _), f in zip(rows, fps, strict=True))
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
                    label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
                    changed = True
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(least.get(x, 1 << 60), i)
    want = collections.Counter((i, least.get(x)) for (i, _), x in zip(rows, label, strict=True))
    assert collections.Counter((r.id, r.component) for r in got) == want


def test_simhash_of_nothing(empty):
    assert simhash.near_duplicates(empty).isEmpty() and simhash.similar_texts(empty).isEmpty()


def test_similar_texts_find_near_copies_and_leave_others(spark):
    rng = np.random.default_rng(2)
    base = [[f"w{rng.integers(0, 3000)}" for _ in range(300)] for _ in range(60)]
    rows = [(k, " ".join(b)) for k, b in enumerate(base)]
    for k, b in enumerate(base):
        edited = list(b)
        for at in rng.choice(300, 3, replace=False):
            edited[at] = f"new{at}"
        rows += [(100 + k, " ".join(edited)), (200 + k, " ".join(b)), (300 + k, " ".join(b[:150] + [f"other{j}" for j in range(150)]))]
    got = {r.id: r.component for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = sum(got[100 + k] == k for k in range(60))
    assert near >= 58 and all(got[200 + k] == k for k in range(60)) and all(got[300 + k] == 300 + k for k in range(60))


def test_an_id_with_two_texts_and_rows_without_one(spark):
    rng = np.random.default_rng(4)
    a, b, c = (" ".join(f"w{x}" for x in rng.integers(0, 9000, 80)) for _ in range(3))
    rows = [(3, a), (7, a), (7, b), (None, c), (None, c), (None, b), (9, None), (10, "")]
    got = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    first = collections.Counter((r.id, r.component) for r in got if r.first)
    assert len(got) == len(rows) and first == collections.Counter([(3, 3), (7, 7), (None, None), (None, None), (9, 9)])


def test_meetings_left_by_pivots_are_compared_in_blocks(spark, monkeypatch):
    """Many unlike texts and a few like pairs meet under one key."""
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9000, 60)) for _ in range(150)]
    texts += [t.replace(t.split()[30], "other", 1) for t in texts[:40]]
    monkeypatch.setattr(simhash, "SMALL", 2)
    monkeypatch.setattr(simhash, "GRID", 16)
    monkeypatch.setattr(simhash, "band_meetings", lambda sketched: sketched.select(F.lit(1).cast("long").alias("key"), "id"))
    got = {r.id: r.component for r in simhash.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(150)] == list(range(150)) and [got[150 + k] for k in range(40)] == list(range(40))


def test_similar_texts_link_a_star_and_a_chain_like_all_pairs(spark):
    rng = np.random.default_rng(8)
    hub = [f"w{k}" for k in rng.integers(0, 5000, 300)]
    texts = []
    for k in range(400):  # each at 0.8 or more to the original, few to each other
        ws = list(hub)
        for at in rng.choice(np.arange(10, 290, 10), 4, replace=False):
            ws[at + int(rng.integers(0, 5))] = f"e{k}x{at}"
        texts.append(" ".join(ws))
    texts.insert(250, " ".join(hub))
    for k in range(12):  # a chain: each is like the next one only
        texts.append(" ".join([f"c{k * 8 + j}" for j in range(100)]))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    assert all(like(250, k) for k in range(401)) and sum(like(0, k) for k in range(1, 200)) < 20
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component for r in simhash.similar_texts(table).collect()}
    assert [got[k] for k in range(401)] == [0] * 401
    assert all((got[401 + k] == got[402 + k]) >= like(401 + k, 402 + k) for k in range(11))


def test_similar_texts_find_appended_cut_and_short_texts(spark):
    rng = np.random.default_rng(9)
    rows, kinds = [], []
    for k in range(300):
        n, share, cut_off = int(rng.choice([20, 60, 300, 2000])), float(rng.choice([0.1, 0.2, 0.24])), k % 2
        ws = [f"w{x}" for x in rng.integers(0, 20_000, n)]
        more = [f"w{x}" for x in rng.integers(0, 20_000, int(n * share))]
        pair = (ws + more, ws) if cut_off else (ws, ws + more)
        sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in pair]
        if len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.8:
            rows += [(2 * k, " ".join(pair[0])), (2 * k + 1, " ".join(pair[1]))]
            kinds.append(2 * k)
    got = {r.id: r.component for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(kinds) > 150 and sum(got[k] == got[k + 1] for k in kinds) >= 0.99 * len(kinds)


def url_parts(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :])[0]


URLS = [None, "", "nothing", "http://EXAMPLE.net/en/1", "https://m.example.net/en", "https://x.net?q=/en/", "http://notexample.com/de/", "http://example.com/de/x#y", "http://a.org/fr/", "org://org/fr/z", "http://h#a/b", "x://y://z/w", "http:///p", "http://example.netx/en/", "http://ÀB.org/fr/1"]


def test_url_rules_and_parts(spark):
    got = url_rules.url_filter(spark.createDataFrame([(k, u, "old") for k, u in enumerate(URLS)], "page_id long, url string, verdict string")).collect()
    for r in got:
        host, path = url_parts(r.url)
        assert (r.host, r.path) == (host, path)
        fits = [(h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        assert (r.rule, r.verdict) == (rule, verdict)


def test_association_rules_block_what_labels_call_bad(spark):
    rows = [(k, f"http://{'spam' if k % 4 == 0 else 'good'}{k % 7}.example.de/{'buy/pills' if k % 4 == 0 else 'news'}/{k}?ref=x", int(k % 4 == 0)) for k in range(400)]
    table = spark.createDataFrame(rows, "page_id long, url string, bad int")
    labels = table.where("page_id < 300").select("page_id", "bad")
    got = url_rules.url_filter(table.drop("bad"), labels).collect()
    assert all((r.verdict == "block") == (r.page_id % 4 == 0) for r in got)
    mined = url_rules.mine_rules(url_rules.url_filter(table.drop("bad"), None).join(table.select("page_id", "bad"), "page_id").select(url_rules.tokens(F.col("url"), F.col("host"), F.col("path")).alias("items"), "bad"))
    assert all(r.confidence >= 0.6 and r.hits >= 5 for r in mined.collect()) and not mined.isEmpty()
    assert url_rules.url_filter(table.where("false"), labels).isEmpty()


def test_rules_of_sites_with_many_constant_tokens_and_of_pairs(spark):
    rows = [(k, f"http://bad{k % 6}.x{k % 6}.y{k % 6}.de/{'abcdef'[k % 6]}b/{'abcdef'[k % 6]}d/f/g/h?p=1&q=2&r=3&s=4" if k < 600 else f"http://fine{k % 6}.de/a/b/{k}", int(k < 600)) for k in range(1200)]
    rows += [(2000 + k, f"http://h{'xy'[k % 2]}.nl/{'pq'[k // 2 % 2]}/{k}", int(k % 4 == 3)) for k in range(400)]  # neither part is bad alone
    table = spark.createDataFrame([*rows, (None, None, 1), (7000, None, None)], "page_id long, url string, bad int")
    got = url_rules.url_filter(table.drop("bad"), table.select("page_id", "bad")).join(table.select("page_id", "bad"), "page_id").collect()
    assert len(got) == 1601 and all((r.verdict == "block") == bool(r.bad) for r in got)


def test_supports_are_those_of_a_plain_count(spark):
    rng = np.random.default_rng(6)
    drawn = [sorted({f"t{x}" for x in rng.integers(0, 9, 4)}) for _ in range(300)]
    baskets = [(b, int(rng.random() < (0.8 if {"t1", "t2"} <= set(b) or {"t3", "t4"} <= set(b) or "t8" in b else 0.2))) for b in drawn]
    got = {tuple(r["items"]): (r.hits, r.confidence) for r in url_rules.mine_rules(spark.createDataFrame(baskets, "items array<string>, bad int"), least=6, min_confidence=0.55).collect()}
    items = sorted({t for b, _ in baskets for t in b})
    want = {}
    for n in (1, 2, 3, 4):
        for some in itertools.combinations(items, n):
            bad = [y for b, y in baskets if set(some) <= set(b)]
            if sum(bad) >= 6 and sum(bad) / len(bad) >= 0.55 and not any(set(w) < set(some) for w in want):
                want[some] = (sum(bad), sum(bad) / len(bad))
    assert want and got == want


def test_sets_of_a_url_with_more_than_ten_tokens(spark):
    """Every pair is bad together and none alone; a and b are more frequent than the ten others of the same URLs."""
    rare = [f"r{k}" for k in range(10)]
    baskets = [(["a", "b", *rare], 1)] * 40 + [(["a"], 0)] * 60 + [(["b"], 0)] * 60 + [([r], 0) for k, r in enumerate(rare) for _ in range(30 + k)]
    got = {tuple(r["items"]): (r.hits, r.confidence) for r in url_rules.mine_rules(spark.createDataFrame(baskets, "items array<string>, bad int")).collect()}
    assert got == {pair: (40, 1.0) for pair in itertools.combinations(["a", "b", *rare], 2)}


def plain_licences(text, least=0.8):
    """(score, size, name, place) of every window that reaches least."""
    ws, found = license_scan._words(text or ""), []
    for name, body in license_scan.TEMPLATES:
        tw = license_scan._words(body)
        own = set(zip(tw, tw[1:], strict=False))
        for i in range(len(ws) - 1):
            if (ws[i], ws[i + 1]) in own:
                part = ws[i : i + len(tw)]
                grams = set(zip(part, part[1:], strict=False))
                score = 2 * len(grams & own) / (len(grams) + len(own))
                if score >= least:
                    found.append((score, len(own), name, i))
    return found


def test_licences_by_dice(spark, docs):
    whole = {n: max((t for m, t in license_scan.TEMPLATES if m == n), key=len) for n, _ in license_scan.TEMPLATES}
    wrapped = whole["MIT"].replace(" ", "\n", 40)
    rows = [
        (1, "intro\n" + whole["MIT"].upper() + "\nmore text"), (2, "Licensed under the Apache License Version 2.0"), (3, "a licence of another kind"), (4, "Copyright 1999 Me. " + whole["GPL-3.0"] + " The end."), (5, None), (6, ""),
        (7, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (8, "mit"), (9, " ".join(["Released under the MIT License."] * 40)), (10, "code. Released under\nthe MIT\n License. And then more words of it"), (11, "x " * 300 + wrapped + " y" * 300),
        (12, whole["BSD-3-Clause"].replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS")), (13, "the the the the license license license " * 50), (13, "the the the the license license license " * 50), (None, whole["ISC"] + whole["Unlicense"]),
    ]
    got = license_scan.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")).collect()
    named = {r.doc_id: r for r in got}
    assert [named[k].license for k in (1, 2, 4, 7, 9, 10, 11, 12)] == ["MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "MIT", "MIT", "MIT", "BSD-3-Clause"]
    assert [named[k].license for k in (3, 5, 6, 8, 13)] == [None] * 5 and named[7].licenses == ["CC-BY-NC-4.0", "MIT"] and named[None].licenses == ["ISC", "Unlicense"]
    for r in got:
        found = plain_licences(r.text)
        score, size, name, at = min(found, key=lambda x: (-x[0], -x[1], x[2], x[3]), default=(0.0, 0, None, -1))
        assert (r.license, r.license_word, r.licenses) == (name, at, sorted({x[2] for x in found})) and math.isclose(r.license_score, score, abs_tol=2e-6)
    assert license_scan.scan(docs).count() == len(TEXTS) and license_scan.scan(docs.where("false")).isEmpty()


def test_licences_equal_their_sql(spark, small):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    want = duckdb.sql(license_scan.oracle_sql())
    got = license_scan.op6(spark, small).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_differencing_deletes_shared_lines(spark):
    page = lambda body: f"<html><body><div>Our shop - the best</div><div>Menu one two</div>{body}<div>All rights kept 2020</div></body></html>"
    rows = [(k, f"http://h.example.com/a/{k}", page(f"<p>Story {k} of a kind</p><p>Second &amp; last {k}<br>line</p>")) for k in range(5)]
    rows += [(10, "http://alone.example.org/x", page("<p>Only one</p>")), (11, None, None), (12, "http://h.example.com/a/z", ""), (13, "x", "plain <b>text"), (13, "x", "plain <b>text")]
    got = collections.defaultdict(list)
    for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("?"))).collect():
        got[r.page_id].append(r)
    for k in range(5):
        assert got[k][0].text == f"Story {k} of a kind\n\nSecond & last {k} line"
    assert "Our shop" in got[10][0].text and got[11][0].text == got[12][0].text == "" and got[11][0].n_chars == 0 and len(got[13]) == 2


def test_declared_content_stays_and_declared_chrome_goes():
    html = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav>n</nav><div class='cookie-notice'>c</div><main><article><header><h1>Head</h1></header>"
        "<p>One &lt;two&gt;<p>three\n four<script>var a='</p>';</script><form>f<input></form><section id=comments><p>r</p></section><table><tr><td>x<td>y</table></article></main><aside>s</aside><footer>e</footer></body></html>"
    )
    assert [t for t, kind in pages.blocks(html) if kind == 1] == ["Head", "One <two>", "three four", "x", "y"]
    assert all(kind == 2 for t, kind in pages.blocks(html) if t in ("Site", "n", "c", "f", "r", "s", "e"))
    assert pages.blocks("<p>a <b title='1 > 0'>b</b> <!-- <p>no</p> --> c") == [("a b c", 0)]
    assert pages.blocks("<article><p>cut off") == [("cut off", 1)]
    odd = "<main class='with-sidebar'><div class='entry-header'>T</div><p>x</p><article class='comment'><p>c</p></article></main><div id=related-posts>r</div>"
    assert pages.blocks(odd) == [("T", 1), ("x", 1), ("c", 2), ("r", 2)]


def test_repeated_rows_equal_and_odd_urls_keep_their_text(spark):
    one, two = "<p>a long story</p><p>with an end</p>", "<div>top</div><p>other words</p>"
    rows = [(1, "http://h.de/a", one), (1, "http://h.de/a", one), (2, "http://h.de/b", one), (3, "http://k.de/a", one), (4, "http://k.de/a?x=1", one), (5, None, one), (6, None, one), (7, "nothing", one), (8, "nothing", two), (9, "http:///p", one), (10, "http:///q", one)]
    rows += [(20, "http://print.de/1", one), (21, "http://print.de/2", one + "<p>more</p>")]  # a page within another
    got = collections.Counter((r.page_id, r.text) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = collections.Counter((i, "top\n\nother words" if h == two else "a long story\n\nwith an end") for i, _, h in rows if i != 21)
    assert got == want + collections.Counter([(21, "more")])


def test_awkward_pages():
    assert pages.blocks("<p>a</p><video src=x><p>article text</p>") == [("a", 0), ("article text", 0)]
    assert pages.blocks("<div class=search-results>hits</div><div class=search>box</div>") == [("hits", 0), ("box", 2)]
    assert pages.blocks("<span></b>" * 20_000) == [] and pages.blocks("a<script>b") == [("a", 0)]
    x, y = np.array([1, 2] * 8000 + [3]), np.array([2, 1, 5] * 8000)
    assert pages.shared(x, y).sum() > 10_000


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    rng = np.random.default_rng(0)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    def runs(a):
        return [k for k in range(len(a)) if k == 0 or a[k - 1] != a[k]]

    for bits in (1 << 27, 8):  # whole, and halved down to single lines
        monkeypatch.setattr(pages, "MOST_BITS", bits)
        for _ in range(300):
            a, b = (rng.integers(0, 5, rng.integers(0, 16)) for _ in range(2))
            hit = pages.shared(a, b)
            assert hit[runs(a)].sum() == lcs(a[runs(a)].tolist(), b[runs(b)].tolist())
    assert pages.shared(np.zeros(0, "i8"), np.array([1])).tolist() == []


def test_ranks_have_no_gap(spark):
    table = spark.range(777).select((F.col("id") * 37 % 500).alias("k"), "id")
    got = ranked(table, [F.asc("k"), F.asc("id")], "place").collect()
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r.place)] == sorted((k * 37 % 500, k) for k in range(777)) and sorted(r.place for r in got) == list(range(777))
    assert local_rows(spark, [], "a string, b long").isEmpty()
