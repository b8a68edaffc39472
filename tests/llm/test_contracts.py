"""The registered queries against plain versions of what they have to return: columns, types and values."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm import decision_list, entropy_mix, imatch, pages, queries, url_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RNG = np.random.default_rng(21)
TEXTS = {k: " ".join(f"t{int(x)}" for x in _RNG.zipf(1.3, 40 + 13 * k) % 400) for k in range(30)}
DOCS = [(k, t, "s%d" % (k % 4)) for k, t in TEXTS.items()]
DOCS += [(40, TEXTS[3], "s1"), (41, TEXTS[3].upper(), None), (42, TEXTS[5].replace("t1 ", "t2 ", 1), "s2"), (43, None, "s1"), (44, "", None), (45, "one", "s3"), (46, " \t\n", "s3"), (46, "second text of an id", "s3"), (47, "Ünïcode 漢字 👍🏽 <|endoftext|>\nline\nline", "s0"), (48, "a b c d e " * 20, "s0")]
DOCS += [(49, "x y z " * 3000, "s1"), (50, "w" * 20_000, "s2"), (40, TEXTS[3], "s1")]


def page(k, body):
    return f"<html><body><div>Our shop</div><nav>menu {k}</nav>{body}<div>All rights {k % 2}</div></body></html>"


PAGES = [(k, f"http://h{k % 3}.example.de/a/{k:02d}", page(k, f"<p>Story {k}</p><p>Lines {k // 6} of it</p>")) for k in range(24)]
PAGES += [(30, None, page(1, "<p>no url</p>")), (31, "http://net/x", None), (32, "http://a.example.net/en/1", ""), (33, "http://h0.example.de/a/00", page(0, "<p>again</p>")), (33, "http://h0.example.de/a/00", page(0, "<p>again</p>")), (34, "http://x.example.com/de/1?q", "<article><p>m</p></article>"), (35, "http://b.org/fr/", "plain")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", s, 0, 1, 2, "x") for i, t, s in DOCS], "doc_id long, text string, lang string, source string, n_chars long, size int, shard int, _row string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, text string, n_chars int").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(0, 40, 2)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def nothing(spark, tables, tmp_path_factory):
    at = tmp_path_factory.mktemp("nothing")
    for t in ("documents", "pages", "labels"):
        spark.read.parquet(f"{tables}/{t}.parquet").where("false").write.parquet(f"{at}/{t}.parquet")
    return str(at)


def rows_of(spark, name, tables, **kinds):
    full = next(q for q in queries.QUERIES if q.startswith(f"{name}_"))
    df = queries.QUERIES[full](spark, tables)
    assert {c: k for c, k in df.dtypes if c in kinds} == kinds
    return df.collect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_empty_results(spark, nothing, name):
    assert queries.QUERIES[name](spark, nothing).isEmpty()


def lcs_lines(a, b):
    """Which lines of a a longest common subsequence with b can hold, one choice."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    i, j, out = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def test_op1(spark, tables):
    got = collections.Counter((r.page_id, r.url, r.text, r.n_chars) for r in rows_of(spark, "op1", tables, page_id="bigint", url="string", text="string", n_chars="bigint"))
    found = {(i, u, h): pages.blocks(h) for i, u, h in PAGES}
    lines = {k: tuple(t for t, _ in b) for k, b in found.items()}
    split = lambda u: (m[1].lower(), m[2]) if u and (m := re.match(r"\w+://([^/?#]*)([^?#]*)", u)) else ("", "")
    digest = lambda k: (xxhash.xxh64_intdigest(pages.line_hashes(found[k]), 42) + (1 << 63)) % (1 << 64)  # noqa: E731  signed order
    stands, hosts = {}, collections.defaultdict(dict)
    for k in sorted(lines, key=digest):
        stands.setdefault(split(k[1]), k)
    for (host, path), k in sorted(stands.items()):
        if host and lines[k] not in hosts[host]:
            hosts[host][lines[k]] = (path, k)
    want = collections.Counter()
    for i, u, h in PAGES:
        k, (host, path) = (i, u, h), split(u)
        own, gone = lines[k], set()
        if host:
            order = list(hosts[host])
            at = order.index(lines[stands[host, path]])
            near = [order[j] for j in (at - 1, at + 1) if 0 <= j < len(order)]
            near = [x for x in near if x != own and hosts[host][x][0] != path]
            hits = [lcs_lines(own, x) for x in near]
            loose = {j for j, (_, kind) in enumerate(found[k]) if kind == 0}
            if hits and not any(kind == 1 for _, kind in found[k]) and loose and loose <= set.union(*hits):
                both = set.intersection(*hits) if len(hits) > 1 else set()
                gone = set() if loose <= both else both
            elif hits:
                gone = set.union(*hits)
        text = "\n\n".join(t for j, (t, kind) in enumerate(found[k]) if kind == 1 or kind == 0 and j not in gone)
        want[i, u, text, len(text)] += 1
    assert got == want


def statistics(t):
    ws = WORD.findall(t or "")
    seen = collections.Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    inside = {i + j for i in range(len(ws) - 4) if seen[tuple(ws[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside)


def test_op2(spark, tables):
    got = rows_of(spark, "op2", tables, doc_id="bigint", n_words="bigint", word_chars="bigint", n_symbols="bigint", n_dup_lines="bigint", n_repeat_words="bigint", base_failed="boolean", kept="boolean")
    want = collections.Counter()
    for i, t, _ in DOCS:
        n, chars, symbols, dups, repeats = statistics(t)
        want[i, n, chars, symbols, dups, repeats, n < 10 or 100 * repeats > 20 * n] += 1
    assert collections.Counter(r[:7] for r in got) == want and all(r.kept == (not r.base_failed and r.rule is None) for r in got)


def test_op2_verdict_is_that_of_the_list(spark, tables):
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.createDataFrame([(k, int(k % 30 < 15)) for k in range(30)], "doc_id long, quality int")
    picked = decision_list.bad_labels(labels)
    rules = decision_list.fit_rules(decision_list.text_statistics(docs.join(labels.select("doc_id"), "doc_id", "left_semi")).withColumn("base_failed", decision_list.base_failed()), picked)
    judged = decision_list.quality_rules(docs, labels, keep_row=True)
    assert rules and judged.select("_row.*").columns == docs.columns
    for r in judged.collect():
        first = next((k for k, x in enumerate(rules, 1) if all(t.holds(r.asDict()) for t in x.tests)), None)
        assert r.rule == (None if r.base_failed else first) and r.kept == (not r.base_failed and first is None)
    assert any(r.rule for r in judged.collect())


def test_op3(spark, tables):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, t, _ in DOCS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, rows_of(spark, "op3", tables, doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string"))) == want


def test_op4(spark, tables):
    got = rows_of(spark, "op4", tables, page_id="bigint", host="string", path="string", rule="string", verdict="string")
    want = collections.Counter()
    for i, u, _ in PAGES:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        fits = [(h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[i, host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None))] += 1
    assert collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got) == want
    assert all(r.verdict == ("allow" if r.mined_rule is None else "block") for r in got if not r.rule)


def test_op5(spark, tables):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    order = sorted(DOCS, key=lambda x: (x[0], x[1] or ""))
    got, at = rows_of(spark, "op5", tables, doc_id="bigint", start="bigint", n_tokens="bigint", ids_crc32="bigint"), 0
    for r, (i, t, _) in zip(sorted(got, key=lambda r: r.start), order, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op7(spark, tables):
    got = rows_of(spark, "op7", tables, doc_id="bigint", size="bigint", source_size="bigint", target="double", taken="bigint")
    sizes = collections.Counter()
    for _, t, s in DOCS:
        sizes[s] += len(WORD.findall(t or ""))
    goal = entropy_mix.targets(list(sizes.items()))
    assert collections.Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got) == collections.Counter((i, len(WORD.findall(t or "")), sizes[s], round(goal[s], 6)) for i, t, s in DOCS)
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= max(60, 0.02 * goal[s]) for s in goal)
    assert collections.Counter(map(tuple, rows_of(spark, "op7", tables))) == collections.Counter(map(tuple, got))


def test_mixed_documents_keep_all_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumns({"_h": F.lit("own"), "_copies": F.lit(1)})
    mixed = entropy_mix.mixed_documents(docs)
    plan = entropy_mix.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == plan.agg(F.sum("copies")).first()[0] and mixed.where("_h <> 'own' or _row <> 'x'").isEmpty()


def test_op8(spark, tables):
    got = rows_of(spark, "op8", tables, doc_id="bigint", size="bigint", text_crc32="bigint", law="string", shard="int", slot="bigint", grown_shard="int")
    assert collections.Counter(r[:3] for r in got) == collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in DOCS)
    counts = collections.Counter(r.shard for r in got)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None} and set(counts) == set(range(40))
    assert max(counts.values()) - min(counts.values()) <= 1 and all(sorted(r.slot for r in got if r.shard == k) == list(range(n)) for k, n in counts.items())


def test_op9(spark, tables):
    got = rows_of(spark, "op9", tables, doc_id="bigint", fingerprint="string", component_id="bigint")
    fps = []
    for _, t, _ in DOCS:
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))] if ws else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    label = list(range(len(DOCS)))
    for _ in DOCS:
        for i in range(len(DOCS)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
    least = {x: min(DOCS[i][0] for i in range(len(DOCS)) if label[i] == x) for x in set(label)}
    assert collections.Counter(map(tuple, got)) == collections.Counter((d[0], f"{f:016x}", least[x]) for d, f, x in zip(DOCS, fps, label, strict=True))


M32 = (1 << 32) - 1


def murmur(longs, seed=42):
    """Spark's hash of an array of longs."""
    rotate = lambda x, r: (x << r | x >> (32 - r)) & M32
    h = seed
    for v in longs:
        for k in (v & M32, v >> 32 & M32):
            k = rotate(k * 0xCC9E2D51 & M32, 15) * 0x1B873593 & M32
            h = (rotate(h ^ k, 13) * 5 + 0xE6546B64) & M32
        h ^= 8
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ h >> shift) * factor & M32
    return h


def plain_terms(t):
    return {xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))}


def plain_fingerprint(t, inside):
    ts = sorted({x for x in plain_terms(t) if inside(x)} or plain_terms(t), key=lambda x: x - (x >> 63 << 64))
    level, out = max(0, math.floor(math.log2(max(len(ts), 1) / 32) + 0.5)), []
    for n in range(level, level + 4):
        held = [x for x in ts if x >> 32 & (1 << n) - 1 == 0]
        for g in range(32):
            own = [x for x in held if g in (x >> 59, x >> 54 & 31)]
            out.append(murmur(own) | 1 if own else 0)
    return level, out


def plain_likeness(x, y):
    apart = y[0] - x[0]
    if abs(apart) >= 4:
        return 0.0
    pairs = list(zip(x[1][max(apart, 0) * 32 :][:32], y[1][max(-apart, 0) * 32 :][:32], strict=True))
    used = [p == q for p, q in pairs if p or q]
    return sum(used) / len(used) if used else float(x[1] == y[1])


@pytest.mark.parametrize("most_terms", [imatch.MOST_TERMS, 3])
def test_op10(spark, tables, most_terms):
    """The same answer whether the lexicon is a literal or joined."""
    if most_terms == imatch.MOST_TERMS:
        got = rows_of(spark, "op10", tables, doc_id="bigint", n_chars="bigint", edited_sha256="string", fingerprint="string", edited_fingerprint="string", near_edited="double", near_next="double")
    else:
        got = imatch.edited_likeness(spark.read.parquet(f"{tables}/documents.parquet"), most_terms=most_terms).collect()
    n, df = len(DOCS), collections.Counter(x for _, t, _ in DOCS for x in plain_terms(t))
    band = {x for x, k in df.items() if n**0.3 < k <= max(2.0, n**0.7)}
    inside = band.__contains__
    signed = lambda t: (h := xxhash.xxh64_intdigest((t or "").encode(), 42)) - (h >> 63 << 64)
    order = sorted({(i, t or "") for i, t, _ in DOCS}, key=lambda x: (-x[0], signed(x[1]), len(x[1])))
    text = lambda fp: f"{fp[0]:02x}-" + "".join(f"{x:08x}" for x in fp[1])
    want = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, new, other = (plain_fingerprint(x, inside) for x in (t, edited, after))
        want[i, t] = (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(own), text(new), round(plain_likeness(own, new), 9), round(plain_likeness(own, other), 9))
    plain = collections.Counter(want[i, t or ""] for i, t, _ in DOCS)
    assert collections.Counter((*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == plain
