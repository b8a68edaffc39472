"""Invariants of matching, packing, folding and injected callables."""

from __future__ import annotations

import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy import state
from colloquy.functions import injected, names as N
from colloquy.operators import evals as E, exchange as X, export, fold as D, graph as G, resolve as R, spend as S, triage as T


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("a", "b"), [("idempotent", "idempotency"), ("caches", "cache"), ("notarisation", "notarization"), ("committed", "commit"), ("transactional", "transaction"), ("rebasing", "rebase"), ("boxes", "box"), ("colours", "color")]
)
def test_word_forms_share_a_stem(spark, a, b):
    assert one(spark, N.stem_token(F.lit(a))) == one(spark, N.stem_token(F.lit(b)))


def test_identifiers_and_short_words_keep_their_form(spark):
    assert [one(spark, N.stem_token(F.lit(w))) for w in ("k8s", "502", "client", "cli", "bus")] == ["k8s", "502", "client", "cli", "bus"]


def plain():
    return F.create_map(F.lit(""), F.lit(1.0))


def score(spark, a, b):
    return one(spark, N.overlap(F.lit(a), F.lit(b), plain()))


def test_scores_of_pairs(spark):
    assert score(spark, "MultiVersion", "multi-version") == 1.0
    assert score(spark, "uds", "Unix Domain Socket") == 0.9 and score(spark, "k8s", "Kubernetes") == 0.9 and score(spark, "MVCC", "x (Multi-Version Concurrency Control)") == 0.9
    assert score(spark, "ci", "cache invalidation") == 0.0
    assert score(spark, "backpressure", "backpressure handling") >= 0.5
    assert 0.5 < score(spark, "backpresure", "backpressure") < 1.0
    assert score(spark, "of the", "bill of materials") == 0.0 or score(spark, "of the", "bill of materials") < 0.5
    assert score(spark, "personal access token vs service key", "service key") == 1.0
    for a, b in (("outbox pattern", "transactional outbox"), ("locking", "blocking"), ("a b", "b c")):
        assert score(spark, a, b) == pytest.approx(score(spark, b, a))


CONCEPTS = ["Transactional Outbox", "Outbox Pattern Library", "Saga Pattern", "Strangler Pattern", "Unix Domain Socket", "Kubernetes", "Idempotency Key", "Backpressure Handling", "Write-Ahead Log", "Bloom Filter", "Merkle Tree", "Service Mesh", "Event Sourcing", "Optimistic Locking", "Rate Limiter"]


def test_shortlist_puts_the_right_concept_first(spark):
    concepts = spark.createDataFrame([(k, n, ["WAL"] if n.startswith("Write") else None, k % 3) for k, n in enumerate(CONCEPTS)], "concept_id long, canonical_name string, aliases array<string>, encounter_count long")
    asked = [("idempotent keys", "Idempotency Key"), ("k8s", "Kubernetes"), ("uds", "Unix Domain Socket"), ("wal", "Write-Ahead Log"), ("write ahead logging", "Write-Ahead Log"), ("optimistic lock", "Optimistic Locking"), ("blom filter", "Bloom Filter"), ("backpresure", "Backpressure Handling"), ("ratelimiter", "Rate Limiter")]
    subs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(asked)] + [(99, "zzz qqq")], "submission_id long, text string")
    got = R.shortlist(subs, concepts, 5)
    first = {r.submission_id: r.canonical_name for r in got.where("rank = 1").collect()}
    assert [first[k] for k in range(len(asked))] == [n for _, n in asked]
    none = got.where("submission_id = 99").orderBy("rank").collect()
    assert len(none) == 5 and [r.canonical_name for r in none][:2] == sorted(n for k, n in enumerate(CONCEPTS) if k % 3 == 2)[:2]


def test_chunks_keep_the_budget_unless_a_group_is_larger(spark):
    sizes = [300, 500, 1, 900, 20, 780, 800, 10]
    table = spark.createDataFrame([(1, k + 1, s) for k, s in enumerate(sizes)], "session_id long, island long, size long")
    got = {r.island: r.chunk for r in X.chunks(table, 800).collect()}
    assert [got[k + 1] for k in range(len(sizes))] == [1, 1, 2, 3, 4, 4, 5, 6]


def test_exchanges_on_edges(spark):
    rows = [(1, 1, "assistant", "a" * 39), (1, 2, "assistant", "b" * 40), (1, 3, "assistant", " " + "c" * 40 + "\n"), (1, 4, "user", "  reply "), (1, 5, "assistant", "d" * 50), (2, 1, "user", "x")]
    table = spark.createDataFrame([(*r, False, False) for r in rows], "session_id long, line_no long, role string, text string, is_meta boolean, is_sidechain boolean")
    got = X.exchanges(table).orderBy("assistant_line").collect()
    assert [(r.assistant_line, r.human_line, r.human_text) for r in got] == [(2, 4, "reply"), (3, 4, "reply"), (5, None, None)]
    isl = X.island_sizes(X.islands(X.exchanges(table))).orderBy("island").collect()
    assert [(r.n_windows, r.size) for r in isl] == [(2, 85), (1, 50)]


def test_folds_do_not_depend_on_order(spark):
    rows = [("encounter_confirmed", 1, 1), ("encounter_judgment_retracted", 1, 5), ("encounter_dismissed", 2, 2), ("encounter_confirmed", 2, 3), ("encounter_recorded", 1, 9)]
    table = spark.createDataFrame([(k, e, "2024", i) for e, k, i in rows], "key long, event_type string, occurred_at string, event_id long")
    want = {1: None, 2: "confirmed"}
    for t in (table, table.orderBy(F.desc("event_id")).repartition(3)):
        assert {r.key: r.judgment for r in D.latest_judgment(t).collect()} == want
    ops = spark.createDataFrame([(1, 1, "add", "a"), (1, 2, "add", "b"), (1, 3, "add", "a"), (1, 4, "remove", "b"), (1, 5, "add", "b"), (1, 6, "add", "c"), (1, 7, "remove", "c"), (1, 8, "remove", "zz")], "key long, event_id long, op string, alias string")
    assert D.alias_fold(ops).first().aliases == "a,b"


def test_merge_chains_and_cycles(spark):
    merges = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (5, 6), (6, 5), (7, 5), (8, 7)], "src long, dst long")
    assert {r.src: r.dst for r in G.merge_chain(merges).collect()} == {1: 3, 2: 3, 4: 3, 5: 5, 6: 6, 7: 5, 8: 5}


def test_components_and_triangles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 4), (9, 9), *((k, k + 1) for k in range(100, 160))], "a long, b long")
    got = {r.node: r.component for r in G.components(edges, spark.createDataFrame([(9,)], "node long")).collect()}
    assert got[3] == 1 and got[5] == 4 and got[9] == 9 and got[160] == 100
    assert [(r.a, r.b, r.c) for r in G.triangles(edges).collect()] == [(1, 2, 3)]


def test_cut_rules(spark):
    def rule(known, unknown, **kw):
        rows = [(s, 1) for s in known] + [(s, 0) for s in unknown]
        return T.cut_rule(spark.createDataFrame(rows, "score double, known int"), **kw).first()

    assert rule([0.9, 0.8], [0.1] * 9).source == "no map" and rule([0.9] * 3, [0.1] * 9).cut == 0.5
    assert rule([0.9] * 9, [0.1] * 9).cut == 0.9 and rule([0.5] * 9, [0.5] * 9).source == "unreliable"
    assert rule([0.9] * 9, [0.1] * 9, spot_answered=10, spot_known=8).source == "spot checks"


def test_spot_checks_are_about_a_fifth_and_stable(spark):
    hits = spark.range(5000).select(N.spot_hash(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("h")).where("h").count()
    assert 850 < hits < 1150


def test_judges_fail_open(spark):
    rows = spark.createDataFrame([("a", "g", False), ("bad", "g", False), ("skip", "g", True)], "term string, gloss string, known boolean")

    def call(term, gloss):
        if term == "bad":
            raise ValueError("no answer")
        return 0.7

    got = {r.term: (r.p, r.error) for r in injected.judge(rows, call, F.col("known")).collect()}
    assert got["a"] == (0.7, None) and got["bad"][0] is None and "no answer" in got["bad"][1] and got["skip"] == (None, None)


def test_proposals_and_grades(spark):
    chunks = spark.createDataFrame([(1, 1, "p1"), (1, 2, "")], "session_id long, chunk long, prompt string")
    got = injected.propose(chunks, lambda prompt: [{"term": prompt, "signal": "accepted"}] * 2 if prompt else [], 2).collect()
    assert [(r.pos, r.term, r.paraphrase) for r in sorted(got, key=lambda r: r.pos)] == [(0, "p1", None), (1, "p1", None)]
    assert injected.salvage('{"candidates": [{"a": 1}, {"b": [2]}, {"c": ') == [{"a": 1}, {"b": [2]}] and injected.salvage("nothing") == [] and injected.salvage('{"notes": [{"a": 1}]}') == []
    assert injected.salvage('{"notes": ["x"], "candidates": [{"a": "]}\\\\\\""}, {"b": {"c": [1]}}, 7, {"d": 1}]}') == [{"a": "]}\\\""}, {"b": {"c": [1]}}]
    answers = spark.createDataFrame([("q", "x because y"), ("q", "one"), ("q", "a, b")], "question string, answer string")
    assert [r.level for r in injected.grade(answers).collect()] == ["causal", "isolated", "listed"]
    assert [r.level for r in injected.grade(answers, lambda q, a: "causal" if a == "one" else "weird").collect()] == ["isolated", "causal", "isolated"]


def test_export_refuses_to_overwrite_and_zips(spark, tmp_path):
    frames = {"a": spark.createDataFrame([(1, "x")], "b long, a string")}
    export.write_frames(frames, f"{tmp_path}/out")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        export.write_frames(frames, f"{tmp_path}/out")
    index = export.archive(frames | {"none": frames["a"].where("b > 1")}, f"file://{tmp_path}/a.zip", {"a": "first"})
    assert sorted(map(tuple, index.collect())) == [("first.jsonl", 1, 16), ("none.jsonl", 0, 0)]
    z = zipfile.ZipFile(tmp_path / "a.zip")
    assert z.testzip() is None and z.read("first.jsonl") == b'{"a":"x","b":1}\n' and z.read("none.jsonl") == b""
    with pytest.raises(FileExistsError):
        export.archive(frames, f"file://{tmp_path}/a.zip")


def test_a_million_rows_go_into_one_archive(spark, tmp_path):
    rows = spark.range(1_000_000, numPartitions=6).select("id", F.concat(F.lit("é"), (F.col("id") % 7).cast("string")).alias("t"))
    index = export.archive({"rows": rows}, f"file://{tmp_path}/big.zip", member_bytes=1 << 20)
    z = zipfile.ZipFile(tmp_path / "big.zip")
    assert z.testzip() is None and len(z.namelist()) == index.count() > 20
    text = b"".join(z.read(n) for n in z.namelist()).decode().splitlines()
    assert len(text) == 1_000_000 and text[0] == '{"id":0,"t":"é0"}' and text[-1] == '{"id":999999,"t":"é0"}' and text == sorted(text, key=lambda x: int(x[6 : x.index(",")]))


def test_costs_are_added_in_order_of_the_calls(spark):
    """Sums of cents that are whole units: the last digit, and so the text, must not depend on where rows lie."""
    rng = random.Random(4)
    costs = {s: [rng.randrange(1, 20_000) for _ in range(60)] for s in range(300)}
    for cents in costs.values():
        cents.append(-sum(cents) % 100 + 100)
    rows = [(k * 300 + s, s, cents[k] / 100) for s, cents in costs.items() for k in range(61)]
    rng.shuffle(rows)
    calls = spark.createDataFrame(rows, "call_id long, session_id long, cost double").repartition(6).withColumns({"local": F.lit(False), "ok": F.lit(True), "tokens": F.lit(1).cast("long")})
    got = {r["session_id"]: r["cost"] for r in S.spend(calls, [F.col("session_id")], order="call_id").collect()}
    want = dict.fromkeys(costs, 0.0)
    for _, s, cost in sorted(rows):
        want[s] += cost
    assert got == want


def test_rounds_of_many_merges_are_not_broadcast(spark, monkeypatch):
    plans = []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return state.cut(df, name)

    monkeypatch.setattr(G, "cut", seen)
    monkeypatch.setattr(G, "BROADCAST_MERGES", 3, raising=False)
    merges = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (5, 6), (6, 5), (7, 5)], "src long, dst long").coalesce(1)
    assert {r.src: r.dst for r in G.merge_chain(merges).collect()} == {1: 3, 2: 3, 4: 3, 5: 5, 6: 6, 7: 5}
    chains = [p for p in plans if "LeftOuter" in p]
    assert chains and not any("BroadcastHashJoin" in p for p in chains)


def test_units_of_the_same_terms_are_one_graph(spark, monkeypatch):
    written = {}

    def counted(df, name):
        out = state.cut(df, name)
        written[name] = max(out.count(), written.get(name, 0))
        return out

    monkeypatch.setattr(G, "cut", counted)
    items = spark.range(50).select("id", F.explode(F.array(*map(F.lit, "abcd"))).alias("t")).where("id < 40 or t <> 'd'").withColumn("s", F.when(F.col("id") % 2 == 0, "x"))
    memo = spark.createDataFrame([("a", "b", "related"), ("C", "b", "related"), ("c", "a", "a_extends_b"), ("d", "a", "identity")], "a string, b string, verdict string")
    got = {r["id"]: tuple(r)[2:] for r in G.unit_graphs(items, ["id", "s"], "t", memo).collect()}
    assert got == {k: (4, 3, 1, 1, True, True) if k < 40 else (3, 3, 0, 1, True, True) for k in range(50)}
    assert max(written["judged"], written["related"]) <= 7


def test_nearest_of_equal_vectors_is_the_lower_id():
    """Copies of vectors have equal products wherever they lie, so the lower ids win, as in a sum from left to right."""
    rng = np.random.default_rng(3)
    own = rng.normal(size=(9, 64))
    own /= np.sqrt((own * own).sum(1))[:, None]
    ps, ids = np.concatenate([own] * 11), rng.permutation(99)
    for row, near, sims in E.nearest(ids[:20], ps[:20], ids, ps, 7):
        exact = [sum((x * y for x, y in zip(ps[row], p, strict=True)), 0.0) for p in ps.tolist()]
        want = sorted((k for k in range(99) if k != row), key=lambda k: (-exact[k], ids[k]))[:7]
        assert near.tolist() == want and sims.tolist() == [exact[k] for k in want]
