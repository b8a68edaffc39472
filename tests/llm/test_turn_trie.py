"""The prefix trie against a plain one over whole conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from colloquy.llm import queries, turn_trie as T

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def in_order(rows):
    """conv_id -> its turns as (role, text)."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            held[conv].append(((turn is not None, turn or 0), role, key, text))
    return {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in held.items()}


def branched(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids[p])
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()
    )


def shown(nodes):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], *(r[c] for c in COLUMNS[3:])) for r in nodes.collect())


def conversations(seed: int, n: int):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        base = [("system", "same start")] * rng.choice([0, 3, 3, 3]) + [("user", "hot")] * rng.choice([0, 1, 1])
        turns = base + [(rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "bä", "漢字", "long text " * 3])) for _ in range(rng.randint(0, 4))]
        rows += [(c * 7 % 250 if c % 3 else c * 70_000, k if k or c % 2 else None, r, t) for k, (r, t) in enumerate(turns)]
    return rows + [(None, 1, "user", "lost"), (500, 1, "user", "x"), (500, 1, "user", "x"), (500, 1, "user", "a"), (777, None, None, None)]


@pytest.mark.parametrize(("seed", "most"), [(1, None), (2, 1), (3, 3), (4, 12), (5, 40)])
def test_equals_a_plain_trie(spark, seed, most):
    rows = conversations(seed, 120)
    own = in_order(rows)
    made = T.sequences(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert {r["conv_id"]: len(r["steps"]) for r in made.collect()} == {c: len(x) for c, x in own.items()}
    assert shown(T.prefix_trie(made, most)) == plain(own)
    if seed < 4:
        assert shown(T.prefix_trie(T.branched(made), most)) == plain(branched(own))


def test_caterpillar_and_long_shared_start(spark):
    """Every conversation is a longer start of one chat, and another set parts only after 300 turns."""
    rows = [(c, k, "user", f"turn {k}") for c in range(30) for k in range(c + 1)]
    rows += [(100 + c, k, "user", f"long {k}" if k < 300 else f"own {c} {k}") for c in range(4) for k in range(302)]
    assert shown(T.prefix_trie(T.sequences(spark.createDataFrame(rows, SCHEMA)), 60)) == plain(in_order(rows))


def test_many_copies_over_spans(spark, monkeypatch):
    monkeypatch.setattr(T, "SPAN_BITS", 3)
    rows = [(c, k, "user", "abc"[k]) for c in range(0, 900, 3) for k in range(3)]
    assert shown(T.prefix_trie(T.sequences(spark.createDataFrame(rows, SCHEMA)))) == plain(in_order(rows))


def test_turnless_root_and_empty_table(spark):
    rows = [(c, 0, "user", "x") for c in range(1, 40)]  # no conversation 0, so those with a lead of 1 or more lose all turns
    own = branched(in_order(rows))
    assert not all(own.values())
    made = T.sequences(spark.createDataFrame(rows, SCHEMA))
    assert shown(T.prefix_trie(T.branched(made))) == plain(own)
    assert T.prefix_trie(T.sequences(spark.createDataFrame([], SCHEMA))).collect() == []
    assert T.prefix_trie(T.sequences(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))).collect() == []


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x", "y", 3), (2, 0, "user", "x", "y", 4)], f"{SCHEMA}, d string, steps int")
    assert shown(T.prefix_trie(T.sequences(rows))) == plain({1: [("user", "x")], 2: [("user", "x")]})


def test_op13_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_turn_trie"](spark, small)
    assert got.dtypes == [(c, "string" if c == "ends_sha256" else "bigint") for c in COLUMNS]
    assert shown(got) == plain(branched(in_order(rows)))
