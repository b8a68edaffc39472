"""Graph operators on edge tables: merge chains, union-find, components, triangles, pair relations.

Iterations are DataFrame joins whose state is written out each round (``colloquy.state.cut``), so lineage stays short
and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from colloquy.state import cut, small

#: Rows of merges up to which a round is broadcast; larger ones are joined by a shuffle.
BROADCAST_MERGES = 200_000


def merge_chain(merges: DataFrame) -> DataFrame:
    """Where each merged node ends up. merges: src, dst, one row a src.

    Pointer doubling, so rounds grow with the logarithm of the longest chain; a node of a cycle resolves to itself,
    a node that leads into a cycle to the first cycle node it meets.
    """
    step = cut(merges.groupBy("src").agg(F.min("dst").alias("dst")), "merges")
    jump, n = step, step.count()
    meet = lambda df: F.broadcast(df) if n <= BROADCAST_MERGES else df.hint("merge")  # noqa: E731  a broadcast goes through the driver, in every round
    # past as many steps as there are merges, whatever still moves goes round a cycle, and where it is lies on it
    for _ in range(n.bit_length() + 1):
        ahead = jump.alias("n")
        nxt = jump.alias("a").join(meet(ahead), F.col("a.dst") == F.col("n.src"), "left").select(F.col("a.src").alias("src"), F.coalesce("n.dst", "a.dst").alias("dst"), F.col("n.src").isNotNull().alias("more"))
        nxt = cut(nxt, "chain")
        moving = nxt.where("more")
        if moving.isEmpty():
            return nxt.select("src", "dst")
        jump = nxt.select("src", "dst")
    on_cycle = jump.join(meet(step.select(F.col("src").alias("dst"))), "dst", "left_semi").select(F.col("dst").alias("node")).distinct()
    cycle = cut(on_cycle, "cycle")
    broken = step.join(meet(cycle), step.src == cycle.node, "left_anti")
    inner = cycle.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    return merge_chain(broken).union(inner)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node and component (its smallest node). edges: a, b; nodes: node (those without an edge too).

    Rounds go on until no label falls; labels are nodes and only fall, so they end.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).where("x <> y").distinct()
    every = both.select(F.col("x").alias("node"))
    every = (every.union(nodes.select("node")) if nodes is not None else every).distinct()
    both = cut(both, "edges")
    labels = cut(every.withColumn("component", F.col("node")), "labels")
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.x, "left").select("node", F.least("component", F.coalesce("near", "component")).alias("new"), F.col("component").alias("old"))
        step = cut(step, "labels")
        jump = step.groupBy(F.col("old").alias("at")).agg(F.min("new").alias("to")).where("to < at")
        moved = step.join(jump, step.new == jump["at"], "left").select("node", F.coalesce("to", "new").alias("component"), (F.coalesce("to", "new") < F.col("old")).alias("fell"))
        found = cut(moved, "labels")
        labels = found.select("node", "component")
        if found.where("fell").isEmpty():
            return labels


def component_sizes(labels: DataFrame, least: int = 3) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)


def triangles(edges: DataFrame) -> DataFrame:
    """Each triangle once (a < b < c), edges turned from the node of lower degree so that no hub is joined to itself."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    degree = e.select(F.col("a").alias("n")).union(e.select("b")).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    d1, d2 = degree.select(F.col("n").alias("a"), F.col("d").alias("da")), degree.select(F.col("n").alias("b"), F.col("d").alias("db"))
    turn = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = e.join(d1, "a").join(d2, "b").select(F.when(turn, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedge = out.alias("p").join(out.alias("q"), "u").where("p.v < q.v").select("u", F.col("p.v").alias("v"), F.col("q.v").alias("w"))
    closed = wedge.join(e.select(F.col("a").alias("v"), F.col("b").alias("w")), ["v", "w"], "left_semi")
    return closed.select(F.array_sort(F.array("u", "v", "w")).alias("t")).select(F.get("t", F.lit(0)).alias("a"), F.get("t", F.lit(1)).alias("b"), F.get("t", F.lit(2)).alias("c"))


def relation(same: Column, left_in_right: Column, right_in_left: Column) -> Column:
    """same, overlap, narrower, broader or unrelated from two directional answers and same_space."""
    return (
        F.when(left_in_right & right_in_left, "same").when(left_in_right, "narrower").when(right_in_left, "broader").when(same, "related").otherwise("unrelated")
    )


def unswap(verdict: Column) -> Column:
    return F.when(verdict == "narrower", "broader").when(verdict == "broader", "narrower").otherwise(verdict)


def pairs(items: DataFrame, unit: str, item: str) -> DataFrame:
    """Unordered pairs of distinct items of a unit; the number of items of a unit is the caller's bound."""
    one = items.select(unit, item).distinct()
    a, b = one.select(unit, F.col(item).alias("a")), one.select(unit, F.col(item).alias("b"))
    return a.join(b, unit).where("a < b")


def round_robin(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """One row of each group before a second of any."""
    depth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("depth", depth.cast("long")).orderBy("depth", group).limit(most)


#: Verdicts that make two terms one, and that relate two concepts.
SAME, RELATED = ("identity",), ("related", "a_extends_b", "b_extends_a")


def pair_key(a: Column, b: Column) -> Column:
    """What a verdict on two terms is kept under, in whatever order and case they come."""
    return F.struct(F.least(F.lower(a), F.lower(b)).alias("a"), F.greatest(F.lower(a), F.lower(b)).alias("b"))


def unjudged(items: DataFrame, unit: list[str], term: str, memo: DataFrame) -> DataFrame:
    """a, b: each pair of terms that some unit holds and the memo has no verdict on, once for all units. memo: a, b, verdict."""
    one = items.select(F.struct(*unit).alias("unit"), F.lower(term).alias("t")).distinct()
    asked = pairs(one, "unit", "t").select("a", "b").distinct()
    return asked.join(memo.where("verdict is not null").select(pair_key(F.col("a"), F.col("b")).alias("k")).select("k.*").distinct(), ["a", "b"], "left_anti")


def unit_graphs(items: DataFrame, unit: list[str], term: str, memo: DataFrame) -> DataFrame:
    """Each unit's own graph of concepts, all units at once: unit columns, n_terms, distinct_concepts, identity_merges, clusters, connected, clique.

    Terms that are one (verdict identity) are one concept; concepts hang together by the other verdicts. clusters: those of
    three concepts or more; connected: there is one; clique: three concepts are related each to each. A graph
    depends on its terms alone, so each distinct set of terms is worked out once, and all sets in one run of components;
    pairs of a unit are its own bound.
    """
    held = cut(items.groupBy(*unit).agg(F.array_sort(F.collect_set(term)).alias("terms")), "units")
    sets = cut(held.select("terms").distinct().withColumn("set", F.monotonically_increasing_id()), "sets")
    one = cut(sets.select("set", F.posexplode("terms").alias("_n", "term")).select("set", "term", F.struct("set", F.col("_n")).alias("node")), "nodes")
    known = memo.select(pair_key(F.col("a"), F.col("b")).alias("k"), "verdict").groupBy("k.a", "k.b").agg(F.first("verdict", ignorenulls=True).alias("verdict"))
    left, right = (one.select("set", F.col("term").alias(f"t{side}"), F.col("node").alias(side)) for side in ("a", "b"))
    both = left.join(right, "set").where("ta < tb").select(F.col("a").alias("x"), F.col("b").alias("y"), pair_key(F.col("ta"), F.col("tb")).alias("k"))
    judged = cut(both.select("x", "y", "k.*").join(known, ["a", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b"), "verdict"), "judged")
    merged = components(judged.where(F.col("verdict").isin(*SAME)), one)
    named = cut(one.join(merged, "node").select("set", "node", F.col("component").alias("concept")), "concepts")
    end = lambda side: named.select(F.col("node").alias(side), F.col("concept").alias(f"c{side}"))
    edges = judged.where(F.col("verdict").isin(*RELATED)).join(end("a"), "a").join(end("b"), "b").where("ca <> cb")
    edges = cut(edges.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "related")
    clusters = component_sizes(components(edges)).groupBy(F.col("component.set").alias("set")).agg(F.count(F.lit(1)).alias("clusters"))
    cliques = triangles(edges).groupBy(F.col("a.set").alias("set")).agg(F.count(F.lit(1)).alias("cliques"))
    counts = named.groupBy("set").agg(F.count(F.lit(1)).alias("n_terms"), F.countDistinct("concept").alias("distinct_concepts"))
    none = F.lit(0).cast("long")
    found = counts.join(clusters, "set", "left").join(cliques, "set", "left").withColumns({"clusters": F.coalesce("clusters", none), "cliques": F.coalesce("cliques", none)})
    every = held.join(small(cut(sets.join(found, "set").drop("set"), "graphs")), "terms")
    return every.select(*unit, "n_terms", "distinct_concepts", (F.col("n_terms") - F.col("distinct_concepts")).alias("identity_merges"), "clusters", (F.col("clusters") > 0).alias("connected"), (F.col("cliques") > 0).alias("clique"))


def umbrella_rates(graphs: DataFrame, source: str, session: str, least: int = 3) -> DataFrame:
    """Per source: units, those with three candidates or more, connected and clique ones among them, and sessions with a connected one."""
    able = F.col("n_terms") >= least
    return graphs.groupBy(source).agg(
        F.count(F.lit(1)).alias("units_total"), F.count_if(able).alias("units_with_3plus"), F.count_if(able & F.col("connected")).alias("connected"), F.count_if(able & F.col("clique")).alias("clique"),
        F.count_distinct(F.when(able & F.col("connected"), F.col(session))).alias("sessions_with_connected"),
    )
