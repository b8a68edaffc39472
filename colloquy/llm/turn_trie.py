"""The trie of conversation prefixes, with sums over subtrees.

A turn is the hash of its role and text (128 bits of SHA-256), so texts are read once and never shuffled. Equal
conversations are one sequence. Sequences are dealt by the digest of their first turn to buckets, and each bucket is a
forest of pointer dictionaries inside ``applyInPandas``. A first turn whose sequences hold too many turns for a bucket is
split: what all its sequences share becomes a chain of nodes kept as one row, and each next turn is a group of its own,
again and again until every group fits. The chains are summed up from the groups below them, deepest first.

The ids of one sequence's conversations are sorted and joined in spans of ids, one row a span, and hashed as a stream.

Defined cases: rows without a conv_id are left out; turns are ordered by turn, null first, then role, then the hash of
role and text; a null role or text is empty; repeated rows are turns of their own; conversations may be of any length
(each is one array of hashes); a table without conversations gives no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.llm.common import cut, read
from colloquy.shipping import ship

#: Hexadecimal digits that stand for a turn.
WIDTH = 32
#: Turns of distinct sequences in a group, from which on it is split: twice a partition's share within these bounds.
FEWEST_TURNS, MOST_TURNS = 1_000, 200_000
#: Ids of a span are joined to one text.
SPAN_BITS = 16
NOTHING = hashlib.sha256(b"").hexdigest()
SEQUENCE = "conv_id long, n long, ends string, steps array<struct<d:string,chars:int>>"
NODE = "up string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NAMES = [x.split(" ")[0] for x in NODE.split(", ")]


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and steps: the hash and length of each turn in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct("turn", role.alias("role"), F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(WIDTH)).alias("d"), F.length(text).alias("chars"))
    gathered = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return gathered.select("conv_id", F.transform("t", lambda t: F.struct(t["d"].alias("d"), t["chars"].alias("chars"))).alias("steps"))


def branched(own: DataFrame, lead: int = 6, block: int = 100) -> DataFrame:
    """Each conversation behind the first h turns of the first one of its block; h = crc32(decimal id) % lead. own: as ``sequences``."""
    bases = own.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("_base"), F.slice("steps", 1, lead - 1).alias("_lead"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(lead)).cast("int")
    both = own.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % block, "_h": h}).join(bases, "_base", "left")
    none = F.slice("steps", 1, 0)
    rest = F.when(F.size("steps") > F.col("_h"), F.slice("steps", F.col("_h") + 1, F.size("steps") - F.col("_h"))).otherwise(none)
    return both.select("conv_id", F.concat(F.when(F.col("_lead").isNotNull(), F.slice("_lead", F.lit(1), F.col("_h"))).otherwise(none), rest).alias("steps"))


def distinct_sequences(rows: DataFrame) -> DataFrame:
    """Each sequence once: the smallest id, how many conversations have it, and the hash of their ids in order."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by sequence and span; a sequence is done when the next one begins."""
        key, digest, least, n, steps = None, None, 0, 0, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([least], pa.int64()), pa.array([n], pa.int64()), pa.array([digest.hexdigest()]), steps], ["conv_id", "n", "ends", "steps"])

        for batch in batches:
            done, held = [], batch.column("steps")
            for at, (s, ids, low, count) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("s", "ids", "low", "count")), strict=True)):
                if s != key:
                    if key is not None:
                        done.append(row())
                    key, digest, least, n, steps = s, hashlib.sha256(), low, 0, held.slice(at, 1)
                digest.update((("," if n else "") + ids).encode())
                n += count
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if key is not None:
            yield row()

    named = rows.select("conv_id", "steps", F.sha2(F.array_join(F.transform("steps", lambda x: x["d"]), ""), 256).alias("s"), F.shiftright("conv_id", SPAN_BITS).alias("span"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    spans = named.groupBy("s", "span").agg(ids.alias("ids"), F.min("conv_id").alias("low"), F.count(F.lit(1)).alias("count"), F.any_value("steps").alias("steps"))
    return spans.repartition("s").sortWithinPartitions("s", "span").mapInArrow(stream, SEQUENCE)


def shared(a: Column, b: Column) -> Column:
    """How many leading steps two arrays share."""
    both = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(1), both), lambda i: F.get(a, i - 1)["d"] != F.get(b, i - 1)["d"])
    return F.when(both > 0, F.coalesce(F.get(differ, F.lit(0)) - 1, both)).otherwise(0)


def grouped(found: DataFrame, most: int) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Sequences by group, and a pair of tables a round of splitting, the root's first.

    A group g holds the sequences below one node at depth k; up names the split node above it. Of each round: the split
    nodes (g, up, k, m: the chain from depth k to m, chars of its turns) and the sequences that end at a chain's end.
    """
    columns = ("g", "up", "k", "conv_id", "n", "ends", "steps")
    next_turn = lambda g, k: F.sha2(F.concat(g, F.element_at("steps", k)["d"]), 256)
    root = found.limit(1).select(F.lit("").alias("g"), F.lit(None).cast("string").alias("up"), F.lit(0).alias("k"), F.lit(0).alias("m"), F.array(F.lit(0)).alias("chars"))
    rounds = [(root, found.where(F.size("steps") == 0).select(F.lit("").alias("g"), "conv_id", "n", "ends"))]
    open_ = found.where(F.size("steps") > 0).select(next_turn(F.lit(""), F.lit(1)).alias("g"), F.lit("").alias("up"), F.lit(1).alias("k"), "conv_id", "n", "ends", "steps")
    done = None
    while True:
        sizes = open_.groupBy("g").agg(F.sum(F.size("steps") - F.col("k") + 1).alias("turns"), F.count(F.lit(1)).alias("rows"))
        large = cut(sizes.where((F.col("turns") > most) & (F.col("rows") > 1)).select("g"), "large")
        if large.isEmpty():
            return (open_ if done is None else done.unionByName(open_)), rounds
        fits = open_.join(large, "g", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        over = open_.join(large, "g")
        ends = over.groupBy("g", "up", "k").agg(F.min("steps").alias("a"), F.max("steps").alias("b")).withColumn("m", shared(F.col("a"), F.col("b")))
        nodes = cut(ends.select("g", "up", "k", "m", F.transform(F.slice("a", F.col("k"), F.col("m") - F.col("k") + 1), lambda x: x["chars"]).alias("chars")), "split")
        placed = over.join(nodes.select("g", "m"), "g")
        rounds.append((nodes, placed.where(F.size("steps") == F.col("m")).select("g", "conv_id", "n", "ends")))
        below = placed.where(F.size("steps") > F.col("m")).withColumn("_m", F.col("m") + 1)
        below = below.select(next_turn(F.col("g"), F.col("_m")).alias("_g"), F.col("g").alias("up"), F.col("_m").alias("k"), "conv_id", "n", "ends", "steps")
        open_ = cut(below.withColumnRenamed("_g", "g").select(*columns), "below")


def forest(group: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a bucket's tries. Columns: g, up, k, conv_id, n, ends, path, chars."""
    tops: dict[str, int] = {}
    children: list[dict[str, int]] = []
    parent, depth, own, convs, least, ends, above = [], [], [], [], [], [], []

    def node(before: int, at: int, size: int, up: str | None) -> int:
        children.append({})
        for held, value in ((parent, before), (depth, at), (own, size), (convs, 0), (least, None), (ends, NOTHING), (above, up)):
            held.append(value)
        return len(children) - 1

    for g, up, k, conv, n, end, path, chars in zip(*(group[c] for c in ("g", "up", "k", "conv_id", "n", "ends", "path", "chars")), strict=True):
        here = tops.get(g)
        if here is None:
            here = tops[g] = node(-1, k, int(chars[k - 1]), up)
        at = k
        while True:
            convs[here] += n
            least[here] = conv if least[here] is None else min(least[here], conv)
            if at == len(chars):
                break
            turn = path[at * WIDTH : (at + 1) * WIDTH]
            below = children[here].get(turn)
            if below is None:
                below = children[here][turn] = node(here, at + 1, int(chars[at]), None)
            here, at = below, at + 1
        ends[here] = end
    leaves, saved = [0 if x else 1 for x in children], [(n - 1) * size for n, size in zip(convs, own, strict=True)]
    for at in range(len(children) - 1, -1, -1):  # a node is made after its parent, so backwards is a postorder
        if parent[at] >= 0:
            leaves[parent[at]] += leaves[at]
            saved[parent[at]] += saved[at]
    return pd.DataFrame({
        "up": pd.array(above, dtype="object"), "conv_id": least, "depth": depth, "parent_conv_id": pd.array([least[p] if p >= 0 else None for p in parent], dtype="Int64"), "n_convs": convs,
        "n_children": [len(x) for x in children], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends,
    })


def chains(nodes: DataFrame, ending: DataFrame, tops: DataFrame) -> DataFrame:
    """The nodes of a round's split chains from the tops below them; the chain's own top has its up, the others their parent."""
    kids = tops.groupBy(F.col("up").alias("g")).agg(F.min("conv_id").alias("_conv"), F.sum("n_convs").alias("_convs"), F.count(F.lit(1)).alias("_children"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
    joined = nodes.join(kids, "g", "left").join(ending, "g", "left")
    zero = F.lit(0).cast("long")
    whole = joined.select(
        "g", "up", "k", "m", "chars", F.coalesce("ends", F.lit(NOTHING)).alias("ends"), F.least("_conv", "conv_id").alias("conv_id"), (F.coalesce("_convs", zero) + F.coalesce("n", zero)).alias("n_convs"),
        F.coalesce("_children", zero).alias("_children"), F.coalesce("_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("_saved", zero).alias("_saved"),
    )
    each = whole.withColumn("j", F.explode(F.sequence("k", "m")))
    last, first = F.col("j") == F.col("m"), F.col("j") == F.col("k")
    shown = F.aggregate(F.slice("chars", F.col("j") - F.col("k") + 1, F.col("m") - F.col("j") + 1), zero, lambda a, x: a + x)
    return each.select(
        "g", last.alias("_last"), F.when(first, F.col("up")).alias("up"), "conv_id", F.col("j").cast("long").alias("depth"), F.when(~first, F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("_saved") + (F.col("n_convs") - 1) * shown).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(NOTHING).alias("ends_sha256"),
    )


def prefix_trie(rows: DataFrame, most: int | None = None) -> DataFrame:
    """A row for each distinct prefix. rows: conv_id, steps (array of d, chars), an id once; see ``op13`` for the columns.

    most: turns of distinct sequences in a group; by default twice a partition's share, from 1,000 to 200,000.
    """
    spark = rows.sparkSession
    ship(spark)
    found = cut(distinct_sequences(rows), "sequences")
    turns, partitions = found.agg(F.sum(F.size("steps"))).first()[0] or 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = most or min(max(FEWEST_TURNS, 2 * turns // partitions), MOST_TURNS)
    groups, rounds = grouped(found, most)
    buckets = max(4 * partitions, turns // most + 1)
    dealt = groups.select("g", "up", "k", "conv_id", "n", "ends", F.array_join(F.transform("steps", lambda x: x["d"]), "").alias("path"), F.transform("steps", lambda x: x["chars"]).alias("chars"), F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket"))
    tries = cut(dealt.groupBy("bucket").applyInPandas(lambda group: forest(group), NODE), "tries")
    tops, parts = tries.where("up is not null"), [tries.where("up is null")]
    linked = []
    for nodes, ending in reversed(rounds):
        made = cut(chains(nodes, ending, tops.join(nodes.select(F.col("g").alias("up")), "up", "left_semi")), "chains")
        linked.append(made.where("_last").select(F.col("g").alias("_up"), F.col("conv_id").alias("_parent")))
        tops = tops.unionByName(made.where("up is not null").select(*NAMES))
        parts.append(made.where("up is null").select(*NAMES))
    above = reduce(DataFrame.unionByName, linked)
    placed = tops.join(above, F.col("up") == F.col("_up")).withColumn("parent_conv_id", F.col("_parent")).select(*NAMES)
    return reduce(DataFrame.unionByName, [placed, *parts]).drop("up")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    return prefix_trie(branched(sequences(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


def oracle_sql() -> str:
    """The same in DuckDB's SQL, by joins of all prefixes."""
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, z: case when v % 2 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end)), 4294967295::bigint)"
    return f"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
 own as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from turns),
 ids as (select conv_id, {crc} % 6 as h from (select distinct conv_id from turns)),
 rebuilt as (select ids.conv_id, 0 as later, i, role, text from ids join own b on b.conv_id = ids.conv_id - ids.conv_id % 100 and i <= h union all select conv_id, 1, i, role, text from own join ids using (conv_id) where i > h),
 placed as (select conv_id, row_number() over (partition by conv_id order by later, i) as d, sha256(length(role) || ':' || role || text) as t, length(text) as chars from rebuilt),
 keyed as (select conv_id, d, chars, string_agg(t, '') over (partition by conv_id order by d) as key from placed union all select conv_id, 0, 0, '' from ids),
 steps as (select *, lag(key) over (partition by conv_id order by d) as up, max(d) over (partition by conv_id) as last from keyed),
 nodes as (select d, key, any_value(up) as up, min(conv_id) as conv_id, count(*) as n, any_value(chars) as chars, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where d = last), '') as ends from steps group by d, key),
 kids as (select up as key, count(*) as n_children from nodes where up is not null group by up),
 below as (select distinct a.key as key, b.key as sub from steps a join steps b on a.conv_id = b.conv_id and b.d >= a.d),
 sums as (select below.key, sum((n - 1) * chars) as saved_tokens, count(*) filter (where n_children is null) as n_leaves from below join nodes on nodes.key = sub left join kids on kids.key = sub group by below.key)
select nodes.conv_id, nodes.d as depth, p.conv_id as parent_conv_id, nodes.n as n_convs, coalesce(n_children, 0)::bigint as n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, sha256(nodes.ends) as ends_sha256
 from nodes left join nodes p on p.key = nodes.up left join kids on kids.key = nodes.key join sums on sums.key = nodes.key
"""
