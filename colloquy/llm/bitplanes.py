"""Token ids in a block format: planes of bits or bytes, each compressed with zstandard, and an index of blocks.

The file is a Parquet folder, so that Spark's committer makes it safe against lost executors on any file system.
A row is a block of at most ``block`` ids: (part, block, first_id, n_ids, plane, planes, doc_ids, doc_sizes).
part counts up in document order, first_id is the block's place in its part, planes[k] holds bit (or byte) k of every
id in the block, doc_ids and doc_sizes tell of the documents that begin in it. All columns but planes are the index.

Documents are in ascending id order, null ids first, equal ids by text. Defined cases: a null or empty text is its end
id alone; repeated rows are written each; a document longer than a block runs on in the next; an empty table gives
no block and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm.common import new_dir, parts, text_of
from colloquy.llm.transducer import byte_characters
from colloquy.shipping import ship

BLOCK = 1 << 16
#: Fixed value: the pattern that splits text before the merges of this tokenizer family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROW = "part int, block int, first_id long, n_ids int, plane string, planes array<binary>, doc_ids array<long>, doc_sizes array<long>"


@lru_cache(maxsize=2)
def encoder(content: str) -> tiktoken.Encoding:
    """The tokenizer file's merges in the faster of the two libraries; the ids are the same, the tests hold them so."""
    held = json.loads(content)
    back = {c: b for b, c in byte_characters().items()}
    special = {t["content"]: t["id"] for t in held["added_tokens"]}
    vocab = {bytes(back[c] for c in t): i for t, i in held["model"]["vocab"].items() if t not in special}
    ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(held["model"]["merges"])}
    ids = [held["model"]["vocab"][a + b] for a, b in ranks]
    if ids != sorted(ids):
        raise ValueError("ids don't follow the merges' order; this file needs its own library")
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens=special)


def to_planes(ids: np.ndarray, plane: str = "byte", level: int = 3) -> list[bytes]:
    """Planes up to the highest one that any id of the block uses."""
    press = zstandard.ZstdCompressor(level=level).compress
    raw = np.ascontiguousarray(ids, "<u4").view("u1").reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if plane == "byte":
        return [press(np.ascontiguousarray(raw[:, k]).tobytes()) for k in range((top + 7) // 8)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")[:, :top]
    return [press(x.tobytes()) for x in np.packbits(bits.T, axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, plane: str = "byte") -> np.ndarray:
    """The ids of a block, as to_planes had them."""
    open_ = zstandard.ZstdDecompressor().decompress
    raw = np.zeros((n, 4), "u1")
    if plane == "byte":
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(open_(p), "u1")
    elif len(planes):
        bits = np.zeros((n, 32), "u1")
        for k, p in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(open_(p), "u1"), bitorder="little")[:n]
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, plane: str = "byte", block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, appends end_id and writes the blocks. One shuffle puts the documents in order."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(Path(tokenizer).read_text())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(held.value).encode_to_numpy
        part, number, first = TaskContext.get().partitionId(), 0, 0
        rest, waiting = np.zeros(0, "<u4"), []

        def row(ids: np.ndarray, count: int) -> pd.DataFrame:
            begin = [(d, n) for d, n, at in waiting if at < first + count]
            del waiting[: len(begin)]
            return pd.DataFrame({"part": [part], "block": [number], "first_id": [first], "n_ids": [count], "plane": [plane], "planes": [to_planes(ids, plane)], "doc_ids": [[d for d, _ in begin]], "doc_sizes": [[n for _, n in begin]]})

        at = 0
        for batch in batches:
            held_ids = [rest]
            size = len(rest)
            for d, t in zip(batch["id"].astype(object), batch["text"], strict=True):
                ids = np.append(encode(t, allowed_special="all"), end_id).astype("<u4")
                waiting.append((None if pd.isna(d) else int(d), len(ids), at))
                at += len(ids)
                held_ids.append(ids)
                size += len(ids)
                if size >= block:
                    joined = np.concatenate(held_ids)
                    for k in range(0, len(joined) - block + 1, block):
                        yield row(joined[k : k + block], block)
                        number, first = number + 1, first + block
                    held_ids = [joined[len(joined) - len(joined) % block :]]
                    size = len(held_ids[0])
            rest = np.concatenate(held_ids)
        if len(rest):
            yield row(rest, len(rest))

    one = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    order = [F.asc_nulls_first("id"), F.asc("h"), F.asc("text")]
    placed = one.withColumn("h", F.xxhash64("text")).repartitionByRange(parts(docs), *order[:2]).sortWithinPartitions(*order)
    placed.select("id", "text").mapInPandas(run, ROW).write.parquet(path)


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents of a file: doc_id, start (ids before it), n_tokens, and ids, or with digest their crc32.

    Blocks of a part are decoded in order, holding one block and the document under way.
    """
    ship(spark)
    blocks = spark.read.schema(ROW).parquet(path)
    ahead, offsets = 0, []
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a row for each part
        offsets.append((r["part"], ahead))
        ahead += r["n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, docs, have, size, at = None, deque(), [], 0, 0
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.part != part:
                    part, docs, have, size, at = r.part, deque(), [], 0, 0
                docs += zip(r.doc_ids, r.doc_sizes, strict=True)
                have.append(from_planes(r.planes, r.n_ids, r.plane))
                size += r.n_ids
                if docs and size >= docs[0][1]:
                    ids, k = np.concatenate(have), 0
                    while docs and len(ids) - k >= docs[0][1]:
                        d, n = docs.popleft()
                        one = ids[k : k + n]
                        out.append((part, d, at, n, zlib.crc32(one.astype("<u4").tobytes()) if digest else one.astype("i4")))
                        k, at = k + n, at + n
                    have, size = [ids[k:]], len(ids) - k
            yield pd.DataFrame({"part": [x[0] for x in out], "doc_id": pd.array([None if pd.isna(x[1]) else int(x[1]) for x in out], dtype="Int64"), "at": [x[2] for x in out], "n_tokens": [x[3] for x in out], "last": [x[4] for x in out]})

    held = blocks.repartitionById(max([1, *(p + 1 for p, _ in offsets)]), F.col("part")).sortWithinPartitions("part", "block")  # a part a task
    found = held.mapInPandas(run, f"part int, doc_id long, at long, n_tokens long, last {'long' if digest else 'array<int>'}")
    ahead_of = spark.createDataFrame(offsets or [(0, 0)], "part int, _ahead long")
    return found.join(F.broadcast(ahead_of), "part").select("doc_id", (F.col("at") + F.col("_ahead")).alias("start"), "n_tokens", F.col("last").alias("ids_crc32" if digest else "ids"))


def op5(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from colloquy.llm.common import read

    path = new_dir(spark, "ids")
    write_ids(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_ids(spark, path, digest=True)
