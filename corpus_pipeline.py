"""The corpus pipeline: quality rules, SimHash near-dedup, mixing to target weights, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept and returns a DataFrame; all but the
last return the columns of documents. ``run`` writes each result as Parquet in the shared folder and reads it again
for the next, so a lost executor costs a stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm import decision_list, entropy_mix, simhash, transducer
from colloquy.llm.common import cut, new_dir, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    judged = decision_list.quality_rules(docs, read(spark, sf_dir, "labels"), keep_row=True)
    return judged.where("kept").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts at a similarity of 0.8 or more on five-word shingles one row stays.

    It is one with the group's smallest id; of several texts with that id one is kept, and the others stay only if they
    are in groups of their own. Rows without an id are grouped by their texts like all others.
    """
    groups = simhash.similar_texts(docs, shingle=5, least=0.8).where("first").groupBy("id", "h").agg(F.count(F.lit(1)).alias("copies"))
    groups = cut(groups, "groups")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named = docs.select(F.col("doc_id").alias("_id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("h"), row.alias("_row"))
    met = named.join(groups, (named["h"] == groups["h"]) & named["_id"].eqNullSafe(groups["id"])).select("_id", named["h"], "_row", "copies")
    if groups.where("copies > 1").isEmpty():
        return met.select("_row.*")
    repeated = met.where("copies > 1").groupBy("_id", "h").agg(F.min("_row").alias("_row"))
    return met.where("copies = 1").select("_row").union(repeated.select("_row")).select("_row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for."""
    return entropy_mix.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and what they decode to, of every document of the mix."""
    import public_tokenizers

    encoded = transducer.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", "source", "n_tokens", "ids", "decoded")


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("mixing", mixing), ("bpe_encoding", encoding)]

#: SimHash votes, learned rules and merges have no SQL form; tests/llm holds the pipeline to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made, path = stage(spark, docs, sf_dir), new_dir(spark, name)
        made.write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
