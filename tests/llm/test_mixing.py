"""Mixed documents hold what the mix takes, repeated rows too."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.llm import entropy_mix as M

SCHEMA = "doc_id long, text string, source string, note string"


@pytest.mark.parametrize("equal", [2_000, 200])
def test_equal_rows_are_dealt_like_the_mix(spark, equal):
    rows = [(1, "five words stand right here", "a", f"n{k}") for k in range(equal)]
    rows += [(k, " ".join(["w"] * (1 + k % 9)), "b", None) for k in range(10, 400)] + [(1, "five words stand right here", None, "x")] * 7
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    plan = M.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("size"), F.max("copies").alias("most")).collect()
    mixed = M.mixed_documents(docs)
    words = F.size(F.split("text", " "))
    got = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(words).alias("n")).collect()}
    for r in plan:
        assert got.get(r["source"], 0) == r["taken"] and abs(r["taken"] - r["target"]) <= r["size"] and r["most"] <= 3
    per = Counter(r["note"] for r in mixed.where("source = 'a'").collect())
    counts = [per[f"n{k}"] for k in range(equal)]
    assert max(counts) - min(counts) <= 1


def test_every_column_and_null_stays(spark):
    rows = [(None, None, None, None), (None, "a b", "s", "p"), (2, "", "s", "q"), (3, "c d e", "s", "r"), (3, "c d e", "s", "r")]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = M.mix(docs).agg(F.sum("copies")).first()[0]
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == taken
    assert M.mixed_documents(spark.createDataFrame([], SCHEMA)).collect() == []
