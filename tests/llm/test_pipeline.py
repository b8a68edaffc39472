"""The pipeline against a brute-force version of its stages on a small corpus."""

from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages_do_their_work(spark, tmp_path):
    clean = [f"{k} " + " ".join(f"w{k * 7 % 211}x{j}" for j in range(60)) for k in range(120)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(clean)]
    rows += [(200 + k, clean[k], "en", f"s{k % 3}", 0) for k in range(30)]
    rows += [(300 + k, " ".join(f"junk{k}j{j}###" for j in range(40)), "en", "s0", 0) for k in range(60)]
    rows += [(400, "too short", "en", "s1", 0), (401, None, "en", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0 if 300 <= i < 400 else 1) for i, *_ in rows if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        made.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        kept[name] = [r.doc_id for r in docs.collect()]
    assert sorted(kept["quality_rules"]) == [*range(120), *range(200, 230)]
    assert sorted(kept["simhash_near_dedup"]) == list(range(120))
    assert set(kept["mixing"]) <= set(range(120)) and max(kept["mixing"].count(k) for k in set(kept["mixing"])) <= 3
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in last) == sorted(kept["mixing"])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in last[:20]:
        assert list(r.ids) == library.encode(clean[r.doc_id], add_special_tokens=False).ids
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(last)


def test_near_dedup_keeps_one_row_of_each_group_and_no_other(spark, tmp_path):
    a, b = (" ".join(f"{c}{j * 7 % 101}x{j}" for j in range(60)) for c in "ab")
    rows = [(3, a, 1, "k", "s"), (7, a, 2, "k", "s"), (7, b, 3, "k", "s"), (7, b, 4, "k", "s"), (None, b, 5, "k", "s"), (None, "alone", 6, "k", "s"), (None, "alone", 7, "k", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int, copies string, id string")
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text, r.h) for r in kept.collect()) == [(0, "alone", 6), (3, a, 1), (7, b, 3)]
