"""Token counts against the libraries themselves, whole texts at once."""

import random

import public_tokenizers
import pytest

from colloquy.llm import queries, token_counts as T

TEXTS = [
    None, "", " ", "\n", "a", "  two  spaces ", "it's we're I'll x'S", "tabs\tand\nlines\n\n end ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endoftext|", "äöü ß 漢字かな 12345 ½ ١٢٣", "é  nbsp   x",
    "a\x1cb \x1d c", "no_space_" * 50, "word " * 300, "x  y   z " * 200, "1 2 3 4 " * 200, "emoji 👩‍👩‍👧 ok", "the same", "the same", "▁ a ▁b c", "<s> a </s> b <unk> c",
]


def whole(path: str, texts: list) -> list[int]:
    if path.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts], num_threads=1)]
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize(("batch", "piece"), [(1 << 20, 1 << 16), (40, 7), (1, 1)])
def test_cut_texts_count_as_whole_ones(spark, name, batch, piece):
    path = public_tokenizers.path(name)
    rng = random.Random(5)
    mixed = ["".join(rng.choice(["a", "B", " ", " ", "  ", "\n", "7", "'s", "é", "漢", ".", "_", "<|endoftext|>", " "]) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    texts = [*TEXTS, *mixed]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = {r["id"]: r for r in T.count_tokens(rows, path, limit=20, batch_bytes=batch, piece_chars=piece).collect()}
    expected = whole(path, texts)
    assert [got[k]["n_tokens"] for k in range(len(texts))] == expected
    assert [got[k]["n_bytes"] for k in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert all(got[k]["over_limit"] == (n > 20) for k, n in enumerate(expected))


def test_boundaries():
    byte = T.Counter(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read(), "json")
    piece = T.Counter(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read(), "model")
    word = T.Counter(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read(), "json")
    assert list(byte.pieces("ab cd ef", 3)) == ["ab cd", " ef"]
    assert list(piece.pieces("ab cd ef", 3)) == ["ab cd", "ef"]
    assert word.boundary is None and list(word.pieces("ab cd", 1)) == ["ab cd"]
    assert list(byte.pieces("x" * 50, 7)) == ["x" * 50]


def test_very_long_text_and_clashing_columns(spark):
    text = "The quick brown fox, it's 12 o'clock.\n" * 60_000
    rows = spark.createDataFrame([(1, text, 7, 8.0, "x")], "id long, text string, n_tokens int, n_bytes double, `a.b` string")
    got = T.count_tokens(rows, public_tokenizers.path("byte_bpe_50k.json"))
    assert got.columns == ["id", "text", "a.b", "n_bytes", "n_tokens", "over_limit"]
    row = got.first()
    assert row["n_tokens"] == whole(public_tokenizers.path("byte_bpe_50k.json"), [text])[0] and row["over_limit"]


def test_empty_table(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert T.count_tokens(rows, public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_op11_whole_table(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op11_token_counts"](spark, small)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    counts = whole(public_tokenizers.path("byte_bpe_50k.json"), [r["text"] for r in rows])
    expected = sorted((r["doc_id"], len((r["text"] or "").encode()), n, n > 512) for r, n in zip(rows, counts, strict=True))
    assert sorted(map(tuple, got.collect())) == expected
