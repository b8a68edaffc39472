"""Token counts of texts: batches of about equal bytes are encoded inside Arrow functions, and only lengths leave them.

A ``.json`` file counts as the tokenizers library has it, a ``.model`` file as sentencepiece. Byte-level files whose
ids follow their merges go to the faster library of the same vocabulary (``bitplanes.encoder``; tests hold both equal).
A long text is cut where no token can reach across:

* byte level: before a space that follows a letter or digit. Every match of the splitting pattern that takes a letter or
  digit ends there, and no special token may hold a space;
* sentencepiece: at one space between ASCII letters or digits, which is left out as the next piece gets one of its own.
  Only where the model puts a space before each text and no entry of its vocabulary has one after another character;
* other files, and texts without such a place: whole.

Defined cases: a null or empty text has 0 bytes and no tokens; a special token's string inside a text is what the
library makes of it by default; repeated rows count alike; an empty table gives an empty result; columns of the input
stay unless they have a name of the result's.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm import bitplanes
from colloquy.llm.common import read, text_of
from colloquy.shipping import ship

#: Bytes of text that a worker turns into Python strings and encodes at once.
BATCH_BYTES = 1 << 20
#: Characters from which on a text is cut.
PIECE_CHARS = 1 << 16
LIMIT = 512
#: The space of sentencepiece's vocabularies (a fixed value).
MARK = "▁"

BYTE_CUT = re.compile(r"[^\W_](?= )")
PIECE_CUT = re.compile(r"[0-9A-Za-z](?= [0-9A-Za-z])")


class Counter:
    """Counts of a vocabulary file's content: ``lengths`` of texts, cut at ``boundary`` if it has one."""

    def __init__(self, content: bytes, kind: str):
        self.boundary, self.skipped = None, 0
        if kind == "model":
            self._sentencepiece(content)
        else:
            self._tokenizers(content.decode())

    def _tokenizers(self, content: str) -> None:
        held = json.loads(content)
        before = held.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not held.get("normalizer")
        specials = held.get("added_tokens", [])
        if plain and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in specials):
            self.boundary = BYTE_CUT
        try:
            if not plain or self.boundary is None or held["model"].get("ignore_merges") or held["model"].get("dropout"):
                raise ValueError("not the plain byte-level family")
            encoding = bitplanes.encoder(content)
            self._each = lambda texts: [len(encoding.encode_to_numpy(t, allowed_special="all")) for t in texts]
        except ValueError:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(content)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self._each = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _sentencepiece(self, content: bytes) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        spaced = model.encode("ab", out_type=str)[0].startswith(MARK) and model.encode("a b") == model.encode("a") + model.encode("b")
        if spaced and not any(MARK in model.id_to_piece(k).lstrip(MARK) for k in range(model.get_piece_size())):
            self.boundary, self.skipped = PIECE_CUT, 1
        self._each = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]

    def pieces(self, text: str, most: int) -> Iterator[str]:
        """The text in pieces of some ``most`` characters that are encoded apart; whole without a safe boundary."""
        start = 0
        while self.boundary and len(text) - start > most:
            found = self.boundary.search(text, start + most - 1)
            if not found:
                break
            yield text[start : found.end()]
            start = found.end() + self.skipped
        yield text[start:] if start else text

    def lengths(self, texts: pa.Array, batch_bytes: int, piece_chars: int) -> list[int]:
        """The count of each text. Rows become Python strings in slices of some ``batch_bytes``, so memory stays bounded."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        out, start, held = [0] * len(sizes), 0, 0
        for at, size in enumerate(sizes):
            held += size
            if held < batch_bytes and at + 1 < len(sizes):
                continue
            self._slice(texts, start, at + 1, out, batch_bytes, piece_chars)
            start, held = at + 1, 0
        return out

    def _slice(self, texts: pa.Array, start: int, end: int, out: list[int], batch_bytes: int, piece_chars: int) -> None:
        rows, batch, held = [], [], 0
        for row, text in enumerate(texts.slice(start, end - start).to_pylist(), start):
            for piece in self.pieces(text or "", piece_chars):
                rows.append(row)
                batch.append(piece)
                held += len(piece)
                if held >= batch_bytes:
                    self._add(rows, batch, out)
                    rows, batch, held = [], [], 0
        self._add(rows, batch, out)

    def _add(self, rows: list[int], batch: list[str], out: list[int]) -> None:
        for row, n in zip(rows, self._each(batch) if batch else (), strict=True):
            out[row] += n


@lru_cache(maxsize=2)
def _counter(key: str, kind: str, load: Callable[[], bytes]) -> Counter:
    return Counter(load(), kind)


class Held:
    """A broadcast vocabulary; equal to any other, so that a worker keeps one counter for each key over its tasks."""

    def __init__(self, spark: SparkSession, content: bytes):
        self.sent = spark.sparkContext.broadcast(content)

    def __call__(self) -> bytes:
        return self.sent.value

    def __hash__(self) -> int:
        return 0

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Held)


def count_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text", limit: int = LIMIT, batch_bytes: int = BATCH_BYTES, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to every row.

    tokenizer: path of the vocabulary file on the driver; its content (a file of a few MB) is what is broadcast. No row
    is moved: counting is a map over the input's splits.
    """
    spark = docs.sparkSession
    ship(spark)
    content, kind = Path(tokenizer).read_bytes(), "model" if tokenizer.endswith(".model") else "json"
    key, load = hashlib.sha256(content).hexdigest(), Held(spark, content)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(key, kind, load)
        for texts in batches:
            yield pa.array(counter.lengths(texts, batch_bytes, piece_chars), pa.int64())

    new = ("n_bytes", "n_tokens", "over_limit")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    counted = F.arrow_udf(run, "long", F.ArrowUDFType.SCALAR_ITER)(F.col(f"`{text_col}`")).alias(f"_{key}")
    made = docs.select(*kept, F.octet_length(text_of(F.col(f"`{text_col}`"))).cast("long").alias("n_bytes"), counted)
    return made.select(*[c for c in kept], "n_bytes", F.col(f"_{key}").alias("n_tokens"), (F.col(f"_{key}") > limit).alias("over_limit"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
