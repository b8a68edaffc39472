"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Frequent words are compiled, with their ids as output, into a minimal acyclic automaton (states with equal futures
are one, so suffixes are shared). Each arc carries how many words come before it, so a walk sums up to the word's
number and that to its ids. The flat arrays are memory-mapped by each worker; words that the lexicon lacks are
merged exactly by the merge ranks. Results are those of the tokenizer file whatever the lexicon holds. A text with
characters that are newer than Python's Unicode tables is encoded by the file's own library.

Defined cases: a null or empty text has no ids and decodes to an empty text; the strings of special tokens become
their ids wherever they stand, as in the file's library; repeated rows encode alike; a very long text is one row; an
empty table gives an empty result; columns of the input stay, unless they have a name of the result's.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import mmap
import os
import re
import struct
import tempfile
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import repeat
from operator import itemgetter
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import cut, text_of
from colloquy.shipping import ship

#: Words that the lexicon takes from the corpus, at most; with it the bound of what is broadcast (a few MB).
LEXICON_WORDS = 32_768
#: Words of one worker kept besides the lexicon, at most twice so many.
MEMO_WORDS = 300_000
#: Above any id: two ids make one key.
PAIR = 1 << 20
#: Rows whose ids and decoded text a worker holds at once.
ROWS = 128
#: Finds characters beyond the first blocks, all of which every Unicode table has.
BEYOND = re.compile("[^\x00-\u036f]").search


def byte_characters() -> dict[int, str]:
    """The visible character that stands for each byte: printable Latin-1 as itself, the others from 256 up in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordBpe:
    """A byte-level BPE whose words end in a suffix, read from a tokenizer file's content."""

    def __init__(self, content: str):
        self.content = content
        held = json.loads(content)
        model = held["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        self.merged = ["".join(pair) for pair in self.ranks]
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pattern = next(p["pattern"]["Regex"] for p in held["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(pattern).findall
        self.parts = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")").split
        self.bytes = byte_characters()

    @cached_property
    def unassigned(self):
        """Finds characters that this Python's Unicode tables lack: newer tables, as of the regex module or of the
        tokenizer library, may each have them in another class or case."""
        import sys

        ranges, start = [], None
        for c in range(0x370, sys.maxunicode + 2):
            lacks = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
            if lacks and start is None:
                start = c
            elif not lacks and start is not None:
                ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
        return re.compile(f"[{''.join(ranges)}]").search

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.content)

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then each character's own lower case (so no final sigma)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def units(self, word: str) -> list[str]:
        found = list(word.encode().decode("latin-1").translate(self.bytes))
        found[-1] += self.suffix
        return found

    def merge(self, word: str) -> list[int]:
        """The ids of one word by its merges, lowest rank first and from the left."""
        units, ranks, merged, none = self.units(word), self.ranks.get, self.merged, len(self.merged)
        while len(units) > 1:
            found = list(map(ranks, zip(units, units[1:], strict=False), repeat(none)))
            least = min(found)
            if least == none:
                break
            k = found.index(least)
            units[k : k + 2] = [merged[least]]
        return list(map(self.vocab.__getitem__, units))

    def merge_long(self, word: str) -> list[int]:
        """The same for very long words in n log n: a heap of (rank, place) over a linked list."""
        import heapq

        units: list[str | None] = self.units(word)
        n = len(units)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, units[k], units[k + 1]) for k in range(n - 1) if (r := self.ranks.get((units[k], units[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if units[k] != a or j >= n or units[j] != b:
                continue
            units[k], units[j], after[k] = a + b, None, after[j]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (r := self.ranks.get((units[x], units[y]))) is not None:
                    heapq.heappush(heap, (r, x, units[x], units[y]))
        return [self.vocab[u] for u in units if u is not None]

    @cached_property
    def tables(self) -> tuple[np.ndarray, ...]:
        """Ids of bytes inside and at the end of a word; sorted pair keys with their ranks; the id each rank merges to."""
        inner = np.array([self.vocab[self.bytes[b]] for b in range(256)], "i8")
        final = np.array([self.vocab[self.bytes[b] + self.suffix] for b in range(256)], "i8")
        keys = np.array([self.vocab[a] * PAIR + self.vocab[b] for a, b in self.ranks], "i8")
        order = np.argsort(keys)
        return inner, final, keys[order], order.astype("i8"), np.array([self.vocab[m] for m in self.merged], "i8")

    def merge_many(self, words: list[str]) -> list[bytes]:
        """The ids of many words at once, as little-endian 32-bit integers: every round merges each word's lowest and
        leftmost pair, and only pairs beside a merge are looked up again."""
        if not words:
            return []
        inner, final, keys, ranks, merged = self.tables
        none = len(merged)
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw])
        flat = np.frombuffer(b"".join(raw), "u1")
        sym, owner = inner[flat], np.repeat(np.arange(len(raw)), sizes)
        last = np.cumsum(sizes) - 1
        sym[last] = final[flat[last]]

        def rank_at(at: np.ndarray) -> np.ndarray:
            """Ranks of the pairs that begin at these places; none at a word's end."""
            right = np.minimum(at + 1, len(sym) - 1)
            key = sym[at] * PAIR + sym[right]
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where((owner[at] == owner[right]) & (right > at) & (keys[k] == key), ranks[k], none)

        rank = rank_at(np.arange(len(sym)))
        out: list[bytes] = [b""] * len(raw)
        while len(sym):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            spans = np.diff(np.append(first, len(sym)))
            least = np.repeat(np.minimum.reduceat(rank, first), spans)
            ended = least == none
            if ended.any():
                ids = sym[ended].astype("<u4").tobytes()
                begins = np.flatnonzero(ended[first])
                at = 0
                for w, n in zip(owner[first[begins]].tolist(), (spans[begins] * 4).tolist(), strict=True):
                    out[w] = ids[at : at + n]
                    at += n
                keep = ~ended
                sym, owner, rank, least = sym[keep], owner[keep], rank[keep], least[keep]
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == least)
            hits = hits[np.append(True, owner[hits[1:]] != owner[hits[:-1]])]
            sym[hits] = merged[rank[hits]]
            keep = np.ones(len(sym), bool)
            keep[hits + 1] = False
            moved = np.cumsum(keep) - 1
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            at = moved[hits]
            touched = np.concatenate([at, at[at > 0] - 1])
            rank[touched] = rank_at(touched)
        return out

    def ids_of(self, word: str) -> list[int]:
        return self.merge(word) if len(word) < 64 else self.merge_long(word)


class Lexicon:
    """The automaton as flat arrays: arcs of a state lie together, sorted by label."""

    FIELDS = ("first", "labels", "targets", "counts", "final", "starts", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def compile(cls, outputs: dict[bytes, list[int]]) -> Lexicon:
        """Adds sorted words one by one; a state is looked up among equal ones once no later word can change it."""
        register: dict[tuple, int] = {}
        arcs: list[tuple[tuple[int, int], ...]] = []
        finals: list[bool] = []

        def frozen(final: bool, out: list[list[int]]) -> int:
            key = (final, tuple(map(tuple, out)))
            if key not in register:
                register[key] = len(arcs)
                arcs.append(key[1])
                finals.append(final)
            return register[key]

        ordered = sorted(w for w in outputs if w)
        path: list[list] = [[False, []]]  # of the last word: [final, arcs], the last arc of each still open
        last = b""
        for word in [*ordered, b""]:
            same = len(os.path.commonprefix([last, word]))
            while len(path) > same + 1:
                final, out = path.pop()
                path[-1][1][-1][1] = frozen(final, out)
            for b in word[same:]:
                path[-1][1].append([b, -1])
                path.append([False, []])
            path[-1][0] = bool(word)
            last = word
        root = frozen(False, path[0][1])
        below: list[int] = []  # words reachable; children are frozen before their parents
        for final, out in zip(finals, arcs, strict=True):
            below.append(final + sum(below[t] for _, t in out))
        first, labels, targets, counts = [0], [], [], []
        order = [root, *(s for s in range(len(arcs)) if s != root)]
        number = {s: k for k, s in enumerate(order)}
        for s in order:
            ahead = int(finals[s])
            for b, t in arcs[s]:
                labels.append(b)
                targets.append(number[t])
                counts.append(ahead)
                ahead += below[t]
            first.append(len(labels))
        starts = np.cumsum([0, *(len(outputs[w]) for w in ordered)])
        return cls({
            "first": np.array(first, "<u4"), "labels": np.array(labels, "u1"), "targets": np.array(targets, "<u4"), "counts": np.array(counts, "<u4"),
            "final": np.array([finals[s] for s in order], "u1"), "starts": starts.astype("<u4"), "ids": np.array([i for w in ordered for i in outputs[w]], "<u4"),
        })

    def dump(self) -> bytes:
        head, body = [], b""
        for name in self.FIELDS:
            a = getattr(self, name)
            body += b"\0" * (-len(body) % 8)
            head.append([name, a.dtype.str, len(body), len(a)])
            body += a.tobytes()
        top = json.dumps(head).encode()
        top += b" " * (-len(top) % 8)
        return len(top).to_bytes(8, "little") + top + body

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """Maps the bytes from a file that has no name any more: pages are shared and go with the process."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        top = int.from_bytes(held[:8], "little")
        view, kinds = memoryview(held), {"<u4": "I", "|u1": "B"}
        span = lambda kind, n, at: view[8 + top + at : 8 + top + at + n * np.dtype(kind).itemsize].cast(kinds[kind])
        return cls({name: span(kind, n, at) for name, kind, at, n in json.loads(held[8 : 8 + top])})

    def find(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit integers, or None."""
        state = before = 0
        first, labels, targets, counts = self.first, self.labels, self.targets, self.counts
        for b in word:
            hi = first[state + 1]
            k = bisect.bisect_left(labels, b, first[state], hi)
            if k == hi or labels[k] != b:
                return None
            before += counts[k]
            state = targets[k]
        return self.ids[self.starts[before] : self.starts[before + 1]].tobytes() if self.final[state] else None

    def __len__(self) -> int:
        return len(self.starts) - 1


class Codec:
    """Encodes and decodes with a lexicon before the merges."""

    def __init__(self, bpe: WordBpe, lexicon: Lexicon):
        self.bpe, self.lexicon, self.hits, self.misses = bpe, lexicon, 0, 0
        codec = self

        class Memo(dict):
            """Words met lately: when it is full it becomes the older half, and what is met again comes back from there."""

            older: dict[str, bytes] = {}

            def __missing__(self, word: str) -> bytes:
                found = self.older.get(word)
                if found is None:
                    found = codec.lexicon.find(word.encode())
                    if found is None:
                        codec.misses += 1
                        ids = codec.bpe.ids_of(word)
                        found = struct.pack(f"<{len(ids)}I", *ids)
                if len(self) >= MEMO_WORDS:
                    self.older = dict(self)
                    self.clear()
                self[word] = found
                return found

        self.memo = Memo()

    def learn(self, words: Iterable[str]) -> None:
        """Brings words that were not met before into the memo, those that the lexicon lacks merged all at once."""
        memo = self.memo
        new, rest = [w for w in words if w not in memo and w not in memo.older and len(w) < 64], []
        if len(memo) + len(new) > MEMO_WORDS:
            memo.older = dict(memo)
            memo.clear()
        for w in new:
            found = self.lexicon.find(w.encode())
            if found is None:
                rest.append(w)
            else:
                memo[w] = found
        if rest:
            self.misses += len(rest)
            memo.update(zip(rest, self.bpe.merge_many(rest), strict=True))

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        found = [self.words(t) for t in texts]
        self.learn(set().union(*(ws for ws in found if isinstance(ws, list))))
        return [ws if isinstance(ws, bytes) else b"".join(map(self.memo.__getitem__, ws)) for ws in found]

    def words(self, text: str | None) -> list[str] | bytes:
        """The words of a text, or its ids if special tokens or unknown characters are in it."""
        if text and BEYOND(text) and self.bpe.unassigned(text):
            ids = self.bpe.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        parts = self.bpe.parts(text or "")
        if len(parts) == 1:
            return self.bpe.find(self.bpe.normal(parts[0]))
        out: list[bytes] = []
        for part in parts:
            if part in self.bpe.special:
                out.append(self.bpe.special[part].to_bytes(4, "little"))
            elif part:
                out.extend(map(self.memo.__getitem__, self.bpe.find(self.bpe.normal(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space, as the file names no decoder."""
        found = np.frombuffer(ids, "<u4").tolist()
        return " ".join(itemgetter(*found)(self.bpe.tokens)) if len(found) > 1 else "".join(self.bpe.tokens[i] for i in found)


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS, text_col: str = "text") -> list[str]:
    """The most frequent lower-case letter runs over all texts, at most so many.

    Counts are aggregated over the corpus; how many words have each count gives the least count that still fits, and
    only words from there on come to the driver, so no task sorts or sends more than that.
    """
    found = docs.select(F.explode(F.split(F.lower(text_of(text_col)), r"[^\p{L}]+")).alias("w")).where("w <> ''")
    counted = cut(found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "words")
    steps = counted.groupBy(F.floor(16 * F.log2("n")).alias("step")).count().collect()  # a bounded number of rows: 16 a doubling
    room, least = most, None
    for r in sorted(steps, key=lambda r: -r["step"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    return [] if least is None else [r["w"] for r in counted.where(F.floor(16 * F.log2("n")) >= least).select("w").collect()]


@lru_cache(maxsize=2)
def _codec(key: str, load) -> Codec:
    content, lexicon = load()
    return Codec(WordBpe(content), Lexicon.mapped(lexicon))


def build(content: str, frequent: Iterable[str]) -> Lexicon:
    """Whole words of the vocabulary and the frequent words of the corpus, with their ids."""
    bpe = WordBpe(content)
    back = {c: b for b, c in bpe.bytes.items()}
    end = len(bpe.suffix)
    known = {}
    for token in bpe.vocab:
        if token.endswith(bpe.suffix) and len(token) > end:
            with_bytes = bytes(back[c] for c in token[:-end])
            try:
                known[with_bytes] = bpe.ids_of(with_bytes.decode())
            except UnicodeDecodeError:  # part of a character, so never a whole word
                continue
    return Lexicon.compile(known | {w.encode(): bpe.ids_of(w) for x in frequent if (w := bpe.normal(x))})


def encode_documents(docs: DataFrame, tokenizer: str, text_col: str = "text", most_words: int = LEXICON_WORDS, digest: bool = False) -> DataFrame:
    """Adds ids (array of int) and decoded to every row, or with digest their count and SHA-256 sums.

    tokenizer: path of the tokenizer file on the driver. No row is moved: encoding is a map over the input's splits.
    """
    spark = docs.sparkSession
    ship(spark)
    content = Path(tokenizer).read_text()
    held = spark.sparkContext.broadcast((content, build(content, frequent_words(docs, most_words, text_col)).dump()))
    key = hashlib.sha256(held.value[1]).hexdigest()

    class Load:
        """Equal for equal content, so that a worker keeps one codec over its tasks."""

        def __call__(self):
            return held.value

        def __hash__(self):
            return hash(key)

        def __eq__(self, other):
            return True

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(key, Load())
        for texts in batches:
            for at in range(0, len(texts), ROWS):
                ids = codec.encode_all(texts.iloc[at : at + ROWS].tolist())
                decoded = [codec.decode(x) for x in ids]
                n = [len(x) // 4 for x in ids]
                if digest:
                    yield pd.DataFrame({"n_tokens": n, "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded]})
                else:
                    yield pd.DataFrame({"n_tokens": n, "ids": [np.frombuffer(x, "<i4") for x in ids], "decoded": decoded})

    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "n_tokens long, ids array<int>, decoded string"
    new = [x.split(" ")[0] for x in kind.split(", ")]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    made = F.pandas_udf(run, kind, F.PandasUDFType.SCALAR_ITER)(F.col(text_col)).alias(f"_{key}")
    return docs.select(*kept, made).select(*kept, f"_{key}.*")


def op3(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from colloquy.llm.common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
