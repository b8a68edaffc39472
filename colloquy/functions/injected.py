"""Injected callables: proposing, judging, deciding and grading by functions the caller brings.

A callable sees whole Arrow batches. Expensive ones run only on the rows that cheap rules leave over, which is a
split and a union of frames, as a CASE does not keep a UDF from running. Judging fails open: an error lets the row
pass with a null probability and is kept in ``error``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from colloquy.functions.names import keyword_grade
from colloquy.shipping import ship

PROPOSAL = "term string, paraphrase string, assistant_line long, signal string, importance string"


def salvage(text: str) -> list[dict]:
    """The whole objects at the front of the list under "candidates" (none without that key), however it was cut off.

    One scan that counts brackets outside strings; the list ends at the first item that is no object.
    """
    key = text.find('"candidates"')
    start = text.find("[", key) if key >= 0 else -1
    out: list[dict] = []
    depth, began, quoted, skip = 0, 0, False, False
    for at in range(start + 1, len(text)) if start >= 0 else ():
        c = text[at]
        if quoted:
            skip, quoted = c == "\\" and not skip, c != '"' or skip
        elif c in "{[" and (depth or c == "{"):
            began, depth = (at if depth == 0 else began), depth + 1
        elif c in "}]" and depth:
            depth -= 1
            if depth == 0:
                try:
                    out.append(json.loads(text[began : at + 1]))
                except ValueError:
                    break
        elif depth and c == '"':
            quoted = True
        elif not depth and c not in ", \t\r\n":
            break
    return out


def retrying(call: Callable, again: Callable) -> Callable:
    """A call that, where it raises or gives nothing, is tried once more in another way (as without reasoning, when out of room)."""

    def both(*args):
        try:
            found = call(*args)
        except Exception:  # noqa: BLE001  whatever the caller's function raises
            found = None
        return found if found else again(*args)

    return both


#: What a decider may decide; and its word for a typed text that names nothing.
DECISIONS, UNRESOLVABLE = ("new", "existing", "alias"), "unclear"
SAID = "decision string, concept_id string, canonical_name string, alias string, paraphrase string, reasoning string, error string"


def decide(rows: DataFrame, call: Callable[[str, list[str]], dict], known: DataFrame) -> DataFrame:
    """Adds decision, concept_id, canonical_name, alias, proposed_name, paraphrase, reasoning and error to submissions.

    rows: text, source (transcript, manual or material), shortlist (array of concept ids); known: concept_id (string),
    canonical_name, of the whole graph, as a decision may name a concept that was not offered. What names a concept that
    does not exist, or decides anything else, is new; unclear stays only for what a person typed. A new concept from a
    transcript keeps the name it was met by, and the other name is kept as proposed; an alias is the text unless another
    is named. A call that raises decides nothing (decision null) and says so in error.
    """
    ship(rows.sparkSession)
    names = [x.split(" ")[0] for x in SAID.split(", ")]

    def run(batches: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            out = []
            for text, offered in zip(texts, lists, strict=True):
                try:
                    said, error = call(text, list(offered)) or {}, None
                except Exception as e:  # noqa: BLE001  whatever the caller's function raises
                    said, error = {}, f"{type(e).__name__}: {e}"[:200]
                held = {n: str(said.get(n) or "").strip() for n in names}
                out.append((held["decision"].lower(), *(held[n] or None for n in names[1:-1]), error))
            yield pd.DataFrame(out, columns=names)

    taken = [c for c in rows.columns if c not in names]
    said = F.pandas_udf(run, SAID, F.PandasUDFType.SCALAR_ITER)("text", "shortlist")
    asked = rows.select(*taken, said.alias("_d"))
    there = known.select(F.col("concept_id").cast("string").alias("_id"), F.col("canonical_name").alias("_name")).dropDuplicates(["_id"])
    both = asked.join(there, F.col("_d.concept_id") == F.col("_id"), "left")
    text = F.trim("text")
    unclear = (F.col("_d.decision") == UNRESOLVABLE) & (F.col("source") == "manual")
    files = F.col("_d.decision").isin("existing", "alias") & F.col("_id").isNotNull()
    decision = F.when(F.col("_d.error").isNotNull(), F.lit(None)).when(unclear, UNRESOLVABLE).when(files, F.col("_d.decision")).otherwise("new")
    tidy = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    own = F.coalesce("_d.canonical_name", text)
    renamed = (F.col("source") == "transcript") & (tidy(own) != tidy(text))
    judged = both.withColumn("decision", decision)
    new = F.col("decision") == "new"
    return judged.select(
        *taken, "decision", F.when(F.col("decision").isin("existing", "alias"), F.col("_id")).alias("concept_id"), F.when(new, F.when(renamed, text).otherwise(own)).when(F.col("decision").isin("existing", "alias"), F.col("_name")).alias("canonical_name"),
        F.when(F.col("decision") == "alias", F.coalesce("_d.alias", text)).alias("alias"), F.when(new & renamed, own).alias("proposed_name"), "_d.paraphrase", "_d.reasoning", "_d.error",
    )


def write(rows: DataFrame, call: Callable[[str], dict]) -> DataFrame:
    """Adds body and covers (of the concepts asked for, in their order) to prompts; a call that fails has neither. rows: prompt, wanted."""
    ship(rows.sparkSession)

    def run(batches: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        for prompts, wanted in batches:
            out = []
            for prompt, asked in zip(prompts, wanted, strict=True):
                try:
                    said = call(prompt) or {}
                except Exception:  # noqa: BLE001
                    said = {}
                body = str(said.get("body") or "").strip() or None
                named = set(said.get("covers") or ())
                out.append((body, [c for c in asked if c in named] if body else None))
            yield pd.DataFrame(out, columns=["body", "covers"])

    made = F.pandas_udf(run, "body string, covers array<string>", F.PandasUDFType.SCALAR_ITER)("prompt", "wanted")
    return rows.withColumn("_w", made).select(*rows.columns, "_w.*")


def propose(chunks: DataFrame, call: Callable[[str], list[dict]], workers: int) -> DataFrame:
    """0..n proposals of each chunk's prompt. chunks: session_id, chunk, prompt; workers bounds calls in flight."""
    ship(chunks.sparkSession)
    fields = [x.split(" ")[0] for x in PROPOSAL.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.session_id, r.chunk, k, *(p.get(f) for f in fields)) for r in b.itertuples() for k, p in enumerate(call(r.prompt))]
            yield pd.DataFrame(rows, columns=["session_id", "chunk", "pos", *fields])

    return chunks.select("session_id", "chunk", "prompt").repartition(workers).mapInPandas(run, f"session_id {dict(chunks.dtypes)['session_id']}, chunk long, pos long, {PROPOSAL}")


def judge(rows: DataFrame, call: Callable[[str, str], float], skip, term: str = "term", gloss: str = "gloss") -> DataFrame:
    """Adds p (null: not asked, or the call failed) and error. skip: rows that are not asked about."""
    ship(rows.sparkSession)

    def run(batches: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        for terms, glosses in batches:
            out = []
            for t, g in zip(terms, glosses, strict=True):
                try:
                    out.append((float(call(t, g)), None))
                except Exception as e:  # noqa: BLE001  whatever the caller's function raises
                    out.append((None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["p", "error"])

    asked = rows.where(~skip).withColumn("_j", F.pandas_udf(run, "p double, error string", F.PandasUDFType.SCALAR_ITER)(term, gloss))
    return asked.select(*rows.columns, "_j.p", "_j.error").unionByName(rows.where(skip).withColumns({"p": F.lit(None).cast("double"), "error": F.lit(None).cast("string")}))


def grade(answers: DataFrame, call: Callable[[str, str], str] | None = None) -> DataFrame:
    """Adds level, by the caller's function or by the keyword rule; a level that is not in the catalogue is isolated."""
    if call is None:
        return answers.withColumn("level", keyword_grade(F.col("answer")))
    ship(answers.sparkSession)

    def run(batches: Iterator[tuple]) -> Iterator[pd.Series]:
        for questions, texts in batches:
            yield pd.Series([call(q, a) for q, a in zip(questions, texts, strict=True)], dtype="object")

    level = F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)("question", "answer")
    return answers.withColumn("_l", level).withColumn("level", F.when(F.col("_l").isin("causal", "listed", "isolated"), F.col("_l")).otherwise("isolated")).drop("_l")


def argmax_level(probabilities):
    """The likeliest level of a map, the first of the catalogue among equals."""
    order = ("isolated", "listed", "causal")
    best = F.array_max(F.transform(F.array(*[F.struct(F.coalesce(F.try_element_at(probabilities, F.lit(x)), F.lit(-1.0)).alias("p"), F.lit(-k).alias("k"), F.lit(x).alias("level")) for k, x in enumerate(order)]), lambda x: x))
    return best["level"]


def threshold_level(probabilities, cut: float):
    """The highest level whose probability, with that of all above it, reaches a cut."""
    p = lambda x: F.coalesce(F.try_element_at(probabilities, F.lit(x)), F.lit(0.0))
    return F.when(p("causal") >= cut, "causal").when(p("causal") + p("listed") >= cut, "listed").otherwise("isolated")
