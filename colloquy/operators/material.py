"""Sources for explanations: hits in code, verified pages, searches, and the ordered union of what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: How much text stands around a hit, and how many sources of a kind are taken.
BEFORE, AROUND, CODE_HITS, SEARCH_HITS = 260, 800, 3, 5
SKIP = r"(^|/)(\.git|node_modules|dist|build|__pycache__|\.venv)/"


def code_files(spark: SparkSession, folder: str, glob: str = "*.{py,js,ts,go,rs,java,md}") -> DataFrame:
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")).where(~F.col("path").rlike(SKIP))


def excerpt(text: Column, at: Column) -> Column:
    return F.substring(text, F.greatest(at - BEFORE, F.lit(1)), F.lit(AROUND))


def from_code(files: DataFrame, terms: DataFrame, most: int = CODE_HITS) -> DataFrame:
    """The first hit of a term in each file, of the first files by path. files: path, content; terms: term.

    Files meet terms by the first word of the term, so a term is looked for only where that word is.
    """
    word = lambda c: F.explode(F.array_distinct(F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), "")))
    first = terms.select("term", F.get(F.array_remove(F.split(F.lower("term"), "[^a-z0-9]+"), ""), F.lit(0)).alias("w")).where("w is not null")
    held = files.select("path", "content", word(F.col("content")).alias("w")).join(first, "w")
    at = F.expr("locate(lower(term), lower(content))")
    hits = held.withColumn("at", at).where("at > 0").select("term", "path", "at", excerpt(F.col("content"), F.col("at")).alias("excerpt"))
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy("term").orderBy("path"))).where(F.col("_n") <= most).drop("_n")


def verified_pages(pages: DataFrame, term: str) -> DataFrame:
    """Pages whose text holds the term, with what stands around it."""
    from colloquy.functions.names import html_strip

    text = pages.withColumn("_t", html_strip(F.col("html"))).withColumn("_at", F.instr(F.lower("_t"), term.lower()))
    return text.where("_at > 0").select("page_id", "url", excerpt(F.col("_t"), F.col("_at")).alias("excerpt"))


def search_candidates(found: DataFrame, most: int = SEARCH_HITS) -> DataFrame:
    """Distinct URLs in order, capped, with short titles. found: term, place, url, title."""
    one = found.groupBy("term", "url").agg(F.min("place").alias("place"), F.min_by(F.left("title", F.lit(140)), "place").alias("title"))
    return one.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy("place")).cast("long")).where(F.col("n") <= most).select("term", "n", "url", "title")


def gather(*sources: DataFrame) -> DataFrame:
    """Sources of several kinds in the order given, numbered S1.. for each term. Each: term, place, body."""
    every = sources[0].withColumn("_k", F.lit(0))
    for k, s in enumerate(sources[1:], 1):
        every = every.unionByName(s.withColumn("_k", F.lit(k)))
    n = F.row_number().over(Window.partitionBy("term").orderBy("_k", "place"))
    return every.withColumn("label", F.concat(F.lit("S"), n.cast("string"))).drop("_k")
