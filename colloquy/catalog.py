"""Every registered query of the engine with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.operators import exchange
from colloquy.plans import assorted, cycles, exchanges, folds, graphs_terms, judging, live, naming, reporting, spending, summaries, writes
from colloquy.sources.domain import turns

FAMILIES = (exchanges, folds, spending, naming, judging, graphs_terms, reporting, writes, live, assorted, cycles, summaries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchanges, islands and sizes of every session."""
    return exchange.island_sizes(exchange.islands(exchange.exchanges(turns(spark, sf_dir))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for family in FAMILIES for name, query in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLE_SQL.items()}
