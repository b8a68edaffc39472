"""Every query with SQL gives DuckDB's rows on the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest
from conftest import DATA

from colloquy import catalog

SF = str(DATA / "sf0.001")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in DATA.joinpath("sf0.001").glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    kinds = {d[0]: str(d[1]) for d in found.description}
    assert {c: KINDS[k] for c, k in df.dtypes if k in KINDS} == {c: kinds[c] for c, k in df.dtypes if k in KINDS}
    cols = sorted(names)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=str)
    assert mine == theirs


def test_every_query_is_named_once():
    names = [n for f in catalog.FAMILIES for n in f.QUERIES]
    assert len(names) == len(set(names)) and set(catalog.oracle_sql()) <= set(names)
