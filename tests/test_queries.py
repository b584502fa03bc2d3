"""Every registered query with SQL against DuckDB on the smallest test data."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tidemark.plans.registry import FLAGSHIP, ORACLES, QUERIES


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in Path(small).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 8)
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, tables, name):
    df = QUERIES[name](spark, small)
    result = tables.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    want = Counter(tuple(map(plain, r)) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and FLAGSHIP in ORACLES
