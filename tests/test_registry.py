"""Every registered query against its SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from pixelmill.plans import registry

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {name for name in registry.queries() if name not in registry.oracle_sql()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (int, float)):
        return None if math.isnan(value) else round(float(value), 5) + 0.0
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    found = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(found.columns)
    ours, theirs = rows_of(got.columns, got.collect()), rows_of(found.columns, found.fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, float) for x in a + b) else a == b


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["season", "pixel", "dn", "season_name"] and df.count() > 0


def test_entry_points_name_the_same_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert all(callable(f) for f in __spark_entry__.queries().values())
