"""The registered queries of this subpackage against their SQL, run by DuckDB on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from pixelmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    expected = sorted(map(repr, found.fetchall()))
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == expected and expected
