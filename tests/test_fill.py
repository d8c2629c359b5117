"""Filling by frontier and the distance transform against plain loops."""

from __future__ import annotations

import time

import numpy as np
import pytest

from pixelmill.operators import neighbourhood
from pixelmill.operators.spatial import distance, row_minima
from pixelmill.session import work_scope


def plain_fill(now: dict, max_rounds: int, k: int) -> tuple[dict, list[int]]:
    left = [sum(v is None for v in now.values())]
    while left[-1] and len(left) <= max_rounds and (len(left) < 2 or left[-1] < left[-2]):
        means = {}
        for (r, c), v in now.items():
            if v is None:
                near = [now[x] for i in range(-k, k + 1) for j in range(-k, k + 1) if now.get(x := (r + i, c + j)) is not None]
                if near:
                    means[r, c] = sum(near) / len(near)
        now = now | means
        left.append(sum(v is None for v in now.values()))
    return now, left


@pytest.mark.parametrize(("k", "rounds", "share"), [(1, 300, 0.9), (1, 2, 0.97), (2, 300, 0.96), (1, 300, 0.2)])
def test_rounds_equal_plain_rounds(spark, k, rounds, share):
    rng = np.random.default_rng(k + rounds)
    cells = {(r, c): None if rng.random() < share else float(rng.integers(0, 100)) for r in range(23) for c in range(19) if rng.random() < 0.97}
    df = spark.createDataFrame([(r, c, v, "kept") for (r, c), v in cells.items()], "row int, col int, v double, fill string")
    got, left = neighbourhood.fill(df, "v", rounds, k)
    expected, n = plain_fill(cells, rounds, k)
    assert left == n and got.columns == df.columns
    assert {(r.row, r.col): r.v for r in got.collect()} == {x: None if v is None else pytest.approx(v) for x, v in expected.items()}
    assert {r.fill for r in got.collect()} == {"kept"}


def test_a_round_writes_filled_cells_only(spark):
    """A raster of 40,000 cells with six nulls in a row and one apart: seven cells are written, not the raster."""
    df = spark.range(40_000).selectExpr("CAST(id DIV 200 AS INT) AS row", "CAST(id % 200 AS INT) AS col", "IF(id BETWEEN 4020 AND 4025 OR id = 99, NULL, id * 1.0D) AS v")
    with work_scope(spark) as written:
        filled, left = neighbourhood.fill(df, "v")
        rows = [spark.read.parquet(path).count() for path in written]
        assert left == [7, 0] and sum(rows) <= 14 and filled.where("v IS NULL").count() == 0


def test_distance_of_wide_rows_is_linear():
    """11,500 columns with one source, with none in some rows, and with one in each column."""
    began = time.perf_counter()
    height = np.full((8, 11_500), np.inf)
    height[:6, 77] = np.arange(6)
    found = row_minima(height, 10.0)
    assert np.array_equal(found[:6], (10.0 * (np.arange(11_500) - 77)) ** 2 + np.arange(6)[:, None]) and np.isinf(found[6:]).all()
    dense = np.random.default_rng(3).integers(0, 2_500, (8, 11_500)).astype(float) ** 2
    got = row_minima(dense, 10.0)
    x = np.arange(0, 11_500, 230)
    for row in range(8):
        assert np.allclose(got[row, x], (100.0 * (x[:, None] - np.arange(11_500)) ** 2 + dense[row]).min(axis=1))
    assert time.perf_counter() - began < 30


def test_distance_of_tall_columns_is_linear(spark):
    """60,000 rows: no frame reaches to the end of the column, as such a frame is walked anew for every row."""
    df = spark.range(60_000).selectExpr("CAST(id AS INT) AS row", "0 AS col", "IF(id IN (7, 50000), 1, NULL) AS v")
    found = distance(df, "v", 10.0, 5.0)
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    got = found.toPandas().sort_values("row")
    rows = np.arange(60_000)
    assert np.array_equal(got["row"], rows) and np.allclose(got["distance"], 5.0 * np.minimum(abs(rows - 7), abs(rows - 50_000)))


def test_more_nulls_than_few_are_never_broadcast(spark, monkeypatch):
    """Nulls in a compressed file look small to Spark, whatever their number; 2,000 rows stand for it, with 100 as few."""
    monkeypatch.setattr(neighbourhood, "FEW", 100)
    df = spark.range(40_000).selectExpr("CAST(id DIV 200 AS INT) AS row", "CAST(id % 200 AS INT) AS col", "IF(id % 200 BETWEEN 90 AND 99, NULL, id * 1.0D) AS v")
    held, plans = neighbourhood.work_table, []

    def watched(table, name):
        plans.append(table._jdf.queryExecution().executedPlan().toString())
        return held(table, name)

    monkeypatch.setattr(neighbourhood, "work_table", watched)
    filled, left = neighbourhood.fill(df, "v")
    assert left == [2_000, 1_600, 1_200, 800, 400, 0]
    plans.append(filled._jdf.queryExecution().executedPlan().toString())
    assert not any("Broadcast" in plan for plan in plans) and "SortMergeJoin" in plans[-1]
    assert filled.where("v IS NULL").count() == 0
