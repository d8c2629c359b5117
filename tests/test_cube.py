from __future__ import annotations

import numpy as np
import pytest

from pixelmill.functions.projection import ARRAYS, transformed
from pixelmill.operators import cube
from pixelmill.operators.composite import Season
from pixelmill.operators.grid import GridSpec
from pixelmill.sources.geotiff import write_geotiff
from pixelmill.sources.scenes import scene_grids, scene_pixels

TILES = {"T32TQQ": GridSpec(735_000.0, 4_990_000.0, 20.0, 20.0, 30, 24, 32632), "T33TUK": GridSpec(263_900.0, 4_990_000.0, 10.0, 10.0, 40, 40, 32633)}
TARGET = GridSpec(734_990.0, 4_990_015.0, 15.0, 15.0, 45, 37, 32632)
SCHEMA = "tile string, ts timestamp_ntz, row int, col int, scl int, b1 double, b2 double"


def made(seed: int = 1):
    import datetime

    rng, rows = np.random.default_rng(seed), []
    for tile, g in TILES.items():
        for day in (1, 1, 9):
            ts = datetime.datetime(2019, 4, day, 10, len(rows) % 60)
            for r in range(g.n_rows):
                for c in range(g.n_cols):
                    if rng.random() < 0.95:
                        rows.append((tile, ts, r, c, int(rng.integers(2, 9)), float(rng.random()) if rng.random() < 0.8 else None, float(r + c)))
    return rows


def brute(rows, merge_days: bool):
    """Cell by cell: four corners for the bands, the nearest pixel for the class."""
    scenes = {}
    for tile, ts, r, c, *values in rows:
        scenes.setdefault((tile, ts), {})[r, c] = values
    out = {}
    for row in range(TARGET.n_rows):
        for col in range(TARGET.n_cols):
            seen = []
            for (tile, ts), held in scenes.items():
                g = TILES[tile]
                x, y = transformed(np.array([TARGET.left + (col + 0.5) * TARGET.dx]), np.array([TARGET.top - (row + 0.5) * TARGET.dy]), TARGET.srid, g.srid, ARRAYS)
                x, y = float((x[0] - g.left) / g.dx - 0.5), float((g.top - y[0]) / g.dy - 0.5)
                if (near := held.get((int(np.floor(y + 0.5)), int(np.floor(x + 0.5))))) is None or near[0] not in (4, 5, 6):
                    continue
                found = []
                for b in (1, 2):
                    terms = []
                    for i in (0, 1):
                        for j in (0, 1):
                            corner = held.get((int(np.floor(y)) + j, int(np.floor(x)) + i))
                            if corner and corner[b] is not None:
                                terms.append((abs(1 - i - x % 1) * abs(1 - j - y % 1), corner[b]))
                    weight = sum(w for w, _ in terms)
                    found.append(sum(w * v for w, v in terms) / weight if weight else None)
                seen.append((ts.date() if merge_days else len(seen), found))
            cell = []
            for b in (0, 1):
                by_day = {}
                for day, found in seen:
                    if found[b] is not None:
                        by_day.setdefault(day, []).append(found[b])
                cell.append(float(np.median([np.mean(v) for v in by_day.values()])) if by_day else None)
            out[row, col] = cell
    return out


@pytest.mark.parametrize(("merge_days", "block"), [(False, 16), (True, 7), (False, 256)])
def test_cube_of_two_zones(spark, merge_days, block):
    rows = made()
    got = cube.seasonal_cube(spark.createDataFrame(rows, SCHEMA), TILES, TARGET, ["b1", "b2"], merge_days=merge_days, block=block).collect()
    expected = brute(rows, merge_days)
    assert len(got) == TARGET.n_rows * TARGET.n_cols and sum(v[0] is not None for v in expected.values()) > 500
    for r in got:
        for mine, theirs in zip((r.b1, r.b2), expected[r.row, r.col], strict=True):
            assert mine == (None if theirs is None else pytest.approx(theirs, abs=1e-6))


def test_cube_of_nothing_and_of_strange_tiles(spark):
    none = cube.seasonal_cube(spark.createDataFrame([], SCHEMA), TILES, TARGET, ["b1", "b2"])
    assert none.where("b1 IS NULL AND b2 IS NULL").count() == TARGET.n_rows * TARGET.n_cols
    row = made()[0]
    strange = [("T01AAA", *row[1:]), (None, *row[1:]), (row[0], row[1], 10_000, 0, 4, 1.0, 1.0)]
    assert cube.regridded(spark.createDataFrame(strange, SCHEMA), TILES, TARGET, ["b1", "b2"]).count() == 0
    late = cube.seasonal_cube(spark.createDataFrame(made(), SCHEMA), TILES, TARGET, ["b1", "b2"], Season("later", "2020-01-01", "2020-02-01"))
    assert late.where("b1 IS NOT NULL").count() == 0


def test_scenes_in_files(spark, tmp_path):
    rows = made()
    frame = spark.createDataFrame(rows, SCHEMA)
    for k, (tile, ts) in enumerate(sorted({r[:2] for r in rows})):
        scene = frame.where(f"tile = '{tile}' AND ts = TIMESTAMP_NTZ '{ts}'").selectExpr("row", "col", "CAST(scl AS DOUBLE) AS scl", "b1", "b2")
        write_geotiff(scene, str(tmp_path), TILES[tile], "float64", tile=16, block=32, scene=f"S2_{tile}_{ts:%Y%m%dT%H%M%S}_L2A")
    assert scene_grids(str(tmp_path)) == TILES
    back = scene_pixels(spark, str(tmp_path)).where("scl IS NOT NULL")
    assert {tuple(r) for r in back.collect()} == {(t, ts, r, c, float(s), b1, b2) for t, ts, r, c, s, b1, b2 in rows}
