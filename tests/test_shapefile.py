from __future__ import annotations

import json
import struct

import pytest

from pixelmill.sources import shapefile as ranges
from pixelmill.sources import vectors
from tests.test_operators import dbf, shapefile


def stored(folder, n: int, index: bool = True, ending: str = "shp"):
    """Points with a growing text; every seventh record is empty."""
    bodies = [struct.pack("<i", 0) if k % 7 == 3 else struct.pack("<i2d", 1, float(k), float(-k)) for k in range(n)]
    main = shapefile(1, bodies)
    (folder / f"wells.{ending}").write_bytes(main)
    if index:
        places, at = b"", 50
        for b in bodies:
            places += struct.pack(">2i", at, len(b) // 2)
            at += len(b) // 2 + 4
        (folder / "wells.shx").write_bytes(main[:100] + places)
    (folder / "wells.dbf").write_bytes(dbf([("N", "N", 6, 0), ("NAME", "C", 9, 0)], [(k, f"Pò {k}") for k in range(n)]))
    (folder / "wells.cpg").write_text("UTF-8")


@pytest.mark.parametrize("task_bytes", [400, 1 << 20])
def test_one_file_many_tasks(spark, tmp_path, task_bytes):
    stored(tmp_path, 100)
    parts = ranges.ShapefileReader({"path": str(tmp_path), "bytes": str(task_bytes)}).partitions()
    assert len(parts) == (1 if task_bytes > 400 else len(range(0, 100, parts[0].last))) and (task_bytes > 400 or len(parts) > 5)
    got = ranges.read_shapefile(spark, str(tmp_path), task_bytes)
    assert got.rdd.getNumPartitions() == len(parts)
    rows = {r.fid: r for r in got.collect()}
    assert sorted(rows) == list(range(1, 101)) and {r.layer for r in rows.values()} == {"wells"}
    for k in range(100):
        assert rows[k + 1].geom == (None if k % 7 == 3 else struct.pack("<BI2d", 1, 1, float(k), float(-k)))
        assert json.loads(rows[k + 1].attributes) == {"N": k, "NAME": f"Pò {k}"}
    whole = {r.fid: (r.geom, r.attributes) for r in vectors.read_small_shapefiles(spark, str(tmp_path)).collect()}
    assert whole == {f: (r.geom, r.attributes) for f, r in rows.items()}


def test_without_index_or_table_and_no_files(spark, tmp_path):
    stored(tmp_path, 9, index=False, ending="SHP")
    rows = ranges.read_shapefile(spark, str(tmp_path), 10).collect()
    assert len(rows) == 9 and json.loads(rows[8].attributes)["N"] == 8
    (tmp_path / "wells.dbf").unlink()
    assert {r.attributes for r in ranges.read_shapefile(spark, str(tmp_path)).collect()} == {"{}"}
    (tmp_path / "none").mkdir()
    assert ranges.read_shapefile(spark, f"file://{tmp_path}/none").count() == 0
    (tmp_path / "empty").mkdir()
    stored(tmp_path / "empty", 0)
    assert ranges.read_shapefile(spark, str(tmp_path / "empty")).count() == 0
