from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelmill.operators.grid import GridSpec
from pixelmill.sources import geotiff, tiff
from pixelmill.sources.geotiff import geotiff_grid, read_geotiff, write_geotiff

GRID = GridSpec(500_000.0, 5_000_000.0, 10.0, 10.0, 150, 90)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_lzw_round_trip(data):
    assert tiff.lzw_decoded(tiff.lzw_encoded(data)) == data


def test_lzw_of_long_and_known_data():
    rng = random.Random(1)
    for data in (bytes(rng.choices(b"abcd", k=60_000)), rng.randbytes(60_000), b"\0" * 100_000, b""):
        assert tiff.lzw_decoded(tiff.lzw_encoded(data)) == data
    # by hand: clear, 7, 258 (7 7), 8, 8, 258, 6, end
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 257))
    known = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decoded(known) == bytes([7, 7, 7, 8, 8, 7, 7, 6])


@pytest.mark.parametrize("kind", list(geotiff.STORED))
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2, 3])
def test_tiles_round_trip(kind, compression, predictor):
    dtype = np.dtype(geotiff.STORED[kind])
    if predictor == 3 and dtype.kind != "f":
        return
    rng = np.random.default_rng(2)
    values = rng.normal(0, 60, (32, 16)).astype(dtype) if dtype.kind != "u" else rng.integers(0, 250, (32, 16)).astype(dtype)
    image = tiff.Image(32, 16, 32, 16, 1, dtype, compression, predictor, True)
    assert np.array_equal(tiff.decoded(image, tiff.encoded(values, compression, predictor))[..., 0], values)


def cells(spark, n_rows: int = 150, n_cols: int = 90):
    ids = spark.range(n_rows * n_cols)
    return ids.selectExpr(f"CAST(id DIV {n_cols} AS INT) AS row", f"CAST(id % {n_cols} AS INT) AS col", "IF(id % 7 = 0, NULL, id / 8) AS first", "CAST(id % 251 AS DOUBLE) AS second")


@pytest.mark.parametrize(("kind", "compression", "nodata"), [("float64", "deflate", None), ("float32", "lzw", -9999.0), ("int32", "lzw", -1.0)])
def test_raster_round_trip(spark, tmp_path, kind, compression, nodata):
    df = cells(spark).selectExpr("row", "col", "CAST(first AS INT) * 1.0D AS first", "second")
    path = f"{tmp_path}/r"
    write_geotiff(df, path, GRID, kind, compression, nodata=nodata, tile=16, block=64)
    names = sorted(p.name for p in (tmp_path / "r").iterdir())
    assert names == [f"r{r:06d}-c{c:06d}.tif" for r in range(3) for c in range(2)]  # nothing is left of the staging
    back = read_geotiff(spark, path)
    assert back.columns == ["row", "col", "first", "second"] and geotiff_grid(path) == GRID
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_layers_windows_and_filters(spark, tmp_path):
    df, path = cells(spark), f"file://{tmp_path}/r"
    write_geotiff(df, path, GRID, "float64", tile=16, block=64)
    assert read_geotiff(spark, path, bands=[2]).columns == ["row", "col", "second"]
    swapped = read_geotiff(spark, path, bands=[2, 1])
    assert swapped.columns == ["row", "col", "second", "first"] and swapped.where("row = 3 AND col = 4").first()[2:] == (df.where("row = 3 AND col = 4").first().second, df.where("row = 3 AND col = 4").first().first)
    part = read_geotiff(spark, path, ["first"], window=(60, 70, 10, 20))
    assert sorted(map(tuple, part.collect()), key=str) == sorted(map(tuple, df.where("row BETWEEN 60 AND 70 AND col BETWEEN 10 AND 20").drop("second").collect()), key=str)
    reader = geotiff.GeoTiffReader({"path": path, "bytes": "1"}, part.schema)
    assert len(reader.partitions()) == 60  # tiles of 16 cells in 150 x 90
    narrow = geotiff.GeoTiffReader({"path": path, "window": "60,70,10,20", "bytes": "1"}, part.schema)
    assert len(narrow.partitions()) == 4
    pushed = geotiff.GeoTiffReader({"path": path, "bytes": "1"}, part.schema)
    assert len(list(pushed.pushFilters([geotiff.LessThan(("row",), 20), geotiff.EqualTo(("col",), 5)]))) == 2 and len(pushed.partitions()) == 2
    assert read_geotiff(spark, path).where("row < 20 AND col = 5").count() == 20
    for wrong in ({"bands": [3]}, {"layers": ["none"]}):
        with pytest.raises(Exception, match="bands run|no layer"):
            read_geotiff(spark, path, **wrong).count()


def test_wrong_cells_leave_nothing(spark, tmp_path):
    path = f"{tmp_path}/r"
    for df, kind in ((cells(spark, 151), "float32"), (cells(spark), "int16"), (cells(spark).fillna(0).selectExpr("row", "col", "second * 1000 AS v"), "int16")):
        with pytest.raises(Exception, match="outside the grid|nodata value|does not fit"):
            write_geotiff(df, path, GRID, kind, tile=16, block=64)
        assert not (tmp_path / "r").exists() or not list((tmp_path / "r").iterdir())
    write_geotiff(cells(spark), path, GRID, tile=16, block=64)
    with pytest.raises(FileExistsError):
        write_geotiff(cells(spark), path, GRID, overwrite=False)
    write_geotiff(cells(spark).where("row < 10"), path, GRID, tile=16, block=64)  # replaces the blocks of before
    assert len(list((tmp_path / "r").iterdir())) == 2


def foreign(big: bool, order: str, values: np.ndarray, rows_per_strip: int, predictor: int) -> bytes:
    """A stripped, chunky file in either byte order, classic or big, as other writers make it."""
    h, w, n = values.shape
    strips = []
    for r in range(0, h, rows_per_strip):
        part = values[r : r + rows_per_strip].astype(values.dtype.newbyteorder(order))
        if predictor == 2:
            part = np.diff(part.astype(values.dtype), axis=1, prepend=np.zeros((len(part), 1, n), values.dtype)).astype(values.dtype.newbyteorder(order))
        strips.append(zlib.compress(part.tobytes()))
    head = 16 if big else 8
    offsets = [head + sum(map(len, strips[:i])) for i in range(len(strips))]
    at = head + sum(map(len, strips))
    tags = [(256, 3, [w]), (257, 3, [h]), (258, 3, [16] * n), (259, 3, [8]), (262, 3, [1]), (273, 4, offsets), (277, 3, [n]), (278, 3, [rows_per_strip]), (279, 4, [len(s) for s in strips]), (284, 3, [1]), (317, 3, [predictor]), (339, 3, [1] * n)]
    inline, word = (8, "Q") if big else (4, "I")
    size = (8 if big else 2) + len(tags) * (20 if big else 12) + inline
    entries, rest = b"", b""
    for tag, kind, numbers in tags:
        held = struct.pack(f"{order}{len(numbers)}{'H' if kind == 3 else 'I'}", *numbers)
        entries += struct.pack(f"{order}HH{word}", tag, kind, len(numbers))
        if len(held) > inline:
            entries += struct.pack(f"{order}{word}", at + size + len(rest))
            rest += held
        else:
            entries += held.ljust(inline, b"\0")
    mark = b"II" if order == "<" else b"MM"
    start = mark + (struct.pack(f"{order}HHHQ", 43, 8, 0, at) if big else struct.pack(f"{order}HI", 42, at))
    return start + b"".join(strips) + struct.pack(f"{order}{'Q' if big else 'H'}", len(tags)) + entries + b"\0" * inline + rest


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize(("order", "predictor"), [("<", 1), (">", 2)])
def test_files_of_other_writers(spark, tmp_path, big, order, predictor):
    values = np.arange(21 * 13 * 3, dtype="u2").reshape(21, 13, 3) * 7
    (tmp_path / "a.tif").write_bytes(foreign(big, order, values, 5, predictor))
    got = {(r.row, r.col): (r.b3, r.b1) for r in read_geotiff(spark, f"{tmp_path}/a.tif", bands=[3, 1]).collect()}
    assert got == {(r, c): (int(values[r, c, 2]), int(values[r, c, 0])) for r in range(21) for c in range(13)}


def test_no_raster(spark, tmp_path):
    (tmp_path / "x.tif").write_bytes(b"no raster at all")
    with pytest.raises(Exception, match="not a TIFF"):
        read_geotiff(spark, f"{tmp_path}/x.tif")
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception, match="no GeoTIFF"):
        read_geotiff(spark, f"{tmp_path}/empty")
