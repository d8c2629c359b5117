"""GeoTIFF rasters as a Spark data source: tiles are read in parallel, blocks are written by the tasks and committed."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, EqualTo, WriterCommitMessage
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from pixelmill.operators.grid import GridSpec
from pixelmill.session import ship_package
from pixelmill.sources import tiff
from pixelmill.sources.files import path_exists
from pixelmill.sources.tiff import Image

FORMAT = "pixelmill_geotiff"
#: Compressed bytes that a task reads, about.
TASK_BYTES = 8 << 20
#: What ends the name of a file: its block in a raster of several files.
BLOCK_NAME = re.compile(r"(-?r\d{6}-c\d{6})?\.tiff?$", re.I)
#: Types of storage by name.
STORED = {"byte": "u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "float32": "<f4", "float64": "<f8"}


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, Image]]:
    """All files of a raster, which is one file or a folder of them, with their directories."""
    system, inner = located(path)
    if system.get_file_info(inner).type == fs.FileType.Directory:
        names = sorted(f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.path.lower().endswith((".tif", ".tiff")))
    else:
        names = [inner]
    if not names:
        raise FileNotFoundError(f"no GeoTIFF in {path}")

    def one(name: str) -> tuple[str, Image]:
        with system.open_input_file(name) as file:
            return name, tiff.directory(file)

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(one, names))


def scene_of(path: str) -> str:
    """The name of the scene that a file holds, or holds a block of."""
    return BLOCK_NAME.sub("", path.rsplit("/", 1)[-1])


def by_scene(files: list[tuple[str, Image]]) -> dict[str, list[tuple[str, Image]]]:
    found: dict[str, list[tuple[str, Image]]] = {}
    for path, image in files:
        found.setdefault(scene_of(path), []).append((path, image))
    return found


def grid_of(images: Sequence[Image]) -> GridSpec:
    """The grid that holds all files; they must share cell size and reference system."""
    first = images[0]
    if any((i.dx, i.dy, i.srid) != (first.dx, first.dy, first.srid) for i in images):
        raise ValueError("the files have different cells or reference systems")
    left, top = min(i.left for i in images), max(i.top for i in images)
    rows = max(round((top - i.top) / i.dy) + i.n_rows for i in images)
    cols = max(round((i.left - left) / i.dx) + i.n_cols for i in images)
    return GridSpec(left, top, first.dx, first.dy, rows, cols, first.srid)


def picked(image: Image, options: dict) -> list[int]:
    """The wanted layers as places from 0: by position (``bands``, from 1), by name (``layers``), or all."""
    if bands := options.get("bands"):
        places = [int(b) - 1 for b in bands.split(",")]
    elif layers := options.get("layers"):
        if missing := [n for n in layers.split(",") if n not in image.names]:
            raise ValueError(f"no layer {', '.join(missing)}")
        places = [image.names.index(n) for n in layers.split(",")]
    else:
        places = list(range(image.layers))
    if any(not 0 <= p < image.layers for p in places):
        raise ValueError(f"bands run from 1 to {image.layers}")
    return places


def column_type(dtype: np.dtype):
    if dtype.kind == "f":
        return FloatType() if dtype.itemsize == 4 else DoubleType()
    return IntegerType() if dtype.itemsize < 4 or (dtype.kind == "i" and dtype.itemsize == 4) else LongType()


@dataclass
class TileRange(InputPartition):
    """Tiles of one file, where they lie in it, and where the file lies in the whole raster."""

    path: str
    image: Image
    tiles: list[int]
    pieces: list[list[tuple[int, int]]]  # per tile: offset and bytes of each wanted plane
    row: int
    col: int
    file: str | None = None


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = dict(options), schema.names
        window = options.get("window")
        self.window = [int(x) for x in window.split(",")] if window else [0, 1 << 31, 0, 1 << 31]

    def pushFilters(self, filters) -> Iterator:
        """Bounds on row and col leave out tiles; Spark checks every filter again."""
        for f in filters:
            axis = {("row",): 0, ("col",): 2}.get(getattr(f, "attribute", None))
            if axis is not None:
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.window[axis] = max(self.window[axis], f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.window[axis + 1] = min(self.window[axis + 1], f.value)
            yield f

    def partitions(self) -> list[TileRange]:
        files = listed(self.options["path"])
        each = self.options.get("each") == "true"
        scenes = by_scene(files) if each else {"": files}
        grids = {scene: grid_of([image for _, image in held]) for scene, held in scenes.items()}
        first_row, last_row, first_col, last_col = self.window
        most, found = int(self.options.get("bytes", TASK_BYTES)), []
        for scene, path, image in ((scene, *x) for scene, held in scenes.items() for x in held):
            grid, file = grids[scene], scene if each else None
            row, col = round((grid.top - image.top) / image.dy), round((image.left - grid.left) / image.dx)
            planes = picked(image, self.options) if image.planar else [0]
            plane = image.tiles_across * image.tiles_down
            bare, tiles, pieces, held = replace(image, offsets=[], sizes=[]), [], [], 0
            for tile in range(plane):
                top, left = row + tile // image.tiles_across * image.tile_rows, col + tile % image.tiles_across * image.tile_cols
                if top > last_row or top + image.tile_rows <= first_row or left > last_col or left + image.tile_cols <= first_col:
                    continue
                tiles.append(tile)
                pieces.append([(image.offsets[p * plane + tile], image.sizes[p * plane + tile]) for p in planes])
                held += sum(size for _, size in pieces[-1])
                if held >= most:
                    found.append(TileRange(path, bare, tiles, pieces, row, col, file))
                    tiles, pieces, held = [], [], 0
            if tiles:
                found.append(TileRange(path, bare, tiles, pieces, row, col, file))
        return found or [TileRange("", files[0][1], [], [], 0, 0)]

    def read(self, part: TileRange) -> Iterator[pa.RecordBatch]:
        if not part.tiles:
            return
        image, (system, _) = part.image, located(self.options["path"])
        wanted = picked(image, self.options)
        first_row, last_row, first_col, last_col = self.window
        with system.open_input_file(part.path) as file:
            for tile, pieces in zip(part.tiles, part.pieces, strict=True):
                top, left = tile // image.tiles_across * image.tile_rows, tile % image.tiles_across * image.tile_cols
                shape = min(image.tile_rows, image.n_rows - top), min(image.tile_cols, image.n_cols - left)
                row, col = (np.arange(n, dtype=np.int32) + at for n, at in zip(shape, (part.row + top, part.col + left), strict=True))
                rows, cols = (row >= first_row) & (row <= last_row), (col >= first_col) & (col <= last_col)
                planes = []
                for offset, size in pieces:
                    if size:
                        planes.append(tiff.decoded(image, file.read_at(size, offset))[: shape[0], : shape[1]][rows][:, cols])
                    else:  # a tile that was never written
                        planes.append(np.full((rows.sum(), cols.sum(), 1 if image.planar else image.layers), image.nodata or 0, image.dtype))
                layers = [p[..., 0] for p in planes] if image.planar else [planes[0][..., b] for b in wanted]
                columns = [pa.array(np.repeat(row[rows], cols.sum())), pa.array(np.tile(col[cols], rows.sum()))]
                for values in layers:
                    flat = np.ascontiguousarray(values, values.dtype.newbyteorder("=")).ravel()
                    absent = np.isnan(flat) if flat.dtype.kind == "f" else np.zeros(len(flat), bool)
                    if image.nodata is not None:
                        absent |= flat == image.nodata
                    columns.append(pa.array(flat, mask=absent).cast({"f": {4: pa.float32(), 8: pa.float64()}}.get(flat.dtype.kind, {}).get(flat.dtype.itemsize) or (pa.int32() if isinstance(column_type(flat.dtype), IntegerType) else pa.int64())))
                if part.file is not None:
                    columns.insert(0, pa.array([part.file] * len(columns[0])))
                yield pa.RecordBatch.from_arrays(columns, names=self.names)


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a task has put a file, and its name


class GeoTiffWriter(DataSourceArrowWriter):
    """Each task writes one file for each block of cells it gets, under a name of its own in a staging folder; the
    commit moves the files of the attempts that count, so failed and speculative attempts leave nothing."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.options, self.overwrite, self.job = dict(options), overwrite, uuid.uuid4().hex
        self.layers = [n for n in schema.names if n not in ("row", "col")]

    def _blank(self, rows: int, cols: int) -> dict[str, np.ndarray]:
        return {n: np.full((rows, cols), self.nodata, self.dtype) for n in self.layers}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        o = self.options
        left, top, dx, dy = (float(o[k]) for k in ("left", "top", "dx", "dy"))
        n_rows, n_cols, srid, tile, block = (int(o[k]) for k in ("rows", "cols", "srid", "tile", "block"))
        self.dtype, compression = np.dtype(STORED[o["type"]]), tiff.COMPRESSIONS[o["compression"]]
        self.nodata = float(o["nodata"]) if "nodata" in o else (np.nan if self.dtype.kind == "f" else 0)
        predictor = (3 if self.dtype.kind == "f" else 2) if o["predictor"] == "true" and compression != tiff.NONE else 1
        system, folder = located(o["path"])
        staging = f"{folder}/_staging-{self.job}"
        system.create_dir(staging)
        done: dict[str, str] = {}

        def flush(at: tuple[int, int], values: dict[str, np.ndarray]) -> None:
            height, width = next(iter(values.values())).shape
            image = Image(height, width, tile, tile, len(self.layers), self.dtype, compression, predictor, True, left + at[1] * block * dx, top - at[0] * block * dy, dx, dy, srid, float(o["nodata"]) if "nodata" in o else None, self.layers)
            tiles = []
            for n in self.layers:
                for r in range(0, height, tile):
                    for c in range(0, width, tile):
                        part = values[n][r : r + tile, c : c + tile]
                        padded = np.full((tile, tile), self.nodata, self.dtype)
                        padded[: part.shape[0], : part.shape[1]] = part
                        tiles.append(tiff.encoded(padded, compression, predictor))
            name = f"{o['prefix']}r{at[0]:06d}-c{at[1]:06d}.tif"
            if name in done:
                raise ValueError("cells must come block by block")
            done[name] = f"{staging}/{uuid.uuid4().hex}.tif"
            with system.open_output_stream(done[name]) as out:
                out.write(tiff.written(image, tiles))

        now, values = None, {}
        for batch in iterator:
            row, col = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("row", "col"))
            if len(row) and (row.min() < 0 or row.max() >= n_rows or col.min() < 0 or col.max() >= n_cols):
                raise ValueError("a cell outside the grid")
            held = {}
            for n in self.layers:
                column = batch.column(batch.schema.get_field_index(n))
                value = column.to_numpy(zero_copy_only=False)
                absent = column.is_null().to_numpy(zero_copy_only=False)
                if absent.any():
                    if self.dtype.kind != "f" and "nodata" not in o:
                        raise ValueError(f"{n} has nulls; name a nodata value")
                    value = np.where(absent, self.nodata, value)
                if self.dtype.kind != "f" and len(value) and not (np.iinfo(self.dtype).min <= value.min() and value.max() <= np.iinfo(self.dtype).max):
                    raise ValueError(f"{n} does not fit {o['type']}")
                held[n] = value
            key = (row // block) << 32 | col // block
            cuts = np.flatnonzero(np.diff(key)) + 1
            for part in np.split(np.arange(len(row)), cuts) if len(row) else []:
                at = int(row[part[0]] // block), int(col[part[0]] // block)
                if at != now:
                    if now is not None:
                        flush(now, values)
                    now, values = at, self._blank(min(block, n_rows - at[0] * block), min(block, n_cols - at[1] * block))
                for n in self.layers:
                    values[n][row[part] - at[0] * block, col[part] - at[1] * block] = held[n][part]
        if now is not None:
            flush(now, values)
        return Staged([(place, name) for name, place in done.items()])

    def commit(self, messages: list[Staged | None]) -> None:
        system, folder = located(self.options["path"])
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(folder)):
                if scene_of(old.path) == self.options["prefix"].rstrip("-") and old.path.endswith(".tif"):
                    system.delete_file(old.path)
        for message in messages:
            for place, name in message.files if message else []:
                system.move(place, f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        system, folder = located(self.options["path"])
        staging = f"{folder}/_staging-{self.job}"
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class GeoTiffSource(DataSource):
    """``spark.read.format("pixelmill_geotiff")``: row, col and a column per layer of a file or a folder of files.

    Options: path; bands (positions from 1) or layers (names); window (first row, last row, first column, last column);
    bytes, the compressed bytes of a task; each (true: a folder of scenes, not of one raster; rows and columns count inside each, whose name is the column ``file``). Tiled and stripped files, plain, LZW and DEFLATE, with predictors, both byte
    orders, also BigTIFF. NaN and the file's nodata value are null.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        _, image = listed(self.options["path"])[0]
        cells = [StructField(n, IntegerType()) for n in ("row", "col")]
        if self.options.get("each") == "true":
            cells.insert(0, StructField("file", StringType()))
        return StructType([*cells, *[StructField(image.names[b], column_type(image.dtype)) for b in picked(image, self.options)]])

    def reader(self, schema: StructType) -> GeoTiffReader:
        return GeoTiffReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> GeoTiffWriter:
        return GeoTiffWriter(self.options, schema, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiffSource)
    return spark


def read_geotiff(spark: SparkSession, path: str, layers: Sequence[str] | None = None, bands: Sequence[int] | None = None, window: tuple[int, int, int, int] | None = None, each: bool = False) -> DataFrame:
    """Pixels of a GeoTIFF, or of a folder of them (S4); ``bands`` picks layers by position from 1.

    Only the tiles of ``window`` (first and last row, first and last column), or those that filters on row and col
    leave, are read, and of files with separate planes only the wanted ones.
    """
    reader = registered(spark).read.format(FORMAT)
    for name, value in (("layers", layers), ("bands", bands), ("window", window)):
        if value is not None:
            reader = reader.option(name, ",".join(map(str, value)))
    return reader.option("each", str(each).lower()).load(path)


def geotiff_grid(path: str) -> GridSpec:
    """The grid of a raster on disk; only the directories of its files are read."""
    return grid_of([image for _, image in listed(path)])


def write_geotiff(
    df: DataFrame,
    path: str,
    grid: GridSpec,
    kind: str = "float32",
    compression: str = "deflate",
    predictor: bool = True,
    nodata: float | None = None,
    tile: int = 256,
    block: int = 1024,
    overwrite: bool = True,
    scene: str | None = None,
) -> None:
    """Write row, col and layers as a folder of tiled GeoTIFFs, one for each block of ``block`` cells square.

    One shuffle brings the cells of a block together; a task holds one block of all layers. ``kind`` is the storage type
    of all layers, ``compression`` none, lzw or deflate. Absent and null cells are ``nodata``, in whole-number rasters
    without one an error (null) or 0 (absent). Without ``overwrite`` a raster that is there is never touched (S21).
    ``scene`` names one of several rasters in the folder; only that one is replaced.
    """
    if block % tile or tile % 16:
        raise ValueError("a block holds whole tiles, a tile a multiple of 16 cells")
    if kind not in STORED or compression not in tiff.COMPRESSIONS:
        raise ValueError(f"unknown storage: {kind}, {compression}")
    spark = registered(df.sparkSession)
    if not overwrite and path_exists(spark, path):
        raise FileExistsError(path)
    options = {"left": grid.left, "top": grid.top, "dx": grid.dx, "dy": grid.dy, "rows": grid.n_rows, "cols": grid.n_cols, "srid": grid.srid, "tile": tile, "block": block, "prefix": f"{scene}-" if scene else ""}
    options |= {"type": kind, "compression": compression, "predictor": str(predictor).lower()} | ({} if nodata is None else {"nodata": nodata})
    at = [F.expr(f"row DIV {block}"), F.expr(f"col DIV {block}")]
    writer = df.repartition(*at).sortWithinPartitions(*at).write.format(FORMAT).mode("overwrite")
    writer.options(**{k: str(v) for k, v in options.items()}).save(path)
