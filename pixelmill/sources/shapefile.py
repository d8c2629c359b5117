"""Shapefiles as a Spark data source: one file is read by many tasks, each a range of its records."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from pixelmill.session import ship_package
from pixelmill.sources.geotiff import located
from pixelmill.sources.vectors import dbase_rows, known_encoding, shape, shapes

FORMAT = "pixelmill_shapefile"
SCHEMA = "file string, layer string, fid long, geom binary, attributes string"
#: Bytes of the main file that a task reads, about; and records handed on at once.
TASK_BYTES, BATCH = 16 << 20, 4096


@dataclass
class RecordRange(InputPartition):
    """Records ``first`` to ``last`` (exclusive) of one shapefile; without an index all of them."""

    main: str
    index: str | None
    table: str | None
    encoding: str | None
    first: int
    last: int


class ShapefileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[RecordRange]:
        """The index says where each record lies, so its size alone tells how many there are and where to cut."""
        system, folder = located(self.options["path"])
        held = {f.path.lower(): f for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File}
        most, found = int(self.options.get("bytes", TASK_BYTES)), []
        for name, main in sorted(held.items()):
            if not name.endswith(".shp"):
                continue
            index, table, encoding = (held.get(name[:-3] + ending) for ending in ("shx", "dbf", "cpg"))
            paths = [f and f.path for f in (main, index, table, encoding)]
            if index is None:
                found.append(RecordRange(*paths, 0, 0))
                continue
            n = (index.size - 100) // 8
            step = max(1, n // max(1, -(-main.size // most)))
            found += [RecordRange(*paths, first, min(first + step, n)) for first in range(0, n, step)]
        return found or [RecordRange("", None, None, None, 0, 0)]

    def read(self, part: RecordRange) -> Iterator[pa.RecordBatch]:
        if not part.main:
            return
        system, _ = located(self.options["path"])
        base = part.main[:-4]
        first, geometries = part.first, self._geometries(system, part)
        attributes = self._attributes(system, part)
        while True:
            geoms = [g for _, g in zip(range(BATCH), geometries, strict=False)]
            if not geoms:
                return
            rows = [json.dumps(next(attributes, {})) for _ in geoms]
            columns = [[base] * len(geoms), [base.rsplit("/", 1)[-1]] * len(geoms), [first + k + 1 for k in range(len(geoms))], geoms, rows]
            first += len(geoms)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["file", "layer", "fid", "geom", "attributes"])

    def _geometries(self, system: fs.FileSystem, part: RecordRange) -> Iterator[bytes | None]:
        if part.index is None:
            with system.open_input_file(part.main) as file:
                yield from shapes(file.read())
            return
        with system.open_input_file(part.index) as file:
            places = np.frombuffer(file.read_at(8 * (part.last - part.first), 100 + 8 * part.first), ">i4").reshape(-1, 2).astype(np.int64) * 2
        with system.open_input_file(part.main) as file:
            for at in range(0, len(places), BATCH):
                some = places[at : at + BATCH]
                begin, end = int(some[:, 0].min()), int(some.sum(axis=1).max()) + 8
                tight = end - begin <= 2 * (int(some[:, 1].sum()) + 8 * len(some))  # records that lie together are read at once
                whole = file.read_at(end - begin, begin) if tight else b""
                for offset, size in some.tolist():
                    record = whole[offset - begin + 8 : offset - begin + 8 + size] if tight else file.read_at(size, offset + 8)
                    kind = struct.unpack_from("<i", record)[0] % 10 if len(record) >= 4 else 0
                    yield shape(record, kind) if kind else None

    def _attributes(self, system: fs.FileSystem, part: RecordRange) -> Iterator[dict[str, object]]:
        if part.table is None:
            return
        text = None
        if part.encoding is not None:
            with system.open_input_file(part.encoding) as file:
                text = file.read()
        with system.open_input_file(part.table) as file:
            n, begin, size = struct.unpack_from("<IHH", file.read_at(32, 0), 4)
            head = file.read_at(begin, 0)
            last = n if part.index is None else min(part.last, n)
            for at in range(part.first, last, BATCH):
                many = min(BATCH, last - at)
                yield from dbase_rows(head, file.read_at(many * size, begin + at * size), many, known_encoding(text))


class ShapefileSource(DataSource):
    """``spark.read.format("pixelmill_shapefile")``: all shapefiles of a folder. Options: path; bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ShapefileReader:
        return ShapefileReader(self.options)


def read_shapefile(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """file, layer, fid, geom (WKB), attributes (JSON) of all shapefiles in a folder.

    A file with an index (.shx) is cut into ranges of records of about ``task_bytes``, read by as many tasks: index,
    geometries and attribute table by place. Without an index one task reads it. Without a table attributes are {}.
    """
    ship_package(spark)
    spark.dataSource.register(ShapefileSource)
    return spark.read.format(FORMAT).option("bytes", str(task_bytes)).load(path)
