"""Vector layers: GeoPackage files and shapefiles read inside tasks, geometries as WKB and as rings."""

from __future__ import annotations

import codecs
import json
import sqlite3
import struct
import uuid
from collections.abc import Iterator, Mapping

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.operators.spatial import RINGS
from pixelmill.session import ship_package

#: Bytes of a GeoPackage envelope by its indicator.
ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def features(content: bytes) -> Iterator[tuple[str, int, bytes | None, str]]:
    """layer, feature number, WKB and attributes (JSON) of every feature of a GeoPackage."""
    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    for layer, column in db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall():
        rows = db.execute(f'SELECT * FROM "{layer}"')
        names = [d[0] for d in rows.description]
        for number, row in enumerate(rows, 1):
            blob = row[names.index(column)]
            attributes = {n: v for n, v in zip(names, row, strict=True) if n != column and not isinstance(v, bytes)}
            wkb = None if blob is None else bytes(blob[8 + ENVELOPE[blob[3] >> 1 & 7] :])
            yield layer, number, wkb, json.dumps(attributes)
    db.close()


def read_geopackage(spark: SparkSession, path: str) -> DataFrame:
    """file, layer, fid, geom (WKB), attributes (JSON): one task per file."""
    ship_package(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(file, *f) for f in features(bytes(content))], columns=["file", "layer", "fid", "geom", "attributes"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, layer string, fid long, geom binary, attributes string")


def parse_wkb(wkb: bytes) -> list[list[tuple[float, float]]]:
    """Rings of a polygon or multipolygon, points of a line as one ring; other kinds have none."""
    rings: list[list[tuple[float, float]]] = []

    def geometry(at: int) -> int:
        order = "<" if wkb[at] else ">"
        kind = struct.unpack_from(f"{order}I", wkb, at + 1)[0]
        at += 5 + (4 if kind & 0x20000000 else 0)
        size = 2 + (1 if kind & 0x80000000 or kind % 10000 // 1000 in (1, 3) else 0) + (1 if kind & 0x40000000 or kind % 10000 // 1000 in (2, 3) else 0)
        kind = (kind & 0xFFFF) % 1000

        def points(at: int) -> int:
            n = struct.unpack_from(f"{order}I", wkb, at)[0]
            flat = struct.unpack_from(f"{order}{n * size}d", wkb, at + 4)
            rings.append([(flat[i], flat[i + 1]) for i in range(0, n * size, size)])
            return at + 4 + 8 * n * size

        if kind == 1:
            return at + 8 * size
        if kind == 2:
            return points(at)
        n = struct.unpack_from(f"{order}I", wkb, at)[0]
        at += 4
        for _ in range(n):
            at = points(at) if kind == 3 else geometry(at)
        return at

    geometry(0)
    return rings


def with_rings(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Adds ``rings``; a null or unreadable geometry has none."""
    ship_package(df.sparkSession)

    @F.pandas_udf(RINGS)
    def rings(values: pd.Series) -> pd.Series:
        def one(wkb: bytes | None) -> list[list[dict[str, float]]]:
            try:
                return [[{"x": x, "y": y} for x, y in ring] for ring in parse_wkb(bytes(wkb))] if wkb is not None else []
            except (struct.error, IndexError):
                return []

        return values.map(one)

    return df.withColumn("rings", rings(geom))


def polygon_wkb(rings: str) -> Column:
    """WKB of a polygon given as rings; null without any."""

    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        def one(polygon) -> bytes | None:
            if polygon is None or not len(polygon):
                return None
            body = (struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", p["x"], p["y"]) for p in r) for r in polygon)
            return struct.pack("<BII", 1, 3, len(polygon)) + b"".join(body)

        return values.map(one)

    return packed(rings)


def write_vectors(df: DataFrame, path: str) -> None:
    """A layer with its WKB column."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def geopackage(rows: pd.DataFrame, types: Mapping[str, str], layer: str, geom: str, srid: int) -> bytes:
    """The bytes of a GeoPackage of one layer."""
    db = sqlite3.connect(":memory:")
    named = ", ".join(f'"{c}" {"BLOB" if c == geom else t}' for c, t in types.items())
    db.executescript(
        f"""PRAGMA application_id = {0x47504B47}; PRAGMA user_version = 10300;
        CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
        INSERT INTO gpkg_spatial_ref_sys VALUES ('EPSG:{srid}', {srid}, 'EPSG', {srid}, 'undefined', NULL);
        CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT, description TEXT, last_change TEXT, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
        INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES ('{layer}', 'features', '{layer}', {srid});
        CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT);
        INSERT INTO gpkg_geometry_columns VALUES ('{layer}', '{geom}', 'GEOMETRY', {srid}, 0, 0);
        CREATE TABLE "{layer}" (gpkg_fid INTEGER PRIMARY KEY AUTOINCREMENT, {named});"""
    )
    header = b"GP\x00\x01" + struct.pack("<i", srid)
    plain = rows[list(types)].astype(object).where(rows[list(types)].notna(), None)
    marks = ", ".join("?" * len(types))
    listed = ", ".join(f'"{c}"' for c in types)
    values = ([None if v is None else header + bytes(v) if c == geom else v for c, v in zip(types, row, strict=True)] for row in plain.itertuples(index=False))
    db.executemany(f'INSERT INTO "{layer}" ({listed}) VALUES ({marks})', values)
    db.commit()
    content = db.serialize()
    db.close()
    return content


def write_geopackage(df: DataFrame, path: str, layer: str, geom: str = "geom", srid: int = 32632) -> int:
    """One GeoPackage file per partition in a new folder, written by the tasks themselves (S10); returns the features.

    A repeated task writes its file again, under the same name.
    """
    spark = df.sparkSession
    ship_package(spark)
    kinds = {"double": "REAL", "float": "REAL", "int": "INTEGER", "bigint": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER"}
    types = {c: kinds.get(t, "TEXT") for c, t in df.dtypes}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            rows = pd.concat(parts)
            store, folder = FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
            store.create_dir(folder, recursive=True)
            attempt = f"{folder}/_attempt-{uuid.uuid4().hex}"  # a failed or speculative attempt leaves no half file
            with store.open_output_stream(attempt) as out:
                out.write(geopackage(rows, types, layer, geom, srid))
            store.move(attempt, f"{folder}/part-{TaskContext.get().partitionId():05d}.gpkg")
            yield pd.DataFrame({"n": [len(rows)]})

    return df.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def shapes(content: bytes) -> Iterator[bytes | None]:
    """WKB of every record of the main file of a shapefile: points, lines and polygons, by x and y."""
    at = 100
    while at + 12 <= len(content):
        size = struct.unpack_from(">i", content, at + 4)[0] * 2
        kind = struct.unpack_from("<i", content, at + 8)[0] % 10
        yield shape(content[at + 8 : at + 8 + size], kind) if kind else None
        at += 8 + size


def shape(record: bytes, kind: int) -> bytes | None:
    if kind == 1:
        return struct.pack("<BI", 1, 1) + record[4:20]
    if kind == 8:
        n = struct.unpack_from("<i", record, 36)[0]
        return struct.pack("<BII", 1, 4, n) + b"".join(struct.pack("<BI", 1, 1) + record[40 + 16 * k : 56 + 16 * k] for k in range(n))
    if kind not in (3, 5):
        return None
    n_parts, n_points = struct.unpack_from("<2i", record, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", record, 44), n_points]
    flat = struct.unpack_from(f"<{2 * n_points}d", record, 44 + 4 * n_parts)
    rings = [[(flat[2 * i], flat[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
    packed = [struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in rings]
    if kind == 3:
        lines = [struct.pack("<BI", 1, 2) + x for x in packed]
        return lines[0] if len(lines) == 1 else struct.pack("<BII", 1, 5, len(lines)) + b"".join(lines)
    area = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False)) for r in rings]
    outer = [i for i, x in enumerate(area) if x <= 0] or [0]  # outer rings turn right
    holds = {i: [packed[i]] for i in outer}
    for i, ring in enumerate(rings):
        if i not in holds:
            home = next((o for o in outer if inside(ring[0], rings[o])), outer[0])
            holds[home].append(packed[i])
    polygons = [struct.pack("<BII", 1, 3, len(x)) + b"".join(x) for x in holds.values()]
    return polygons[0] if len(polygons) == 1 else struct.pack("<BII", 1, 6, len(polygons)) + b"".join(polygons)


def inside(point: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    x, y = point
    crossings = ((a, b) for a, b in zip(ring, ring[1:], strict=False) if (a[1] <= y) != (b[1] <= y))
    return sum(x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in crossings) % 2 == 1


def dbase(content: bytes, encoding: str) -> Iterator[dict[str, object]]:
    """Attributes of every record; what is empty or no number is null."""
    n, first, _ = struct.unpack_from("<IHH", content, 4)
    return dbase_rows(content[:first], content[first:], n, encoding)


def dbase_rows(head: bytes, rows: bytes, n: int, encoding: str) -> Iterator[dict[str, object]]:
    """Attributes of ``n`` consecutive records, given the head of their file."""
    first, size = struct.unpack_from("<HH", head, 8)
    fields, at = [], 1
    for place in range(32, first - 1, 32):
        if head[place] == 0x0D:
            break
        name, kind, length = head[place : place + 11].split(b"\0")[0].decode(encoding), chr(head[place + 11]), head[place + 16]
        fields.append((name, kind, at, at + length, head[place + 17]))
        at += length
    for k in range(n):
        row = rows[k * size : (k + 1) * size]
        yield {name: dbase_value(row[a:b].decode(encoding, "replace").strip(), kind, digits) for name, kind, a, b, digits in fields}


def dbase_value(text: str, kind: str, digits: int) -> object:
    if not text or set(text) <= {"*"}:
        return None
    if kind in "NF":
        try:
            return float(text) if digits or not text.lstrip("+-").isdigit() else int(text)
        except ValueError:
            return None
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    return f"{text[:4]}-{text[4:6]}-{text[6:]}" if kind == "D" and len(text) == 8 else text


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """All shapefiles of a folder by ranges of records, see ``sources.shapefile``."""
    from pixelmill.sources import shapefile

    return shapefile.read_shapefile(spark, path)


def read_small_shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """file, layer, fid, geom (WKB), attributes (JSON) of all shapefiles in a folder, one task per file (S9): for stores
    that only Spark reads, and files that fit a task.

    The attribute table and its encoding are joined to the main file by name; without a table attributes are {}.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf,cpg}").load(path)
    named = files.select(F.regexp_extract("path", r"(?i)^(.*)\.(shp|dbf|cpg)$", 1).alias("base"), F.lower(F.regexp_extract("path", r"([^.]*)$", 1)).alias("kind"), "content")
    shp, dbf, cpg = (named.where(F.col("kind") == k).select("base", F.col("content").alias(k)) for k in ("shp", "dbf", "cpg"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for base, main, table, encoding in zip(batch["base"], batch["shp"], batch["dbf"], batch["cpg"], strict=True):
                rows = [] if table is None else list(dbase(bytes(table), known_encoding(encoding)))
                found = [(base, base.rsplit("/", 1)[-1], k, wkb, json.dumps(rows[k - 1] if k <= len(rows) else {})) for k, wkb in enumerate(shapes(bytes(main)), 1)]
                yield pd.DataFrame(found, columns=["file", "layer", "fid", "geom", "attributes"])

    return shp.join(dbf, "base", "left").join(cpg, "base", "left").mapInPandas(run, "file string, layer string, fid long, geom binary, attributes string")


def known_encoding(content: bytes | None) -> str:
    name = "" if content is None else bytes(content).decode("ascii", "ignore").strip()
    try:
        return codecs.lookup(name).name if name else "latin-1"
    except LookupError:
        return "latin-1"
