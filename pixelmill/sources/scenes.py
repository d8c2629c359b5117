"""The archive of satellite scenes: discovery, tile coverage, and the table of scenes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.operators.grid import GridSpec
from pixelmill.sources.files import path_exists
from pixelmill.sources.geotiff import by_scene, grid_of, listed, read_geotiff

#: The tiles that cover the area, those a run cannot do without, and how names show them.
TILES = ("T32TLQ", "T32TLR", "T32TMQ", "T32TMR")
TILE_PATTERN = r"_(T\d{2}[A-Z]{3})_"
ACQUIRED_PATTERN = r"_(\d{8}T\d{6})_"


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """path, format, tile, acquired of each .zip and .SAFE in a folder, without its subfolders.

    One listing call of the file system; archives are not opened.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    entries = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    names = sorted(e.getPath().toString() for e in entries)
    rows = [(n, n.rsplit(".", 1)[1].lower()) for n in names if re.search(r"\.(zip|SAFE)$", n)]
    found = spark.createDataFrame(rows, "path string, format string")
    return found.withColumns(
        {
            "tile": F.nullif(F.regexp_extract("path", TILE_PATTERN, 1), F.lit("")),
            "acquired": F.try_to_timestamp(F.regexp_extract("path", ACQUIRED_PATTERN, 1), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz"),
        }
    )


def tile_counts(scenes: DataFrame) -> DataFrame:
    """Scenes per tile."""
    return scenes.where("tile IS NOT NULL").groupBy("tile").agg(F.count(F.lit(1)).alias("n"))


def check_tiles(scenes: DataFrame, needed: Sequence[str] = TILES) -> None:
    """Stops if a needed tile has no scene."""
    held = {r.tile for r in tile_counts(scenes).collect()}
    if gone := sorted(set(needed) - held):
        raise ValueError(f"no scene of {', '.join(gone)}")


def scene_table(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """The stored table of scenes, made from the folder the first time (S3)."""
    if not path_exists(spark, path):
        list_archives(spark, folder).write.parquet(path)
    return spark.read.parquet(path)


def scene_grids(folder: str) -> dict[str, GridSpec]:
    """The grid of each tile with a GeoTIFF scene in the folder; all scenes of a tile share it (S3)."""
    grids: dict[str, GridSpec] = {}
    for scene, files in by_scene(listed(folder)).items():
        if not (found := re.search(TILE_PATTERN, scene)):
            continue
        grid = grid_of([image for _, image in files])
        if grids.setdefault(found[1], grid) != grid:
            raise ValueError(f"scenes of {found[1]} have different grids")
    return grids


def scene_pixels(spark: SparkSession, folder: str, bands: Sequence[str] | None = None) -> DataFrame:
    """tile, ts, row, col and the layers of every GeoTIFF scene in a folder (S3): the observations of a cube.

    Scenes are read by ranges of tiles, as many tasks as their bytes ask for. Names that show no tile are left out.
    """
    pixels = read_geotiff(spark, folder, bands, each=True)
    acquired = F.try_to_timestamp(F.regexp_extract("file", ACQUIRED_PATTERN, 1), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")
    named = pixels.select(F.regexp_extract("file", TILE_PATTERN, 1).alias("tile"), acquired.alias("ts"), *[c for c in pixels.columns if c != "file"])
    return named.where("tile <> ''")
