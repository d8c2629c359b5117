"""Scenes of several tiles and reference systems brought to one grid, and their composites."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pixelmill.functions.indices import clear
from pixelmill.functions.projection import ARRAYS, transformed
from pixelmill.operators.composite import Season, in_season, seasonal_median
from pixelmill.operators.grid import GridSpec, on_template
from pixelmill.session import ship_package


def met_blocks(obs: DataFrame, tiles: Mapping[str, GridSpec], target: GridSpec, block: int) -> DataFrame:
    """``obs`` with block_row and block_col: the target blocks in whose cells a source pixel may have weight.

    A pixel near the edge of a block is sent to the neighbouring blocks, too (the halo); pixels off the grid, and those of
    tiles without a grid, are dropped.
    """
    # a pixel has weight up to one source cell away along both of the source's axes, whichever way these are turned
    reach = {name: int(np.ceil(1.5 * max(g.dx / target.dx, g.dy / target.dy))) + 1 for name, g in tiles.items()}
    last = (target.n_rows - 1) // block, (target.n_cols - 1) // block

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            low, high = np.full((2, len(batch)), 0), np.full((2, len(batch)), -1)
            for name, held in batch.groupby("tile").indices.items():
                if (grid := tiles.get(name)) is None:
                    continue
                x = grid.left + (batch["col"].to_numpy()[held] + 0.5) * grid.dx
                y = grid.top - (batch["row"].to_numpy()[held] + 0.5) * grid.dy
                x, y = transformed(x, y, grid.srid, target.srid, ARRAYS)
                at = np.array([(target.top - y) / target.dy, (x - target.left) / target.dx])
                low[:, held] = np.maximum(np.floor((at - reach[name]) / block), 0)
                high[:, held] = np.minimum(np.floor((at + reach[name]) / block), np.array(last)[:, None])
            yield batch.assign(low_row=low[0], high_row=high[0], low_col=low[1], high_col=high[1])

    bounds = [StructField(n, IntegerType()) for n in ("low_row", "high_row", "low_col", "high_col")]
    placed = obs.mapInPandas(place, StructType([*obs.schema.fields, *bounds])).where("low_row <= high_row AND low_col <= high_col")
    rows, cols = F.explode(F.sequence("low_row", "high_row")), F.explode(F.sequence("low_col", "high_col"))
    return placed.withColumn("block_row", rows).withColumn("block_col", cols).drop("low_row", "high_row", "low_col", "high_col")


def regridded(obs: DataFrame, tiles: Mapping[str, GridSpec], target: GridSpec, bands: Sequence[str], scene_class: str = "scl", block: int = 256) -> DataFrame:
    """Every scene on the target grid: tile, ts, row, col, scene class and bands.

    ``obs`` (tile, ts, row, col, scene class, bands) holds the pixels of scenes; ``tiles`` the grid of each tile. One
    shuffle brings the pixels of a scene that meet a block of ``block`` x ``block`` target cells together; there the
    bands are interpolated bilinearly (nulls lend their weight) and the scene class is that of the nearest pixel. Cells
    without a scene class are outside the scene and give no row. A task holds one block of one scene.
    """
    ship_package(obs.sparkSession)
    names, specs = list(bands), dict(tiles)
    sent = met_blocks(obs.select("tile", "ts", "row", "col", scene_class, *names), specs, target, block)

    def warp(key: tuple, pixels: pd.DataFrame) -> pd.DataFrame:
        block_row, block_col, tile, ts = key
        spec = specs[tile]
        rows = np.arange(block_row * block, min((block_row + 1) * block, target.n_rows))
        cols = np.arange(block_col * block, min((block_col + 1) * block, target.n_cols))
        x, y = np.meshgrid(target.left + (cols + 0.5) * target.dx, target.top - (rows + 0.5) * target.dy)
        x, y = transformed(x, y, target.srid, spec.srid, ARRAYS)
        x, y = (x - spec.left) / spec.dx - 0.5, (spec.top - y) / spec.dy - 0.5
        # the pixels as a window of the source, with an edge of absent ones
        top, left = pixels["row"].min() - 1, pixels["col"].min() - 1
        shape = pixels["row"].max() - top + 2, pixels["col"].max() - left + 2
        place = pixels["row"].to_numpy() - top, pixels["col"].to_numpy() - left

        def at(window: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
            return window[np.clip(r - top, 0, shape[0] - 1), np.clip(c - left, 0, shape[1] - 1)]

        window = np.full(shape, np.nan)
        window[place] = pixels[scene_class].to_numpy(float)
        classes = at(window, np.floor(y + 0.5).astype(int), np.floor(x + 0.5).astype(int))
        held = ~np.isnan(classes)
        x, y, classes = x[held], y[held], classes[held]
        x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
        right, down = x - x0, y - y0
        row, col = (a[held] for a in np.meshgrid(rows, cols, indexing="ij"))
        out = {"tile": tile, "ts": ts, "row": row, "col": col, scene_class: classes.astype(int)}
        for name in names:
            window = np.full(shape, np.nan)
            window[place] = pixels[name].to_numpy(float)
            total, weight = np.zeros(len(x)), np.zeros(len(x))
            for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
                value, share = at(window, y0 + j, x0 + i), (right if i else 1 - right) * (down if j else 1 - down)
                there = ~np.isnan(value)
                total[there] += (value * share)[there]
                weight[there] += share[there]
            out[name] = np.divide(total, weight, out=np.full(len(x), np.nan), where=weight > 0)
        return pd.DataFrame(out)

    schema = f"tile string, ts {obs.schema['ts'].dataType.simpleString()}, row int, col int, {scene_class} int, " + ", ".join(f"{n} double" for n in names)
    warped = sent.groupBy("block_row", "block_col", "tile", "ts").applyInPandas(warp, schema)
    return warped.withColumns({n: F.nanvl(n, F.lit(None)) for n in names})


def by_date(warped: DataFrame, bands: Sequence[str], scene_class: str = "scl") -> DataFrame:
    """One observation per cell and day: the mean of what overlapping tiles show clear, its scene class the smallest
    clear one, or the smallest of all (G1)."""
    clear_class = F.min(clear(F.col(scene_class), F.col(scene_class)))
    day = F.to_date("ts").alias("day")
    found = warped.groupBy("row", "col", day).agg(F.coalesce(clear_class, F.min(scene_class)).alias(scene_class), *[F.avg(clear(F.col(b), F.col(scene_class))).alias(b) for b in bands])
    return found.select("row", "col", F.col("day").cast("timestamp_ntz").alias("ts"), scene_class, *bands)


def seasonal_cube(
    obs: DataFrame, tiles: Mapping[str, GridSpec], target: GridSpec, bands: Sequence[str], season: Season | None = None, merge_days: bool = False, scene_class: str = "scl", block: int = 256
) -> DataFrame:
    """The seasonal grid of the scenes of all tiles (G1, A1): every cell of the target with the median of its clear
    observations, null where none is clear.

    Each scene counts, as in a cube whose slice is a season; with ``merge_days`` overlapping tiles of one day count once.
    """
    chosen = obs if season is None else in_season(obs, season)
    warped = regridded(chosen, tiles, target, bands, scene_class, block)
    if merge_days:
        warped = by_date(warped, bands, scene_class)
    return on_template(seasonal_median(warped, ["row", "col"], bands, scene_class), target)
