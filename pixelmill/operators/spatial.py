"""Vector and raster together: rasterising, zonal rows, sampling, masks, distances, connected parts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.operators.components import cell_components, components
from pixelmill.operators.grid import GridSpec
from pixelmill.session import ship_package, work_table

#: A polygon is a list of closed rings; a ring is a list of points.
RINGS = "array<array<struct<x:double,y:double>>>"


def valid_rings(rings: Column) -> Column:
    """All rings closed, of four points at least, without nulls."""
    ring_ok = lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)) & F.forall(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.coalesce((F.size(rings) > 0) & F.forall(rings, ring_ok), F.lit(False))


def without_stray_points(ring: Column) -> Column:
    """Points that repeat the one before, or that the ring reaches and leaves along the same line (spikes)."""
    def last(r: Column, k: int) -> Column:
        return F.element_at(r, -k)

    def add(done: Column, p: Column) -> Column:
        turn = (last(done, 1)["x"] - last(done, 2)["x"]) * (p["y"] - last(done, 1)["y"]) - (last(done, 1)["y"] - last(done, 2)["y"]) * (p["x"] - last(done, 1)["x"])
        back = (last(done, 1)["x"] - last(done, 2)["x"]) * (p["x"] - last(done, 1)["x"]) + (last(done, 1)["y"] - last(done, 2)["y"]) * (p["y"] - last(done, 1)["y"])
        spike = (F.size(done) >= 2) & (turn == 0) & (back < 0)
        shorter = F.slice(done, 1, F.size(done) - 1)
        joined = F.when(last(shorter, 1) == p, shorter).otherwise(F.concat(shorter, F.array(p)))
        return F.when((F.size(done) >= 1) & (last(done, 1) == p), done).when(spike, joined).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(ring, F.slice(ring, 1, 0), add)


def repaired(rings: Column) -> Column:
    """Rings without null and repeated points and spikes, closed where they were open, oriented outer ring
    against holes; rings that keep no area are dropped, a polygon without rings is null (G19).

    Rings that cross themselves stay as they are: scan lines read them by the even-odd rule.
    """
    whole = lambda r: F.filter(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    closed = lambda r: F.when((F.size(r) > 0) & (F.element_at(r, 1) != F.element_at(r, -1)), F.concat(r, F.slice(r, 1, 1))).otherwise(r)
    clean = F.transform(F.transform(F.transform(rings, whole), without_stray_points), closed)
    held = F.filter(clean, lambda r: (F.size(r) >= 4) & (ring_area(F.array(r)) > 0))
    turned = F.transform(held, lambda r, i: F.when((signed_area(r) > 0) == (i == 0), r).otherwise(F.reverse(r)))
    return F.when(F.size(turned) > 0, turned)


def signed_area(ring: Column) -> Column:
    """Positive for a ring that turns left."""
    steps = F.sequence(F.lit(1), F.size(ring) - 1)
    return F.aggregate(steps, F.lit(0.0), lambda s, i: s + (ring[i - 1]["x"] * ring[i]["y"] - ring[i]["x"] * ring[i - 1]["y"]) / 2)


def ring_area(rings: Column) -> Column:
    """Area by the shoelace formula, holes (of opposite turn) taken off."""

    return F.abs(F.aggregate(rings, F.lit(0.0), lambda s, r: s + signed_area(r)))


def zonal_cells(polygons: DataFrame, spec: GridSpec, id_col: str = "id", rings: str = "rings") -> DataFrame:
    """One row (id, row, col) for each cell whose centre lies in a polygon.

    Scan lines: every grid row within a polygon's height is cut at the ring crossings, and the cells between
    an odd and the next even crossing are emitted. No cell outside a polygon is ever made.
    """
    valid = polygons.where(valid_rings(F.col(rings)))
    ys = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["y"])))
    first = F.greatest(F.lit(0), F.ceil((spec.top - F.array_max(ys)) / spec.dy - 0.5).cast("int"))
    last = F.least(F.lit(spec.n_rows - 1), F.floor((spec.top - F.array_min(ys)) / spec.dy - 0.5).cast("int"))
    lines = valid.withColumns({"first": first, "last": last}).where("first <= last").select(id_col, rings, F.explode(F.sequence("first", "last")).alias("row"))
    y = spec.top - (F.col("row") + 0.5) * spec.dy

    def crossings(ring: Column) -> Column:
        edges = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(ring[i - 1].alias("a"), ring[i].alias("b")))
        cut = F.filter(edges, lambda e: (e["a"]["y"] <= y) != (e["b"]["y"] <= y))
        return F.transform(cut, lambda e: e["a"]["x"] + (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]))

    cuts = lines.select(id_col, "row", F.array_sort(F.flatten(F.transform(rings, crossings))).alias("xs")).where("size(xs) > 1")
    spans = cuts.select(id_col, "row", "xs", F.explode(F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2))).alias("i"))
    from_col = F.ceil((F.col("xs")[F.col("i") - 1] - spec.left) / spec.dx - 0.5)
    to_col = F.ceil((F.col("xs")[F.col("i")] - spec.left) / spec.dx - 0.5) - 1
    spans = spans.select(id_col, "row", F.greatest(F.lit(0), from_col.cast("int")).alias("a"), F.least(F.lit(spec.n_cols - 1), to_col.cast("int")).alias("b"))
    return spans.where("a <= b").select(id_col, "row", F.explode(F.sequence("a", "b")).alias("col"))


def rasterise(polygons: DataFrame, spec: GridSpec, value: str, id_col: str = "id") -> DataFrame:
    """Value per covered cell; of overlapping polygons the largest id wins."""
    cells = zonal_cells(polygons, spec, id_col).groupBy("row", "col").agg(F.max(id_col).alias(id_col))
    return cells.join(polygons.select(id_col, value), id_col).select("row", "col", value)


def line_cells(lines: DataFrame, spec: GridSpec, points: str = "points") -> DataFrame:
    """Distinct cells that polylines pass, found by points at half a cell's distance."""
    steps = F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: F.struct(F.col(points)[i - 1].alias("a"), F.col(points)[i].alias("b")))
    segment = lines.where(F.size(points) > 1).select(F.explode(steps).alias("s")).select("s.a.x", "s.a.y", F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    reach = F.greatest(F.abs(F.col("bx") - F.col("x")) / spec.dx, F.abs(F.col("by") - F.col("y")) / spec.dy)
    n = F.greatest(F.lit(1), F.ceil(reach * 2).cast("int"))
    points_on = segment.withColumn("n", n).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n")))).withColumn("t", F.col("t") / F.col("n"))
    px, py = F.col("x") + F.col("t") * (F.col("bx") - F.col("x")), F.col("y") + F.col("t") * (F.col("by") - F.col("y"))
    cells = points_on.select(F.floor((spec.top - py) / spec.dy).cast("int").alias("row"), F.floor((px - spec.left) / spec.dx).cast("int").alias("col"))
    return cells.where(F.col("row").between(0, spec.n_rows - 1) & F.col("col").between(0, spec.n_cols - 1)).distinct()


def sample_points(points: DataFrame, layer: DataFrame, spec: GridSpec | None = None) -> DataFrame:
    """Each point with the layer's values in its cell; by x and y if a grid is given, else by row and col."""
    if spec is not None:
        points = points.withColumns({"row": F.floor((spec.top - F.col("y")) / spec.dy).cast("int"), "col": F.floor((F.col("x") - spec.left) / spec.dx).cast("int")})
    return points.join(layer, ["row", "col"], "left")


def mask(layer: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """The layer with nulls outside the cells."""
    inside = cells.select("row", "col", F.lit(True).alias("in_mask")).distinct()
    return layer.join(inside, ["row", "col"], "left").withColumn(value, F.when(F.col("in_mask"), F.col(value))).drop("in_mask")


def clip(layer: DataFrame, cells: DataFrame) -> DataFrame:
    """Only the cells of a perimeter."""
    return layer.join(cells.select("row", "col").distinct(), ["row", "col"], "left_semi")


def row_minima(height: np.ndarray, dx: float) -> np.ndarray:
    """min over c of (dx * (x - c))^2 + height[row, c] for every row and column x; inf where nothing is held.

    The lower envelope of the parabolas over each row, in time linear in the columns: columns are added from left to
    right, in all rows at once; a new parabola removes those at the end of the envelope that it lies below.
    """
    n, width = height.shape
    top = np.full(n, -1)  # the last parabola of each row's envelope, the column of each, and where it begins
    column, begin = np.zeros((n, width), np.int64), np.full((n, width), -np.inf)
    held = np.isfinite(height)
    scaled = height / dx**2
    for q in np.flatnonzero(held.any(axis=0)).tolist():
        new = np.flatnonzero(held[:, q])
        begins, open_rows = np.full(n, -np.inf), new
        while len(open_rows := open_rows[top[open_rows] >= 0]):
            last = top[open_rows]
            p = column[open_rows, last]
            cross = (scaled[open_rows, q] - scaled[open_rows, p] + (q - p) * (q + p)) / (2 * (q - p))
            below = cross <= begin[open_rows, last]
            begins[open_rows] = np.where(below, -np.inf, cross)
            open_rows = open_rows[below]
            top[open_rows] -= 1
        top[new] += 1
        column[new, top[new]], begin[new, top[new]] = q, begins[new]
    best, x = np.full((n, width), np.inf), np.arange(width)
    for row in np.flatnonzero(top >= 0).tolist():
        p = column[row, np.searchsorted(begin[row, : top[row] + 1], x, side="right") - 1]
        best[row] = (dx * (x - p)) ** 2 + height[row, p]
    return best


def distance(grid: DataFrame, source: str, dx: float, dy: float, block_rows: int = 64) -> DataFrame:
    """Exact distance of every cell to the nearest cell whose ``source`` is not null; 0 there.

    Pass 1 finds the nearest source up and down each column by windows; pass 2 takes, for ``block_rows`` rows
    of the raster at a time, the smallest sum of squares along the row. A task holds one such block. A grid
    without sources gives nulls.
    """
    ship_package(grid.sparkSession)
    up = Window.partitionBy("col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    # upwards by the turned order: a frame up to unboundedFollowing is walked anew for every row
    down = Window.partitionBy("col").orderBy(F.col("row").desc()).rowsBetween(Window.unboundedPreceding, 0)
    here = F.when(F.col(source).isNotNull(), F.col("row"))
    above, below = F.last(here, ignorenulls=True).over(up), F.last(here, ignorenulls=True).over(down)
    vertical = grid.select("row", "col", F.least(F.col("row") - above, below - F.col("row")).alias("g"))

    def of_block(cells: pd.DataFrame) -> pd.DataFrame:
        rows, at = np.unique(cells["row"].to_numpy(), return_inverse=True)
        col = cells["col"].to_numpy()
        height = np.full((len(rows), int(col.max() - col.min()) + 1), np.inf)
        g = cells["g"].to_numpy(float)
        height[at, col - col.min()] = np.where(np.isnan(g), np.inf, (g * dy) ** 2)
        squared = row_minima(height, dx)[at, col - col.min()]
        return cells[["row", "col"]].assign(distance=np.sqrt(np.where(np.isinf(squared), np.nan, squared)))

    blocks = vertical.groupBy(F.expr(f"row DIV {block_rows}"))
    return blocks.applyInPandas(of_block, "row int, col int, distance double").select("row", "col", F.nanvl("distance", F.lit(None)).alias("distance"))


def buffer_cells(grid: DataFrame, source: str, radius: float, dx: float, dy: float) -> DataFrame:
    """Cells within ``radius`` of a source cell."""
    return distance(grid, source, dx, dy).where(F.col("distance") <= radius).select("row", "col")


def isolated_parts(polygons: DataFrame, spec: GridSpec, radius: float, least_area: float) -> DataFrame:
    """The large connected parts of a set of polygons, as cells with their part and its area.

    Cells whose centre lies within ``radius`` of a polygon's cell join fragments; all are united, split into
    connected parts, and parts under ``least_area`` dropped.
    """
    source = zonal_cells(polygons, spec).select("row", "col").distinct().withColumn("on", F.lit(1))
    reach = math.ceil(radius / min(spec.dx, spec.dy) + 0.5)
    span = F.sequence(F.lit(-reach), F.lit(reach))
    # only cells within reach of a source take part, not the whole grid
    near = source.select("row", "col", F.explode(span).alias("i")).select("row", "col", "i", F.explode(span).alias("j"))
    gap = F.hypot(F.greatest(F.abs("i") - 0.5, F.lit(0.0)) * spec.dy, F.greatest(F.abs("j") - 0.5, F.lit(0.0)) * spec.dx)
    joined = near.where(gap <= radius)
    cells = joined.select((F.col("row") + F.col("i")).alias("row"), (F.col("col") + F.col("j")).alias("col")).distinct()
    cells = cells.where(F.col("row").between(0, spec.n_rows - 1) & F.col("col").between(0, spec.n_cols - 1))
    labelled = raster_components(cells, spec.n_cols)
    return labelled.join(large_components(labelled, spec.dx * spec.dy, least_area), "component").select("row", "col", "component", "area")


def raster_components(cells: DataFrame, n_cols: int, block: int = 256) -> DataFrame:
    """component of each cell: the smallest row * n_cols + col among the cells joined by an edge.

    Cells are labelled inside blocks of ``block`` x ``block``, one block in a task at a time; the labels that meet at the
    edges of blocks are the links of a small graph, whose components join them. Cells without a place have none.
    """
    ship_package(cells.sparkSession)

    def of_block(held: pd.DataFrame) -> pd.DataFrame:
        if held[["row", "col"]].isna().any(axis=None):
            return held.assign(root=pd.array([None] * len(held), "Int64"))
        held = held.sort_values(["row", "col"])
        row, col = held["row"].to_numpy(np.int64), held["col"].to_numpy(np.int64)
        return held.assign(root=(row * n_cols + col)[cell_components(row, col)])

    blocks = cells.select("row", "col").distinct().groupBy(F.expr(f"row DIV {block}"), F.expr(f"col DIV {block}"))
    inside = work_table(blocks.applyInPandas(of_block, "row int, col int, root long"), "block-components")
    met = []
    for axis in ("row", "col"):
        edge = inside.where(f"{axis} DIV {block} <> ({axis} + 1) DIV {block}").withColumn(axis, F.col(axis) + 1)
        first = inside.where(f"{axis} DIV {block} <> ({axis} - 1) DIV {block}").withColumnRenamed("root", "b")
        met.append(edge.join(first, ["row", "col"]).select(F.col("root").alias("a"), "b"))
    labels = components(met[0].union(met[1])).withColumnRenamed("vertex", "root")
    return inside.join(labels, "root", "left").select("row", "col", F.coalesce("component", "root").alias("component"))


def large_components(labelled: DataFrame, cell_area: float, least_area: float) -> DataFrame:
    """Cells and area of the components of at least ``least_area``."""
    sizes = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n_cells"))
    return sizes.withColumn("area", F.col("n_cells") * F.lit(cell_area)).where(F.col("area") >= least_area)
