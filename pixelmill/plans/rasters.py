"""Registered queries on GeoTIFF files and cubes of scenes, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.functions import projection
from pixelmill.functions.rings import buffered, uncrossed_rings
from pixelmill.operators import cube, grid, spatial
from pixelmill.plans import fixtures as fx
from pixelmill.plans.registry import _series, query
from pixelmill.sources import files, geotiff, scenes

# GeoTIFF


def _stored(spark, sf_dir, **options) -> str:
    """The raster with gaps and without as two layers of tiled files."""
    path = f"{files.scratch(spark)}/tiled"
    full = fx.full_grid(spark, sf_dir).withColumn("v", F.when(F.expr(f"(row * {fx.N_COLS} + col) % 7 >= 2"), F.col("v")))
    both = full.join(fx.full_grid(spark, sf_dir).withColumnRenamed("v", "full_v"), ["row", "col"])
    geotiff.write_geotiff(both, path, fx.spec_of(full), "float64", tile=32, block=64, **options)
    return path


@query(f'WITH {fx.GRID} SELECT r AS "row", c AS col, v, full_v FROM cells')
def s6_geotiff_round_trip(spark, sf_dir):
    return geotiff.read_geotiff(spark, _stored(spark, sf_dir))


@query(f'WITH {fx.GRID} SELECT r AS "row", c AS col, v, full_v FROM cells')
def s6_geotiff_lzw(spark, sf_dir):
    return geotiff.read_geotiff(spark, _stored(spark, sf_dir, compression="lzw"))


@query(f'WITH {fx.GRID} SELECT r AS "row", c AS col, v FROM cells WHERE c BETWEEN 40 AND 70 AND r % 100 < 50')
def s4_geotiff_filters(spark, sf_dir):
    """One layer by name; the bounds on columns leave out tiles before they are read."""
    return geotiff.read_geotiff(spark, _stored(spark, sf_dir), ["v"]).where("col BETWEEN 40 AND 70 AND row % 100 < 50")


@query(f'WITH {fx.GRID} SELECT r AS "row", c AS col, full_v, v FROM cells')
def s5_bands_by_position(spark, sf_dir):
    return geotiff.read_geotiff(spark, _stored(spark, sf_dir), bands=[2, 1])


@query(f'WITH {fx.GRID} SELECT r AS "row", c AS col, round_even(full_v / 10, 0)::DOUBLE AS a, round_even(full_v / 20, 0)::DOUBLE AS b, round_even(full_v / 30, 0)::DOUBLE AS c FROM cells')
def s7_merged_bands(spark, sf_dir):
    """A file per band, then one raster of all bands."""
    spec, folder = fx.spec_of(fx.grid(spark, sf_dir)), files.scratch(spark)
    for band, share in (("a", 10), ("b", 20), ("c", 30)):
        layer = fx.full_grid(spark, sf_dir).select("row", "col", F.rint(F.col("v") / share).alias(band))
        geotiff.write_geotiff(layer, f"{folder}/{band}", spec, "int32", "lzw", tile=32, block=64)
    geotiff.write_geotiff(grid.stack([geotiff.read_geotiff(spark, f"{folder}/{band}") for band in "abc"]), f"{folder}/merged", geotiff.geotiff_grid(f"{folder}/a"), "int32", tile=32, block=64)
    merged = geotiff.read_geotiff(spark, f"{folder}/merged")
    return merged.select("row", "col", *[F.col(b).cast("double").alias(b) for b in "abc"])


# polygons


@query(f"WITH {fx.GRID}, {fx.RECTS} SELECT id, CAST(round(CASE WHEN id % 2 = 0 THEN w * h / 2 ELSE 1.5 * w * h END, 6) AS DOUBLE) AS area, 2 AS n_rings FROM rects")
def g19_uncrossed(spark, sf_dir):
    """Bow-ties become two triangles; two rings that overlap by a quarter become what only one of them covers."""
    shapes = fx.rects(spark, sf_dir, fx.spec_of(fx.grid(spark, sf_dir)).n_rows)
    ring = F.col("rings")[0]
    bow = F.array(F.array(ring[0], ring[2], ring[1], ring[3], ring[0]))
    dx, dy = (ring[2]["x"] - ring[0]["x"]) / 2, (ring[2]["y"] - ring[0]["y"]) / 2
    moved = F.transform(ring, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))
    crossed = shapes.withColumn("rings", F.when(F.col("id") % 2 == 0, bow).otherwise(F.array(ring, moved)))
    mended = uncrossed_rings(crossed)
    return mended.select("id", F.round(spatial.ring_area(F.col("rings")), 6).alias("area"), F.size("rings").alias("n_rings"))


@query(f"WITH {fx.GRID}, {fx.RECTS} SELECT id, CAST(round(w * h + 5 * (w + h) + 16 * 6.25 * sin(pi() / 16), 6) AS DOUBLE) AS area, 1 AS n_rings FROM rects")
def g18_polygon_buffer(spark, sf_dir):
    """Rectangles widened by 2.5 with round corners of 32 points a circle, against the closed form."""
    shapes = buffered(fx.rects(spark, sf_dir, fx.spec_of(fx.grid(spark, sf_dir)).n_rows), 2.5)
    return shapes.select("id", F.round(spatial.ring_area(F.col("rings")), 6).alias("area"), F.size("rings").alias("n_rings"))


@query(
    f"""WITH {fx.GRID}, {fx.RECTS}, spots AS MATERIALIZED (SELECT r, c, c + 0.5 AS px, n_rows - r - 0.5 - 0.013 AS py FROM cells, n)
SELECT id, r AS "row", c AS col FROM rects JOIN spots ON px >= x AND py >= y AND ((id % 2 = 0 AND (px - x) / w + (py - y) / h < 1)
  OR (id % 2 = 1 AND px < x + w AND py < y + h AND NOT (px >= x + w / 4 AND px < x + w * 3 / 4 AND py >= y + h / 4 AND py < y + h * 3 / 4)))"""
)
def j11_zonal_shapes(spark, sf_dir):
    """Cells of triangles, and of rectangles with a hole."""
    spec = fx.spec_of(fx.grid(spark, sf_dir))
    ring = F.transform(F.col("rings")[0], lambda p: F.struct(p["x"].alias("x"), (p["y"] + 0.013).alias("y")))
    w, h = ring[2]["x"] - ring[0]["x"], ring[2]["y"] - ring[0]["y"]
    hole = F.transform(ring, lambda p: F.struct((ring[0]["x"] + w / 4 + (p["x"] - ring[0]["x"]) / 2).alias("x"), (ring[0]["y"] + h / 4 + (p["y"] - ring[0]["y"]) / 2).alias("y")))
    triangle = F.array(F.array(ring[0], ring[1], ring[3], ring[0]))
    shapes = fx.rects(spark, sf_dir, spec.n_rows).withColumn("rings", F.when(F.col("id") % 2 == 0, triangle).otherwise(F.array(ring, F.reverse(hole))))
    return spatial.zonal_cells(shapes, spec).select("id", "row", "col")


# cubes

_TILE_32, _TILE_33 = fx.CUBE_TILES.values()
_LEFT, _TOP, _CELL, _COLS = fx.CUBE_TARGET
_LATITUDE = " + ".join(f"({d!r}) * sin({2 * j} * chi)" for j, d in enumerate(projection.LATITUDE, 1))
#: Target cells in the pixels of both tiles: those of zone 33 by way of degrees.
_CUBE = f"""{fx.GRID}, n AS (SELECT max(r) + 1 AS n_rows FROM cells),
target AS (SELECT CAST(i AS INT) AS r, CAST(j AS INT) AS c, {_LEFT} + (j + 0.5) * {_CELL} AS x, {_TOP} - (i + 0.5) * {_CELL} AS y FROM n, range(0, n_rows * 4 // 5 + 5) a(i), range(0, {_COLS}) b(j)),
i1 AS (SELECT r, c, y / {projection.RADIUS!r} AS xi, (x - 500000) / {projection.RADIUS!r} AS eta FROM target),
i2 AS (SELECT r, c, xi - ({_series("north", "xi", "eta", projection.INVERSE)}) AS xi, eta - ({_series("east", "xi", "eta", projection.INVERSE)}) AS eta FROM i1),
i3 AS (SELECT r, c, asin(sin(xi) / cosh(eta)) AS chi, degrees(atan2(sinh(eta), cos(xi))) + 9 AS lon FROM i2),
i4 AS (SELECT r, c, radians(lon - 15) AS away, chi + {_LATITUDE} AS phi FROM i3),
f1 AS (SELECT r, c, away, sinh(atanh(sin(phi)) - {projection.ECCENTRICITY!r} * atanh({projection.ECCENTRICITY!r} * sin(phi))) AS t FROM i4),
f2 AS (SELECT r, c, atan2(t, cos(away)) AS xi, asinh(sin(away) / sqrt(t * t + cos(away) * cos(away))) AS eta FROM f1),
f3 AS (SELECT r, c, 500000 + {projection.RADIUS!r} * (eta + {_series("east", "xi", "eta", projection.FORWARD)}) AS x, {projection.RADIUS!r} * (xi + {_series("north", "xi", "eta", projection.FORWARD)}) AS y FROM f2),
placed AS (
  SELECT r, c, 0 AS tile, (x - {_TILE_32[0]}) / {_TILE_32[2]} - 0.5 AS x, ({_TILE_32[1]} - y) / {_TILE_32[2]} - 0.5 AS y FROM target
  UNION ALL SELECT r, c, 1, (x - {_TILE_33[0]}) / {_TILE_33[2]} - 0.5, ({_TILE_33[1]} - y) / {_TILE_33[2]} - 0.5 FROM f3
),
corners AS (SELECT p.r, p.c, tile, v, abs(1 - i - (x - floor(x))) * abs(1 - j - (y - floor(y))) AS w FROM placed p CROSS JOIN (VALUES (0), (1)) a(i) CROSS JOIN (VALUES (0), (1)) b(j)
  JOIN cells ON cells.r = floor(y) + j AND cells.c = floor(x) + i WHERE v IS NOT NULL),
dates AS (SELECT unnest([0, 1, 2]) AS d),
band AS (SELECT r, c, tile, d, sum(w * CASE WHEN tile = 0 THEN v / 100 * (1 + d / 10) ELSE v / 100 * (1 + d / 8) + 100 END) / nullif(sum(w), 0) AS b FROM corners, dates GROUP BY ALL),
class AS (SELECT p.r, p.c, tile, d, CASE WHEN tile = 0 THEN ((cells.r * 100 + cells.c) * 5 + d * 3) % 12 ELSE ((cells.r * 100 + cells.c) * 7 + d) % 12 END AS scl
  FROM placed p JOIN cells ON cells.r = floor(y + 0.5) AND cells.c = floor(x + 0.5) CROSS JOIN dates),
seen AS (SELECT class.r, class.c, class.tile, class.d, scl, b FROM class LEFT JOIN band ON band.r = class.r AND band.c = class.c AND band.tile = class.tile AND band.d = class.d)"""
_CLEAR = "scl IN (4, 5, 6)"


@query(f"""WITH {_CUBE}, m AS (SELECT r, c, median(b) FILTER (WHERE {_CLEAR}) AS b FROM seen GROUP BY r, c) SELECT target.r AS "row", target.c AS col, round(b, 0) AS b08 FROM target LEFT JOIN m ON m.r = target.r AND m.c = target.c""")
def g1_cube(spark, sf_dir):
    """The seasonal median of scenes of two zones on one grid."""
    tiles, target = fx.cube_specs(fx.spec_of(fx.grid(spark, sf_dir)).n_rows)
    return cube.seasonal_cube(fx.scenes(spark, sf_dir), tiles, target, ["b08"], block=64).withColumn("b08", F.round("b08", 0))


@query(
    f"""WITH {_CUBE}, k AS (SELECT r, c, d, avg(b) FILTER (WHERE {_CLEAR}) AS b FROM seen GROUP BY r, c, d), m AS (SELECT r, c, median(b) AS b FROM k GROUP BY r, c)
SELECT target.r AS "row", target.c AS col, round(b, 0) AS b08 FROM target LEFT JOIN m ON m.r = target.r AND m.c = target.c"""
)
def g1_cube_merged_days(spark, sf_dir):
    """As g1_cube; where tiles overlap, a day counts once."""
    tiles, target = fx.cube_specs(fx.spec_of(fx.grid(spark, sf_dir)).n_rows)
    return cube.seasonal_cube(fx.scenes(spark, sf_dir), tiles, target, ["b08"], merge_days=True, block=64).withColumn("b08", F.round("b08", 0))


@query(f"""WITH {_CUBE}, m AS (SELECT r, c, median(b) FILTER (WHERE {_CLEAR} AND d > 0) AS b FROM seen GROUP BY r, c) SELECT target.r AS "row", target.c AS col, round(b, 0) AS b08 FROM target LEFT JOIN m ON m.r = target.r AND m.c = target.c""")
def s3_cube_of_files(spark, sf_dir):
    """Scenes stored as GeoTIFF, discovered by their names, read and composed over a part of the season."""
    folder, spec = files.scratch(spark), fx.spec_of(fx.grid(spark, sf_dir))
    tiles, target = fx.cube_specs(spec.n_rows)
    observed = fx.scenes(spark, sf_dir)
    for tile, grid_of_tile in tiles.items():
        for day in (1, 6, 11):
            scene = observed.where((F.col("tile") == tile) & (F.dayofmonth("ts") == day)).select("row", "col", F.col("scl").cast("double").alias("scl"), "b08")
            geotiff.write_geotiff(scene, folder, grid_of_tile, "float64", tile=32, block=512, scene=f"S2_{tile}_201904{day:02d}T101000_L2A")
    pixels = scenes.scene_pixels(spark, folder).withColumn("scl", F.col("scl").cast("int"))
    season = cube.Season("late", "2019-04-05", "2019-05-31")
    return cube.seasonal_cube(pixels, scenes.scene_grids(folder), target, ["b08"], season, block=64).withColumn("b08", F.round("b08", 0))
