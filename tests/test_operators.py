from __future__ import annotations

import datetime as dt
import json
import math
import random
import sqlite3
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelmill import session
from pixelmill.functions import indices, projection
from pixelmill.operators import applicability, checks, composite, forest, grid, legend, metrics, neighbourhood, purity, sampling, selection, separability, spatial
from pixelmill.operators.components import components
from pixelmill.operators.grid import GridSpec, bilinear, mosaic, nearest, prefer_filled, stack
from pixelmill.sources import files, scenes, vectors
from pixelmill.streaming.composite import clear_looks


def raster(spark, values):
    rows = [(r, c, None if v is None else float(v)) for r, line in enumerate(values) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "row int, col int, v double")


def matrix(df, value="v"):
    cells = {(r["row"], r["col"]): r[value] for r in df.collect()}
    n, m = max(k[0] for k in cells) + 1, max(k[1] for k in cells) + 1
    return [[cells.get((i, j)) for j in range(m)] for i in range(n)]


@given(st.floats(0, 9e5), st.floats(0, 9e5), st.floats(0, 2e4), st.floats(0, 2e4))
def test_snapping_keeps_cells_and_never_shrinks(left, bottom, w, h):
    spec = GridSpec(428_978.0, 5_004_263.0, 10.0, 10.0, 2540, 6439)
    grown = spec.snapped(left, bottom, left + w, bottom + h)
    for a, b in zip(grown.bounds[:2], spec.bounds[:2], strict=True):
        assert a <= b + 1e-6 and abs((b - a) / 10 - round((b - a) / 10)) < 1e-6
    assert grown.bounds[2] >= spec.bounds[2] and grown.bounds[3] >= spec.bounds[3]
    assert grown.bounds[0] <= left - 300 + 1e-6 and grown.bounds[3] >= bottom + h + 300 - 1e-6


def test_even_median_and_masking(spark):
    rows = [(1, 4, 10.0), (1, 5, 20.0), (1, 8, 99.0), (1, None, 99.0), (2, 9, 1.0), (3, 6, None)]
    df = spark.createDataFrame(rows, "pixel int, scl int, b double")
    got = {r.pixel: r.b for r in composite.seasonal_median(df, ["pixel"], ["b"]).collect()}
    assert got == {1: 15.0, 2: None, 3: None}


def test_winter_crosses_the_year(spark):
    days = [dt.datetime(2018, 11, 30, 23), dt.datetime(2018, 12, 1), dt.datetime(2019, 2, 28, 23, 59), dt.datetime(2019, 3, 1)]
    df = spark.createDataFrame([(d,) for d in days], "ts timestamp_ntz")
    held = {s.name: composite.in_season(df, s).count() for s in composite.SEASONS}
    assert held == {"MAM": 1, "JJA": 0, "SON": 0, "DJF": 2}


def test_indices_are_null_at_zero_and_grey_levels_clamp(spark):
    df = spark.createDataFrame([tuple([0.0] * 10)], ", ".join(f"{b} double" for b in indices.BANDS))
    row = df.select(*[c.alias(n) for n, c in indices.spectral_indices().items()]).first()
    assert row.ndvi is None and row.gli is None and row.evi2 == 0 and row.gvmi == pytest.approx(0.08 / 0.12)
    grey = spark.createDataFrame([(-5.0,), (0.5 / 31 * 10000,), (1.5 / 31 * 10000,), (20000.0,), (None,)], "v double").select(indices.grey_levels(F.col("v")).alias("g"))
    assert [r.g for r in grey.collect()] == [0, 0, 2, 31, None]


def test_fill_keeps_known_cells_and_ends(spark):
    grid = raster(spark, [[1, None, 3], [None, None, None], [None, None, 9]])
    once = matrix(neighbourhood.fill_round(grid, "v"))
    assert once[0] == [1, 2, 3] and once[1] == [1, pytest.approx(13 / 3), 6] and once[2] == [None, 9, 9]
    filled, left = neighbourhood.fill(grid, "v")
    assert left == [6, 1, 0] and matrix(filled)[2][2] == 9
    nothing, left = neighbourhood.fill(raster(spark, [[None, None]]), "v")
    assert left == [2, 2] and matrix(nothing) == [[None, None]]
    inside = neighbourhood.fill_inside(grid, "v", spark.createDataFrame([(0, 0), (0, 1)], "row int, col int"))
    assert matrix(inside)[0] == [1, 1, None] and matrix(inside)[2] == [None, None, None]


def test_texture_of_a_flat_window_and_of_stripes(spark):
    flat = neighbourhood.texture(raster(spark, [[4] * 8] * 8).withColumn("g", F.col("v").cast("int")), "g")
    assert {(r.con, r.hom) for r in flat.collect()} == {(0.0, 1.0), (None, None)}
    stripes = raster(spark, [[c % 2 for c in range(8)]] * 8).withColumn("g", F.col("v").cast("int"))
    centre = neighbourhood.texture(stripes, "g").where("row = 3 AND col = 3").first()
    assert centre.con == pytest.approx(0.75) and centre.hom == pytest.approx((3 * 0.5 + 1) / 4)
    assert neighbourhood.entropy(stripes, "g").where("row = 3 AND col = 3").first().ent > 0


def test_terrain_of_a_plane(spark):
    plane = raster(spark, [[10.0 * c for c in range(4)] for _ in range(4)])
    row = neighbourhood.terrain(plane, "v", 10.0, 10.0).where("row = 1 AND col = 1").first()
    assert row.slope == pytest.approx(45) and row.aspect == pytest.approx(3 * math.pi / 2)
    south = raster(spark, [[-10.0 * r] * 4 for r in range(4)])
    assert neighbourhood.terrain(south, "v", 10.0, 10.0).where("row = 1 AND col = 1").first().aspect == pytest.approx(math.pi)
    assert neighbourhood.terrain(plane, "v", 10.0, 10.0).where("row = 0").first().slope is None


def test_resampling_onto_the_same_grid_changes_nothing(spark):
    spec = GridSpec(0.0, 3.0, 1.0, 1.0, 3, 4)
    grid = raster(spark, [[1, 2, None, 4], [5, 6, 7, 8], [9, 10, 11, 12]])
    assert matrix(nearest(grid, spec, spec)) == matrix(grid)
    assert matrix(bilinear(grid, "v", spec, spec)) == matrix(grid)
    half = GridSpec(0.0, 3.0, 0.5, 0.5, 6, 8)
    assert bilinear(grid, "v", spec, half).where("row = 3 AND col = 3").first().v == pytest.approx(5 * 0.1875 + 6 * 0.5625 + 9 * 0.0625 + 10 * 0.1875 + 0.5)


def test_mosaic_prefers_the_old_and_stack_joins(spark):
    old, new = raster(spark, [[1, None]]), raster(spark, [[7, 8, 9]])
    assert matrix(mosaic(old, new, "v")) == [[1, 8, 9]]
    assert prefer_filled(old, None, "v") is old and matrix(prefer_filled(old, new, "v")) == [[7, 8, 9]]
    assert stack([old, new.withColumnRenamed("v", "w")]).count() == 3


def square(x, y, w, h):
    corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    return [(float(a), float(b)) for a, b in corners]


def test_holes_and_broken_rings(spark):
    spec = GridSpec(0.0, 6.0, 1.0, 1.0, 6, 6)
    shapes = [(1, [square(0, 0, 6, 6), square(2, 2, 2, 2)[::-1]]), (2, [[(0.0, 0.0), (1.0, 1.0)]]), (3, []), (4, None), (5, [square(4.6, 4.6, 9, 9)])]
    df = spark.createDataFrame(shapes, f"id int, rings {spatial.RINGS}")
    cells = spatial.zonal_cells(df, spec).collect()
    assert sum(r.id == 1 for r in cells) == 32 and {(r.row, r.col) for r in cells if r.id == 5} == {(0, 5)}
    assert {r.id for r in cells} == {1, 5}
    assert df.where("id = 1").select(spatial.ring_area(F.col("rings"))).first()[0] == pytest.approx(32)
    assert spatial.rasterise(df.withColumn("cls", F.col("id") * 10), spec, "cls").where("row = 0 AND col = 5").first().cls == 50


def test_distance_matches_brute_force(spark):
    rng = random.Random(2)
    values = [[1 if rng.random() < 0.06 else None for _ in range(17)] for _ in range(13)]
    sources = [(r, c) for r in range(13) for c in range(17) if values[r][c]]
    got = spatial.distance(raster(spark, values), "v", 10.0, 5.0).collect()
    for x in got:
        assert x.distance == pytest.approx(min(math.hypot((x.row - r) * 5, (x.col - c) * 10) for r, c in sources))
    assert spatial.distance(raster(spark, [[None, None]]), "v", 1.0, 1.0).where("distance IS NULL").count() == 2


def test_components_of_a_raster(spark):
    picture = ["##..#", ".#..#", "..#..", "#.###"]
    cells = spark.createDataFrame([(r, c) for r, line in enumerate(picture) for c, x in enumerate(line) if x == "#"], "row int, col int")
    labelled = spatial.raster_components(cells, 5)
    assert {r.component for r in labelled.collect()} == {0, 4, 12, 15}
    large = spatial.large_components(labelled, 100.0, 400.0)
    assert [(r.component, r.n_cells) for r in large.collect()] == [(12, 4)]
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_samples_are_disjoint_whole_and_repeatable(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") < 20, 1).otherwise(2))
    dealt = sampling.folds(df, "k", "id")
    sizes = {(r.fold, r.k): r.n for r in forest.fold_sizes(dealt, "k").collect()}
    assert sum(sizes.values()) == 1000 and {sizes[f, 1] for f in range(1, 6)} == {4} and {sizes[f, 2] for f in range(1, 6)} == {196}
    one = {r.id for r in sampling.stratified_fraction(df, "k", "id", 0.03).collect()}
    assert one == {r.id for r in sampling.stratified_fraction(df.repartition(7), "k", "id", 0.03).collect()} and len(one) == 1 + 29
    assert sampling.proportional_quota(df, "k", "id", 100).count() == 2 + 98
    assert sampling.proportional_quota(df, "k", "id", 5000).count() == 1000
    assert sampling.case_weights(df, "k").agg(F.avg("case_weight")).first()[0] == pytest.approx(1)


def test_purity_window_is_open_and_small_classes_stay(spark):
    df = spark.createDataFrame([(i, 1 if i < 60 else 2, float(i % 10), 5.0) for i in range(80)], "id int, k int, a double, b double")
    judged = purity.purity(df, "k", ["a", "b"])
    assert judged.where("k = 2 AND NOT pure").count() == 0
    for r in judged.where("k = 1").collect():
        assert r.pure == (r.t1 < r.z < r.t2)


def test_separability_limits():
    same = separability.jeffries_matusita(np.zeros(2), np.eye(2), np.zeros(2), np.eye(2))
    far = separability.jeffries_matusita(np.zeros(2), np.eye(2), np.full(2, 50.0), np.eye(2))
    assert same == 0 and far == pytest.approx(2)
    a, b = np.array([[2.0, 0.3], [0.3, 1.0]]), np.eye(2)
    assert separability.jeffries_matusita(np.zeros(2), a, np.ones(2), b) == pytest.approx(separability.jeffries_matusita(np.ones(2), b, np.zeros(2), a))
    singular = separability.full_matrix([1.0, 1.0, 1.0], 2)
    assert np.linalg.det(singular) > 0
    assert math.isnan(separability.jeffries_matusita(np.zeros(2), np.zeros((2, 2)), np.zeros(2), np.zeros((2, 2))))


def test_auc_with_ties_and_pruning(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 2.0), (2, 3.0), (2, None)], "k int, x double")
    assert selection.best_auc(df, "k", ["x"]).first().auc == pytest.approx(3.5 / 4)
    tau = spark.createDataFrame([("a", "b", 0.95), ("b", "a", 0.95), ("a", "c", 0.5), ("c", "a", 0.5), ("b", "c", 0.1), ("c", "b", 0.1)], "a string, b string, tau double")
    assert selection.prune(tau, ["a", "b", "c"]) == ["b", "c"] and selection.prune(tau, ["a", "b", "c"], 0.99) == ["a", "b", "c"]


def test_boruta_tells_signal_from_noise(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, float(i % 2 + rng.normal(0, 0.2)), float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k int, good double, noise double")
    state = selection.boruta(df, "k", ["good", "noise"], "id", max_runs=10, trees=10)
    assert state["good"] == "confirmed"
    assert selection.boruta(df, "k", ["good"], "id") == {"good": "confirmed"}


def test_cascade_follows_the_hierarchy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        l1 = (1, 2, 3)[i % 3]
        l2 = l1 * 10 + 1 + (i // 3 % 2 if l1 < 3 else 0)
        rows.append((i, l1, l2, l1 + float(rng.normal(0, 0.05)), l2 % 10 + float(rng.normal(0, 0.05))))
    df = spark.createDataFrame(rows, "id int, l1 int, l2 int, a double, b double")
    one = forest.final_model(df, "l1", ["a", "b"], "id", 1, 2, trees=8)
    two = {k: forest.final_model(df.where(f"l1 = {k}"), "l2", ["a", "b"], "id", 1, 2, trees=8) for k in (1, 2)}
    holes = spark.createDataFrame([(900, None, 1.0), (901, 3.0, None)], "id int, a double, b double")
    out = forest.cascade(df.select("id", "a", "b").unionByName(holes), one, two).cache()
    assert out.columns == ["id", "a", "b", "cod_l1", "cod_l2"] and out.count() == 242
    assert out.where("id < 900 AND cod_l2 DIV 10 <> cod_l1").count() == 0
    assert out.where("id >= 900 AND (cod_l1 IS NOT NULL OR cod_l2 IS NOT NULL)").count() == 0
    hits = out.join(df.select("id", "l2"), "id").where("cod_l2 = l2").count()
    assert hits > 220
    with pytest.raises(ValueError):
        forest.check_available(df.drop("b"), {"L1": one})
    assert forest.check_rare(df, "l2", 5) == [] and forest.mtry_grid(100) == [5, 10, 20, 33]
    with pytest.raises(ValueError):
        forest.check_rare(df.where("id < 30"), "l2", 8)


def test_training_pixels_lie_inside_their_own_area(spark):
    rng = np.random.default_rng(5)
    train = spark.createDataFrame([(i, i % 3, *map(float, rng.normal(size=3))) for i in range(150)], "id int, k int, a double, b double, c double")
    space = applicability.training_space(train, ["a", "b", "c"], [1.0, 1.0, 0.0], "k", "id", most=90)
    assert len(space.train) == 90
    space = applicability.fit_space(train, space)
    new = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 90.0, 0.0, 0.0), (3, None, 0.0, 0.0), (4, 0.0, 0.0, 1e9)], "id int, a double, b double, c double")
    got = {r.id: (r.di, r.aoa) for r in applicability.dissimilarity(new, space).collect()}
    assert got[1][1] == 1 and got[2][1] == 0 and got[3] == (None, None) and got[4][1] == 1
    assert applicability.fit_space(train, space, "max").threshold >= space.threshold
    assert applicability.shares(applicability.dissimilarity(new, space)).first().pct_inside == 66.67
    assert applicability.weights_of({"a": 2.0, "b": -1.0}, ["a", "b", "x"]) == [2.0, 0.0, 0.0]


def test_assertions_speak_up(spark):
    table = legend.legend(spark)
    checks.require_hierarchy(table)
    checks.require_empty(table.where("classe = 0"), "none")
    for broken in (lambda: checks.require_hierarchy(table.limit(5)), lambda: checks.require_empty(table, "rows"), lambda: checks.require_same_rows(table, table.limit(1)), lambda: checks.require_columns(table, ["x"]), lambda: checks.require_values(table, "cod_l2", [99])):
        with pytest.raises(ValueError):
            broken()
    a, b = raster(spark, [[1, 2]]), raster(spark, [[1, 2.5]])
    checks.require_overlap(a, a, "v", 1e-6)
    with pytest.raises(ValueError):
        checks.require_overlap(a, b, "v", 1e-4)
    with pytest.raises(Exception, match="class without a group"):
        spark.createDataFrame([(99,)], "k int").select(legend.aggregate_classes(F.col("k"))).collect()


def wkb_polygon(rings):
    body = b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in rings)
    return struct.pack("<BII", 1, 3, len(rings)) + body


def test_geopackage_round_trip(spark, tmp_path):
    ring = square(1.0, 1.0, 2.0, 3.0)
    file = tmp_path / "park.gpkg"
    db = sqlite3.connect(file)
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('landuse', 'geom')")
    db.execute("CREATE TABLE landuse (fid INTEGER PRIMARY KEY, geom BLOB, CLASSE INTEGER)")
    header = b"GP\x00\x03" + struct.pack("<i", 32632) + struct.pack("<4d", 1, 3, 1, 4)
    multi = struct.pack("<BII", 1, 6, 1) + wkb_polygon([ring])
    db.executemany("INSERT INTO landuse VALUES (?, ?, ?)", [(1, header + wkb_polygon([ring]), 5111), (2, None, 213), (3, header + multi, 224)])
    db.commit()
    db.close()
    rows = vectors.with_rings(vectors.read_geopackage(spark, str(file))).orderBy("fid").collect()
    assert [len(r.rings) for r in rows] == [1, 0, 1] and [(p.x, p.y) for p in rows[0].rings[0]] == ring == [(p.x, p.y) for p in rows[2].rings[0]]
    assert '"CLASSE": 5111' in rows[0].attributes and rows[0].layer == "landuse"


def test_scene_archive(spark, tmp_path):
    for name in ("S2A_MSIL2A_20190401T101031_N0211_R022_T32TLQ_20190401T121951.zip", "S2B_MSIL2A_20190402T101031_N0211_R022_T32TLR_20190402T121951.SAFE", "notes.txt"):
        (tmp_path / name).touch()
    found = scenes.scene_table(spark, str(tmp_path), f"{files.scratch(spark)}/scenes")
    assert {(r.format, r.tile) for r in found.collect()} == {("zip", "T32TLQ"), ("safe", "T32TLR")}
    assert found.agg(F.min("acquired")).first()[0] == dt.datetime(2019, 4, 1, 10, 10, 31)
    scenes.check_tiles(found, ["T32TLQ"])
    with pytest.raises(ValueError):
        scenes.check_tiles(found)


def test_rasters_models_and_guards(spark):
    grid = raster(spark, [[1.4, None], [2.6, 3.0]])
    path = f"{files.scratch(spark)}/r"
    files.write_raster(grid, path, {"v": "smallint"}, block_rows=1)
    assert matrix(files.read_raster(spark, path, ["v"])) == [[1, None], [2, 3]] and files.read_block(spark, path, 1, 1).count() == 2
    with pytest.raises(Exception, match="already exists"):
        files.write_raster(grid, path, {"v": "smallint"}, overwrite=False)
    files.write_parameters(spark, {"threshold": 0.5, "mean": 2.0}, f"{path}-p")
    assert files.read_parameters(spark, f"{path}-p") == {"threshold": 0.5, "mean": 2.0}
    assert files.read_if_there(spark, f"{path}-none", required=False) is None
    with pytest.raises(FileNotFoundError):
        files.read_if_there(spark, f"{path}-none")
    df = spark.createDataFrame([(i, i % 2, float(i % 2), float(i)) for i in range(40)], "id int, k int, a double, b double")
    model = forest.final_model(df, "k", ["a", "b"], "id", 1, 1, trees=3)
    files.save_model(model, f"{path}-m")
    again = files.load_model(f"{path}-m")
    assert forest.predictors_of(again) == ["a", "b"]
    assert forest.export_stack(df.withColumns({"row": F.lit(1), "col": F.col("id")}), again).columns == ["row", "col", "a", "b"]
    assert [r["rank"] for r in forest.importance(spark, again).orderBy("rank").collect()] == [1, 2]


def test_work_tables_can_be_cleared(spark):
    table = session.work_table(spark.range(3), "three")
    assert table.count() == 3 and session.clear_work_tables(spark) > 0
    assert session.WRITTEN.get() == [] and session.clear_work_tables(spark) == 0


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    rows = [(p, dt.datetime(2024, 1, 1 + d), (d + p) % 12) for p in range(3) for d in range(20)]
    spark.createDataFrame(rows, "pixel int, ts timestamp_ntz, scl int").write.parquet(str(tmp_path / "in"))
    stream = clear_looks(spark.readStream.schema("pixel int, ts timestamp_ntz, scl int").parquet(str(tmp_path / "in")))
    job = stream.writeStream.format("memory").queryName("looks").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    job.awaitTermination(120)
    got = spark.table("looks").agg(F.sum("n_obs"), F.sum("n_clear")).first()
    assert tuple(got) == (60, sum(4 <= s <= 6 for _, _, s in rows))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.floats(0, 400)), min_size=1, max_size=12, unique_by=lambda x: x[0]), st.integers(1, 3))
def test_row_minima(points, rows):
    height = np.full((rows, 31), np.inf)
    for c, h in points:
        height[:, c] = h
    height[0, 5] = 1.0
    got = spatial.row_minima(height, 2.0)
    for r in range(rows):
        held = [(c, height[r, c]) for c in range(31) if np.isfinite(height[r, c])]
        assert got[r] == pytest.approx([min((2 * (x - c)) ** 2 + h for c, h in held) for x in range(31)])
    assert np.isinf(spatial.row_minima(np.full((2, 4), np.inf), 1.0)).all()


def test_neighbours_are_told_by_coordinates(spark):
    """A plane and a texture without column 5: beside the gap there is no neighbour."""
    plane = raster(spark, [[10.0 * c for c in range(9)] for _ in range(6)]).where("col <> 5")
    slope = {(r.row, r.col): r.slope for r in neighbourhood.terrain(plane, "v", 10.0, 10.0).collect()}
    assert all(slope[r, c] is None for r in range(6) for c in (4, 6)) and slope[2, 2] == pytest.approx(45)
    grey = raster(spark, [[(r + c) % 3 for c in range(14)] for r in range(9)]).withColumn("g", F.col("v").cast("int")).where("col <> 7")
    found = {(r.row, r.col): r.con for r in neighbourhood.texture(grey, "g").collect()}
    assert all(found[4, c] is None for c in range(4, 11) if c != 7) and found[4, 3] is not None


def test_entropy_matches_counting(spark):
    rng = random.Random(3)
    values = [[rng.randrange(3) for _ in range(9)] for _ in range(8)]
    found = neighbourhood.entropy(raster(spark, values).withColumn("g", F.col("v").cast("int")), "g").where("ent IS NOT NULL").collect()
    assert found
    for x in found:
        total = 0.0
        for dr, dc in neighbourhood.SHIFTS:
            codes = [(values[r][c], values[r + dr][c + dc]) for r in range(x.row - 2, x.row + 3) for c in range(x.col - 2, x.col + 3)]
            total -= sum(codes.count(k) / 25 * math.log(codes.count(k) / 25) for k in set(codes))
        assert x.ent == pytest.approx(total / 4)


def test_quantiles_are_exact(spark):
    rng = random.Random(4)
    values = [round(rng.expovariate(0.1), 2) for _ in range(700)] + [3.5] * 300
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    shares = (0.0, 0.1, 0.5, 0.95, 1.0)
    expected = np.percentile(values, [100 * s for s in shares])
    for few in (5, 10_000):
        assert grid.exact_quantiles(df, "x", shares, buckets=16, few=few) == pytest.approx(expected)
    assert grid.exact_quantiles(df.limit(0), "x", (0.5,)) == [None]


def test_student_quantiles():
    known = {1: 12.706205, 2: 4.302653, 3: 3.182446, 4: 2.776445, 9: 2.262157, 10: 2.228139, 30: 2.042272, 120: 1.979930}
    for df, t in known.items():
        assert metrics.t_quantile(df) == pytest.approx(t, abs=2e-6)


def test_projection_of_known_places(spark):
    df = spark.createDataFrame([(9.0, 45.0), (9.0, 0.0), (12.0, 45.0)], "lon double, lat double")
    x, y = projection.to_utm(F.col("lon"), F.col("lat"), 32632)
    got = [tuple(r) for r in df.select(x, y).collect()]
    assert got[0] == pytest.approx((500_000, 4_982_950.400), abs=0.001) and got[1] == pytest.approx((500_000, 0), abs=1e-6)
    west = df.select(*projection.to_utm(F.col("lon"), F.col("lat"), 32633)).collect()[2]
    assert west[0] == pytest.approx(1_000_000 - got[2][0], abs=1e-6) and west[1] == pytest.approx(got[2][1], abs=1e-6)
    with pytest.raises(ValueError):
        projection.zone_of(3035)
    spec, geographic = GridSpec(499_990.0, 4_983_000.0, 10.0, 10.0, 8, 2), GridSpec(8.9999, 45.0004, 0.0001, 0.0001, 6, 2, 4326)
    layer = raster(spark, [[10 * r + c for c in range(2)] for r in range(8)])
    assert nearest(layer, spec, geographic).where("v IS NOT NULL").count() > 0


def shapefile(kind, records):
    body = b""
    for k, content in enumerate(records, 1):
        body += struct.pack(">2i", k, len(content) // 2) + content
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(body) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8) + body


def dbf(fields, rows):
    size = 1 + sum(n for _, _, n, _ in fields)
    head = b"".join(name.encode().ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([n, d]) + bytes(14) for name, kind, n, d in fields)
    lines = b"".join(b" " + b"".join(str(v).encode("utf-8").ljust(n)[:n] for v, (_, _, n, _) in zip(row, fields, strict=True)) for row in rows)
    return struct.pack("<B3BIHH20x", 3, 124, 1, 1, len(rows), 33 + len(head), size) + head + b"\r" + lines


def test_shapefiles(spark, tmp_path):
    outer, hole, other = square(0, 0, 6, 6)[::-1], square(2, 2, 2, 2), square(10, 10, 1, 1)[::-1]
    points = [*outer, *hole, *other]
    polygon = struct.pack("<i4d2i3i", 5, 0, 0, 11, 11, 3, len(points), 0, 5, 10) + b"".join(struct.pack("<2d", *p) for p in points)
    (tmp_path / "park.shp").write_bytes(shapefile(5, [polygon, struct.pack("<i", 0)]))
    (tmp_path / "park.dbf").write_bytes(dbf([("CLASSE", "N", 5, 0), ("NAME", "C", 8, 0), ("HA", "F", 7, 2)], [(511, "Pò", "1.25"), ("", "x", "***")]))
    (tmp_path / "park.cpg").write_text("UTF-8")
    (tmp_path / "wells.shp").write_bytes(shapefile(1, [struct.pack("<i2d", 1, 3.0, 4.0)]))
    rows = {(r.layer, r.fid): r for r in vectors.with_rings(vectors.read_shapefile(spark, str(tmp_path))).collect()}
    park = rows["park", 1]
    assert [len(r) for r in park.rings] == [5, 5, 5] and spark.createDataFrame([park], "file string, layer string, fid long, geom binary, attributes string, rings " + spatial.RINGS).select(spatial.ring_area(F.col("rings"))).first()[0] == pytest.approx(33)
    assert json.loads(park.attributes) == {"CLASSE": 511, "NAME": "Pò", "HA": 1.25} and json.loads(rows["park", 2].attributes) == {"CLASSE": None, "NAME": "x", "HA": None}
    assert rows["park", 2].geom is None and rows["park", 2].rings == [] and rows["wells", 1].geom == struct.pack("<BI2d", 1, 1, 3.0, 4.0)


def test_selection_summary_per_model(spark):
    rng = np.random.default_rng(7)
    rows = [(i, 1 + i % 2, 10 * (1 + i % 2) + i // 2 % 2, float(i % 2 + rng.normal(0, 0.1)), float(i // 2 % 2 + rng.normal(0, 0.1)), float(rng.normal())) for i in range(160)]
    df = spark.createDataFrame(rows, "id int, cod_l1 int, cod_l2 int, a double, b double, noise double")
    found = selection.select_predictors(df, ["a", "b", "noise"], "id", least_auc=0.6, max_runs=4, trees=5)
    assert set(found) == {"L1", "L2_1", "L2_2"} and "a" in found["L1"]["predictors"] and "b" in found["L2_1"]["predictors"]
    table = selection.selection_table(spark, found)
    assert table.columns == ["model", "predictor", "place"] and table.where("model = 'L1'").count() == len(found["L1"]["predictors"])


def test_importance_is_recomputed_where_none_is_stored(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, i % 2, float(i % 2 + rng.normal(0, 0.1)), float(rng.normal())) for i in range(80)], "id int, k int, good double, noise double")
    weights = applicability.importance_weights(df, ["good", "noise"], "k", "id", f"{files.scratch(spark)}/none")
    assert weights[0] > weights[1] >= 0


def test_texture_names():
    assert neighbourhood.missing_textures(["GLCM_CON_MAM_v3", "GLCM_HOM_MAM_v3"], ["MAM"]) == ["GLCM_ENT_MAM_v3"]


def test_scopes_clear_their_own_tables_only(spark):
    outer = session.work_table(spark.range(2), "outer")
    with session.work_scope(spark) as paths:
        inner = session.work_table(spark.range(3), "inner")
        assert inner.count() == 3 and len(paths) == 1
        held = paths[0]
    assert paths == [] and not files.path_exists(spark, held) and outer.count() == 2
