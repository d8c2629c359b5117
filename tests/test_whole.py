"""Queries over the whole raster against brute force, on a raster of more rows than the windows with SQL."""

from __future__ import annotations

import inspect
from collections import Counter

import numpy as np
import pytest

from pixelmill.operators import forest, purity, sampling, selection, spatial
from pixelmill.operators.components import components
from pixelmill.plans import fixtures as fx
from pixelmill.plans import registry

SF = "/root/testdata/sf0.01"


def brute_components(cells):
    parent = {c: c for c in cells}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r, c in cells:
        for near in ((r + 1, c), (r, c + 1)):
            if near in parent:
                low, high = sorted((find((r, c)), find(near)))
                parent[high] = low
    return {(r, c): find((r, c))[0] * fx.N_COLS + find((r, c))[1] for r, c in cells}


def test_components_of_the_whole_raster(spark):
    grid = fx.full_grid(spark, SF).collect()
    expected = brute_components({(r.row, r.col) for r in grid if r.v > 150_000})
    assert max(r for r, _ in expected) > 40
    assert {(r.row, r.col): r.component for r in registry.queries()["g17_components_whole"](spark, SF).collect()} == expected
    sizes = Counter(brute_components({(r.row, r.col) for r in grid if r.v > 250_000}).values())
    got = {r.component: (r.n_cells, r.area) for r in registry.queries()["p26_large_components_whole"](spark, SF).collect()}
    assert got == {k: (n, 100.0 * n) for k, n in sizes.items() if n >= 5}


def comb(rows: int) -> set:
    """Teeth of three columns that lean on each other by turns: one path up and down, with tongues aside."""
    cells = {(r, c) for c in range(0, 40, 4) for r in range(rows)}
    cells |= {(0 if c % 8 else rows - 1, c + i) for c in range(0, 36, 4) for i in (1, 2, 3)}
    return cells | {(r, c + 1) for c in range(0, 40, 4) for r in range(2, rows - 2, 3)}


@pytest.mark.parametrize("block", [7, 256])
def test_components_of_long_paths_and_of_blocks(spark, block):
    rng = np.random.default_rng(block)
    spotted = {(r, c) for r in range(-9, 120) for c in range(fx.N_COLS) if rng.random() < 0.6}
    for cells in (comb(300), spotted):
        table = spark.createDataFrame([*cells, *list(cells)[:5]], "row int, col int")
        got = {(r.row, r.col): r.component for r in spatial.raster_components(table, fx.N_COLS, block).collect()}
        assert got == brute_components(cells)
    lost = spatial.raster_components(spark.createDataFrame([(3, None), (None, None), (3, 4)], "row int, col int"), fx.N_COLS, block)
    assert {(r.row, r.col, r.component) for r in lost.collect()} == {(3, None, None), (None, None, None), (3, 4, 304)}
    assert spatial.raster_components(spark.createDataFrame([], "row int, col int"), fx.N_COLS, block).count() == 0


def test_components_settle_where_labels_would_travel(spark):
    """A tree of stars whose centres are linked from one to the next in an order that falls by turns."""
    n = 400
    ids = np.random.default_rng(1).permutation(n * 4).reshape(n, 4).tolist()
    links = [(x[0], y) for x in ids for y in x[1:]] + [(x[3], y[2]) for x, y in zip(ids, ids[1:], strict=False)] + [(9000, 9001), (9002, 9001), (9003, 9003)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(links, "a long, b long"), max_rounds=12).collect()}
    assert got == dict.fromkeys(range(n * 4), 0) | {9000: 9000, 9001: 9000, 9002: 9000}


def test_filling_inside_a_mask_of_the_whole_raster(spark):
    grid = {(r.row, r.col): r.v for r in fx.grid(spark, SF).collect()}
    now = {(r, c): v for (r, c), v in grid.items() if r % 40 < 10 and c < 40}
    assert max(r for r, _ in now) > 40
    while True:
        near = {k: [now[x] for i in (-1, 0, 1) for j in (-1, 0, 1) if now.get(x := (k[0] + i, k[1] + j)) is not None] for k, v in now.items() if v is None}
        filled = {k: sum(v) / len(v) for k, v in near.items() if v}
        if not filled:
            break
        now |= filled
    got = {(r.row, r.col): r.v for r in registry.queries()["g10_fill_inside_whole"](spark, SF).collect()}
    assert got.keys() == grid.keys()
    assert {k for k, v in got.items() if v is not None} == {k for k, v in now.items() if v is not None}
    assert all(got[k] == pytest.approx(v, abs=1e-3) for k, v in now.items() if v is not None)


@pytest.mark.parametrize("name", ["m11_tuning", "m12_forest_out_of_fold", "m15_importance", "m16_cascade"])
def test_forests_have_the_trees_of_the_reference(spark, monkeypatch, name):
    grow, asked = forest.forest, []

    def small(*args, **options):
        bound = inspect.signature(grow).bind(*args, **options)
        bound.apply_defaults()
        asked.append((bound.arguments["trees"], list(bound.arguments["predictors"])))
        bound.arguments["trees"] = 1
        return grow(*bound.args, **bound.kwargs)

    monkeypatch.setattr(forest, "forest", small)
    registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert asked and all(x == (50 if name == "m11_tuning" else 200, fx.FEATURES) for x in asked)


def test_selection_has_the_settings_of_the_reference(spark, monkeypatch):
    asked = {}

    def recorded(name, result):
        f = getattr(selection, name)

        def run(*args, **options):
            bound = inspect.signature(f).bind(*args, **options)
            bound.apply_defaults()
            asked[name] = bound.arguments
            return result

        monkeypatch.setattr(selection, name, run)

    recorded("boruta", {"f0": "confirmed"})
    registry.queries()["m5_boruta"](spark, "/root/testdata/sf0.001")
    assert [asked["boruta"][k] for k in ("max_runs", "per_class", "trees", "predictors")] == [60, 2000, 50, fx.FEATURES]
    recorded("kendall", spark.createDataFrame([], "a string, b string, tau double"))
    registry.queries()["m7_prune"](spark, "/root/testdata/sf0.001")
    assert asked["kendall"]["most"] == 3000 and set(fx.FEATURES) < set(asked["kendall"]["predictors"])


def test_all_predictors_against_brute_force(spark):
    rows = fx.pixels(spark, "/root/testdata/sf0.001").collect()
    x, k = np.array([[r[f] for f in fx.FEATURES] for r in rows]), np.array([r.cod_l1 for r in rows])
    auc = {r.predictor: r.auc for r in registry.queries()["m4_auc_whole"](spark, "/root/testdata/sf0.001").collect()}
    assert sorted(auc) == fx.FEATURES
    for i, f in enumerate(fx.FEATURES):
        wins = np.sign(x[:, None, i] - x[None, :, i]) / 2 + 0.5
        each = [wins[np.ix_(k == c, k != c)].mean() for c in set(k.tolist())]
        assert auc[f] == pytest.approx(max(max(a, 1 - a) for a in each))
    assert len(rows) <= 3000
    s = np.sign(x[:, None] - x[None]).reshape(-1, len(fx.FEATURES))
    m = s.T @ s
    tau = {(r.a, r.b): r.tau for r in registry.queries()["m6_kendall_whole"](spark, "/root/testdata/sf0.001").collect()}
    assert len(tau) == 64 and all(tau[a, b] == pytest.approx(m[i, j] / np.sqrt(m[i, i] * m[j, j])) for i, a in enumerate(fx.FEATURES) for j, b in enumerate(fx.FEATURES))


def test_aggregates_of_classes_are_broadcast_only_under_the_threshold(spark):
    """Many classes: with the session's threshold at 0 nothing is broadcast, and no value changes."""
    df = spark.range(2000).selectExpr("id", "if(id % 40 = 7, null, id % 400) AS code", "CAST(id * 7919 % 1013 AS double) AS x")
    steps = {
        "purity": lambda: purity.purity(df, "code", ["x"], least_rows=3),
        "split": lambda: sampling.train_split(df, "code", "id"),
        "quota": lambda: sampling.proportional_quota(df, "code", "id", most=900),
        "weights": lambda: sampling.case_weights(df, "code"),
        "auc": lambda: selection.class_auc(df, "code", ["x"]),
    }
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def values(rows):  # sums of doubles differ in the last digits
        return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)

    for name, step in steps.items():
        small = values(step().collect())
        try:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            large = step()
            assert values(large.collect()) == small and small, name
            assert "Broadcast" not in large._jdf.queryExecution().executedPlan().toString(), name
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
