"""Forests grown in parts, and runs of the shadow test that go at once."""

from __future__ import annotations

import threading
import time

import numpy as np
import pytest

from pixelmill.operators import forest, selection
from pixelmill.session import work_scope


def table(spark, n: int):
    rng = np.random.default_rng(4)
    x = rng.random((n, 2))
    rows = [(i, float(a), float(b), int(1 + (a > 0.5)), int(10 * (1 + (a > 0.5)) + (b > 0.5))) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, l1 int, l2 int")


@pytest.fixture
def fitted(monkeypatch):
    """Trees of every fit."""
    trees, fit = [], forest.RandomForestClassifier.fit

    def watched(self, df, *args):
        trees.append(self.getNumTrees())
        return fit(self, df, *args)

    monkeypatch.setattr(forest.RandomForestClassifier, "fit", watched)
    monkeypatch.setattr(forest, "ROWS_A_PART", 400)
    return trees


def test_no_fit_holds_more_trees_than_a_part(spark, fitted):
    df = table(spark, 200)
    found = forest.forest_importance(df, "l1", ["a", "b"], "id", 1, trees=10).orderBy("rank").collect()
    assert sum(fitted) == 10 and max(fitted) * 160 <= 400
    assert [r.predictor for r in found] == ["a", "b"] and sum(r.importance for r in found) == pytest.approx(1) and found[0].importance > 0.5


def test_votes_of_parts_add_up(spark, fitted):
    df = table(spark, 150)
    with work_scope(spark) as written:
        judged = forest.out_of_fold(df, "l1", ["a", "b"], "id", 1, 2, k=3, trees=9)
        rows = judged.collect()
        assert sum(fitted) == 27 and max(fitted) * 80 <= 400 and any("votes-" in path for path in written)
    assert len({r.id for r in rows}) == len(rows) == 150 and {r.fold for r in rows} == {1, 2, 3}
    assert np.mean([r.true == r.predicted for r in rows]) > 0.85


def test_cascade_by_parts(spark, fitted):
    df = table(spark, 150)
    holes = spark.createDataFrame([(900, None, 0.2)], "id long, a double, b double")
    found = forest.cascade_by_parts(df.select("id", "a", "b").unionByName(holes), df, ("l1", "l2"), ["a", "b"], "id", 1, 2, (1, 2), trees=8)
    got, true = {r.id: (r.cod_l1, r.cod_l2) for r in found.collect()}, {r.id: (r.l1, r.l2) for r in df.collect()}
    assert got.pop(900) == (None, None) and got.keys() == true.keys() and sum(fitted) == 24
    assert all(lower // 10 == upper for upper, lower in got.values()) and np.mean([got[i] == true[i] for i in got]) > 0.8


def test_parts_judge_as_one_forest(spark, monkeypatch):
    """One part is Spark's forest: its votes give the class that the model itself predicts."""
    df = table(spark, 120)
    training = forest.training_rows(df, "l2", ["a", "b"], "id", 0.8, 50)
    got = {r.id: r.found for r in forest.judged_by_parts(df.select("id", "a", "b"), training, "l2", ["a", "b"], 1, 2, "found", trees=7).collect()}
    model = forest.final_model(df, "l2", ["a", "b"], "id", 1, 2, trees=7)
    assert got == {r.id: int(r.predicted) for r in model.transform(df).collect()}


@pytest.mark.parametrize("at_once", [1, 4, 6])
def test_runs_at_once_settle_as_runs_in_turn(spark, monkeypatch, at_once):
    """"weak" loses every run and is rejected in the tenth or so; "even" wins every other run and stays open to the end."""
    asked, busy, most, lock = [], [0], [0], threading.Lock()

    def importance(_, columns, trees, seed):
        with lock:
            busy[0] += 1
            most[0] = max(most[0], busy[0])
            asked.append((seed - 50, "weak" in columns))
        time.sleep(0.2)
        with lock:
            busy[0] -= 1
        run = seed - 50
        return {c: {"weak": 0.1, "even": 0.2 + 0.2 * (run % 2), "strong": 0.9}.get(c, 0.3 if c == "shadow_weak" or run < 3 else 0.25) for c in columns}

    monkeypatch.setattr(selection, "RUNS_AT_ONCE", at_once)
    monkeypatch.setattr(selection, "with_shadows", lambda sample, *_: sample)
    monkeypatch.setattr(selection, "_importance", importance)
    df = spark.range(40).selectExpr("id", "id % 2 AS k", "id * 1.0D AS weak", "id * 2.0D AS even", "id * 3.0D AS strong")
    assert selection.boruta(df, "k", ["weak", "even", "strong"], "id", max_runs=21) == {"weak": "rejected", "even": "confirmed", "strong": "confirmed"}
    last = dict(sorted(asked, key=lambda x: not x[1]))  # of a run that was repeated, the one without "weak"
    assert [run for run, weak in sorted(last.items()) if weak] == list(range(1, 10)) and set(last) == set(range(1, 22))
    assert most[0] == at_once
