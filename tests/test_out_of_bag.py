"""Out-of-bag votes against a plain count over the trees' own predictions."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from pixelmill.operators import forest


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(k), float(k + rng.normal(0, 0.8)), float(rng.normal())) for i, k in enumerate(rng.integers(1, 4, 120))]
    return spark.createDataFrame(rows, "id long, k int, a double, b double")


def test_draws_are_poisson(spark):
    counts = Counter(r.n for r in spark.range(20_000).select(forest.drawn("id", 3).alias("n")).collect())
    for n, share in ((0, 0.3679), (1, 0.3679), (2, 0.1839), (3, 0.0613)):
        assert counts[n] / 20_000 == pytest.approx(share, abs=0.015)
    both = spark.range(5_000).select(forest.drawn("id", 1).alias("x"), forest.drawn("id", 2).alias("y")).toPandas()
    assert abs(both.corr().iloc[0, 1]) < 0.05


@pytest.mark.parametrize(("trees", "per_bag"), [(6, 1), (7, 3)])
def test_votes_equal_a_plain_count(table, trees, per_bag):
    models = forest.bagged_forests(table, "k", ["a", "b"], "id", mtry=1, node=2, trees=trees, per_bag=per_bag)
    assert sum(m.stages[1].getNumTrees for m in models) == trees
    got = {r.id: (r.true, r.predicted, r.n_votes) for r in forest.out_of_bag(table, models, "k", "id").collect()}
    votes = {}
    for bag, model in enumerate(models):
        never = model.stages[0].transform(table.where(forest.drawn("id", bag) == 0)).collect()
        for tree in model.stages[1].trees:
            for r in never:
                votes.setdefault((r.id, r.k), []).append(int(tree.predict(r.features)))
    expected = {}
    for (i, k), cast in votes.items():
        counts = Counter(cast)
        expected[i] = (k, min(counts, key=lambda c: (-counts[c], c)), len(cast))
    assert got == expected and 60 < len(got) < 120


def test_error_of_a_setting(table):
    tuned = forest.tune(table, "k", ["a", "b"], "id", share=1.0, nodes=(2,), trees=40).collect()
    assert [(r.mtry, r.min_node_size) for r in tuned] == [(1, 2)]
    assert 0 < tuned[0].error < 0.5  # chance would be two thirds
