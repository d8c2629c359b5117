"""The index of balls gives the distances of brute force, from few of them where pixels have structure."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelmill.operators.applicability import BallIndex


def brute(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.array([np.sqrt(((points - q) ** 2).sum(axis=1)).min() for q in queries])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 5), st.integers(0, 10_000), st.booleans())
def test_any_points(n, p, seed, ties):
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 3, (n, p)).astype(float) if ties else rng.normal(size=(n, p)) * 10.0 ** rng.integers(-3, 4)
    queries = np.concatenate([points[: n // 2], points[: n // 3] + 1e-9, rng.normal(size=(20, p)) * 5])
    assert BallIndex.of(points).nearest(queries)[0] == pytest.approx(brute(queries, points), abs=2e-6 * (1 + np.abs(points).max()))


@pytest.mark.parametrize("kind", ["classes", "plane"])
def test_few_distances(kind):
    rng = np.random.default_rng(7)
    if kind == "classes":
        land = rng.normal(size=(40, 20))
        points, queries = (land[rng.integers(0, 40, n)] + rng.normal(size=(n, 20)) * 0.05 for n in (15_000, 800))
    else:  # 68 predictors that follow from three
        load = rng.normal(size=(3, 68))
        points, queries = (rng.normal(size=(n, 3)) @ load + rng.normal(size=(n, 68)) * 0.01 for n in (15_000, 800))
    found, used = BallIndex.of(points).nearest(queries)
    assert found == pytest.approx(brute(queries, points), rel=1e-6)
    assert used < len(points) * len(queries) / 10


def test_no_points():
    found, used = BallIndex.of(np.zeros((1, 2))).nearest(np.zeros((0, 2)))
    assert len(found) == 0 and used == 0
