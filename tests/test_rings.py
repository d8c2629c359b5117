from __future__ import annotations

import time
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelmill.functions import rings as functions_rings
from pixelmill.functions.rings import RINGS, buffered, uncrossed, uncrossed_rings, widened
from pixelmill.operators import spatial


def signed(ring) -> float:
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False)) / 2


def even_odd_area(rings) -> Fraction:
    """By slabs between all abscissas where a segment ends or two cross, in exact numbers."""
    segments = [tuple(sorted((tuple(map(Fraction, a)), tuple(map(Fraction, b))))) for ring in rings for a, b in zip(ring, ring[1:], strict=False) if a[0] != b[0]]
    line = [((b[1] - a[1]) / (b[0] - a[0]), a) for a, b in segments]
    at = lambda k, x: line[k][1][1] + line[k][0] * (x - line[k][1][0])
    xs = {p[0] for s in segments for p in s}
    for i in range(len(segments)):
        for j in range(i):
            if line[i][0] != line[j][0]:
                x = (at(j, Fraction(0)) - at(i, Fraction(0))) / (line[i][0] - line[j][0])
                xs.add(x)
    xs, area = sorted(xs), Fraction(0)
    for a, b in zip(xs, xs[1:], strict=False):
        over = [k for k, (p, q) in enumerate(segments) if p[0] <= a and q[0] >= b]
        middle = sorted(over, key=lambda k: at(k, (a + b) / 2))
        for lower, upper in zip(middle[::2], middle[1::2], strict=True):
            area += (b - a) * (at(upper, (a + b) / 2) - at(lower, (a + b) / 2))
    return area


def crossings(rings) -> int:
    segments = [(np.array(a), np.array(b)) for ring in rings for a, b in zip(ring, ring[1:], strict=False)]
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    n = 0
    for i, (a, b) in enumerate(segments):
        for c, d in segments[:i]:
            t = [turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)]
            n += min(map(abs, t)) > 1e-7 and t[0] * t[1] < 0 and t[2] * t[3] < 0
    return n


CLOSED = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=3, max_size=9).map(lambda p: [*p, p[0]])


@settings(max_examples=300, deadline=None)
@given(st.lists(CLOSED, min_size=1, max_size=3))
def test_any_rings_keep_their_area(rings):
    found = uncrossed(rings)
    assert all(r[0] == r[-1] and len(r) >= 4 for r in found)
    assert sum(map(signed, found)) == pytest.approx(float(even_odd_area(rings)), abs=1e-6)
    assert crossings(found) == 0


def test_bow_tie_overlap_and_hole():
    bow = uncrossed([[(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]])
    assert len(bow) == 2 and [signed(r) for r in bow] == [4, 4]
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    assert uncrossed([square, square]) == []  # twice the same separates nothing
    assert sum(map(signed, uncrossed([square, [(2, 2), (6, 2), (6, 6), (2, 6), (2, 2)]]))) == 24
    holed = uncrossed([square, [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]])
    assert sorted(signed(r) for r in holed) == [-4, 16]
    beside = uncrossed([square, [(4, 0), (8, 0), (8, 4), (4, 4), (4, 0)]])  # the common side goes
    assert len(beside) == 1 and signed(beside[0]) == 32
    assert uncrossed([]) == [] and uncrossed([[(0, 0), (1, 1), (0, 0)]]) == []


def test_many_points():
    turns = np.linspace(0, 2 * np.pi, 2001)[:-1]
    star = [(1e6 + 100 * np.cos(7 * a), 5e6 + 100 * np.sin(3 * a)) for a in turns]
    found = uncrossed([[*star, star[0]]])
    assert crossings(found[:1]) == 0 and sum(map(signed, [[(x - 1e6, y - 5e6) for x, y in r] for r in found])) > 0


def test_polygons_of_a_table(spark):
    rows = [(1, [[(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]]), (2, None), (3, []), (4, [[(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]])]
    got = {r.id: r for r in uncrossed_rings(spark.createDataFrame(rows, f"id int, rings {RINGS}")).withColumn("area", spatial.ring_area("rings")).collect()}
    assert got[1].area == 8 and got[2].rings is None and got[3].rings == [] and got[4].rings == []


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def test_union_by_winding():
    assert sum(map(signed, uncrossed([box(0, 0, 4, 4), box(2, 2, 4, 4)], "nonzero"))) == 28
    assert sum(map(signed, uncrossed([box(0, 0, 4, 4), box(0, 0, 4, 4)], "nonzero"))) == 16
    assert sum(map(signed, uncrossed([box(0, 0, 4, 4), box(1, 1, 2, 2)], "nonzero"))) == 16
    assert sum(map(signed, uncrossed([box(0, 0, 4, 4), box(1, 1, 2, 2)[::-1]], "nonzero"))) == 12  # a hole, as it turns back
    assert len(uncrossed([box(0, 0, 1, 1), box(5, 5, 1, 1)], "nonzero")) == 2


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 30), st.integers(1, 30), st.integers(1, 9), st.sampled_from([8, 32, 64]))
def test_buffer_of_a_rectangle_has_its_closed_form(w, h, r, corner):
    circle = corner / 2 * r * r * np.sin(2 * np.pi / corner)
    found = widened([box(100, 50, w, h)], r, corner)
    assert len(found) == 1 and signed(found[0]) == pytest.approx(w * h + 2 * r * (w + h) + circle)


def test_buffers_close_holes_and_bays():
    ring, hole = box(0, 0, 20, 20), box(8, 8, 4, 4)
    assert len(widened([ring, hole], 1.0)) == 2 and len(widened([ring, hole], 2.5)) == 1
    bay = [(0, 0), (10, 0), (10, 10), (6, 10), (6, 2), (4, 2), (4, 10), (0, 10), (0, 0)]
    assert sorted(signed(r) > 0 for r in widened([bay], 1.5)) == [True]
    assert widened([[(0, 0), (1, 1), (0, 0)]], 2.0) == [] and widened([], 2.0) == []


def test_buffers_of_a_table(spark):
    rows = [(1, [[(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (0.0, 0.0)]]), (2, None)]
    got = {r.id: r for r in buffered(spark.createDataFrame(rows, f"id int, rings {RINGS}"), 2.0).withColumn("area", spatial.ring_area("rings")).collect()}
    assert got[1].area == pytest.approx(12 + 28 + 16 * 4 * np.sin(np.pi / 16)) and got[2].rings is None
    with pytest.raises(ValueError, match="positive"):
        buffered(spark.createDataFrame(rows, f"id int, rings {RINGS}"), 0.0)


def widened_by_circles(rings, radius, corner):
    simple = uncrossed(rings)
    parts = list(simple)
    for ring in simple:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            length = float(np.hypot(x2 - x1, y2 - y1))
            nx, ny = (y2 - y1) / length * radius, (x1 - x2) / length * radius
            parts.append([(x1 + nx, y1 + ny), (x2 + nx, y2 + ny), (x2 - nx, y2 - ny), (x1 - nx, y1 - ny), (x1 + nx, y1 + ny)])
            circle = [(x1 + radius * float(np.cos(t)), y1 + radius * float(np.sin(t))) for t in np.linspace(0, 2 * np.pi, corner + 1)[:-1]]
            parts.append([*circle, circle[0]])
    return uncrossed(parts, "nonzero")


SHAPES = {
    "box": [box(0, 0, 7, 4)],
    "triangle": [[(0, 0), (9, 1), (2, 8), (0, 0)]],
    "bay": [[(0, 0), (10, 0), (10, 10), (6, 10), (6, 2), (4, 2), (4, 10), (0, 10), (0, 0)]],
    "hole": [box(0, 0, 20, 20), box(8, 8, 4, 4)],
    "bow": [[(0, 0), (8, 8), (8, 0), (0, 8), (0, 0)]],
    "turned": [[(0, 0), (0, 5), (3, 9), (8, 3), (4, 4), (5, 0), (0, 0)]],
}


@pytest.mark.parametrize("rings", SHAPES.values(), ids=SHAPES)
def test_sectors_widen_as_circles_do(rings):
    for radius, corner in ((0.3, 32), (0.9, 7), (2.5, 32), (6.0, 12)):
        got, expected = widened(rings, radius, corner), widened_by_circles(rings, radius, corner)
        assert sum(map(signed, got)) == pytest.approx(sum(map(signed, expected)), abs=1e-6) and len(got) == len(expected)


def test_buffers_far_from_the_origin_keep_their_digits():
    exact = Fraction(0)
    ring = widened([box(81.25, 89_991.75, 3.5, 2.0)], 2.5)[0]
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        exact += (Fraction(x1) * Fraction(y2) - Fraction(x2) * Fraction(y1)) / 2
    assert float(exact) == pytest.approx(7 + 5 * 5.5 + 100 * np.sin(np.pi / 16), abs=1e-7)


def test_pairs_in_parts_change_nothing(monkeypatch):
    turns = np.linspace(0, 2 * np.pi, 41)[:-1]
    star = [(50 * np.cos(7 * a), 50 * np.sin(3 * a)) for a in turns]
    rings = [[*star, star[0]], box(-20, -20, 40, 40)]
    whole = widened(rings, 2.0)
    monkeypatch.setattr(functions_rings, "PAIRS", 50)
    assert widened(rings, 2.0) == whole


def test_polygons_of_one_partition_are_dealt_to_tasks_and_take_milliseconds(spark):
    rows = [(i, [[(float(x), float(y)) for x, y in box(i, 2 * i, 3 + i % 4, 4)]]) for i in range(1_200)]
    df = spark.createDataFrame(rows, f"id int, rings {RINGS}").coalesce(1)
    assert buffered(df, 2.5).rdd.getNumPartitions() > 1
    began = time.process_time()
    for _, rings in rows[:200]:
        assert len(widened(rings, 2.5)) == 1
    assert time.process_time() - began < 3
