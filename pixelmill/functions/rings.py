"""Overlay of polygons: crossing rings rebuilt as simple ones of the same area (G19), unions, and buffers."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from math import atan2, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.session import ship_package

RINGS = "array<array<struct<x:double,y:double>>>"


#: Pairs of segments that are held in arrays at once.
PAIRS = 1 << 19


def cuts(segments: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Segments (x1, y1, x2, y2) by number, and the shares of their length at which others touch or cross them.

    Segments are swept by their left ends; each is compared with those that begin before it ends and reach its height,
    many in arrays at a time.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    low, high = np.minimum(segments[:, :2], segments[:, 2:]), np.maximum(segments[:, :2], segments[:, 2:])
    order = np.argsort(low[:, 0], kind="stable")
    first = np.arange(1, len(order) + 1)
    n_near = np.maximum(np.searchsorted(low[order, 0], high[order, 0] + slack, side="right") - first, 0)
    total, start = np.cumsum(n_near), 0
    while start < len(order):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + PAIRS, side="right")))
        n = n_near[start:end]
        i = np.repeat(order[start:end], n)
        j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[start:end], n)]
        start = end
        near = (low[j, 1] <= high[i, 1] + slack) & (high[j, 1] >= low[i, 1] - slack)
        i, j = i[near], j[near]
        p, q = segments[i, :2], segments[j, :2]
        r, s, gap = segments[i, 2:] - p, segments[j, 2:] - q, q - p
        across = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
        length, lengths = np.hypot(r[:, 0], r[:, 1]), np.hypot(s[:, 0], s[:, 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (gap[:, 0] * s[:, 1] - gap[:, 1] * s[:, 0]) / across, (gap[:, 0] * r[:, 1] - gap[:, 1] * r[:, 0]) / across
        parallel = np.abs(across) <= 1e-12 * length * lengths
        meets = ~parallel & (t >= -slack / length) & (t <= 1 + slack / length) & (u >= -slack / lengths) & (u <= 1 + slack / lengths)
        found += [(i[meets], t[meets]), (j[meets], u[meets])]
        line = parallel & (np.abs(gap[:, 0] * r[:, 1] - gap[:, 1] * r[:, 0]) <= slack * length)  # on one line
        for of, by, along, size in ((i[line], j[line], r[line], length[line]), (j[line], i[line], s[line], lengths[line])):
            for k in (0, 2):
                share = ((segments[by, k : k + 2] - segments[of, :2]) * along).sum(axis=1) / size**2
                held = (share >= 0) & (share <= 1)
                found.append((of[held], share[held]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def pieces_of(segments: np.ndarray, digits: int, winding: bool) -> tuple[np.ndarray, np.ndarray]:
    """The segments cut where they meet, each piece once and from its western, or lower, end: how often it lies there, or
    its turns. Points are rounded to ``digits``."""
    n = np.arange(len(segments))
    of, share = cuts(segments, 10.0**-digits)
    of, share, place = np.concatenate([n, of, n]), np.concatenate([n * 0.0, np.clip(share, 0, 1), n * 0.0 + 1]), np.repeat([0, 1, 2], [len(n), len(of), len(n)])
    order = np.lexsort((place, share, of))
    of, share, place = of[order], share[order, None], place[order, None]
    points = np.where(place == 2, segments[of, 2:], segments[of, :2] + share * (segments[of, 2:] - segments[of, :2]))
    points = np.round(points, digits) + 0.0
    a, b = points[:-1], points[1:]
    whole = (of[:-1] == of[1:]) & (a != b).any(axis=1)
    a, b = a[whole], b[whole]
    back = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
    both = np.where(back[:, None], np.hstack([b, a]), np.hstack([a, b]))
    order = np.lexsort(both.T[::-1])
    new = np.concatenate([[True], (both[order][1:] != both[order][:-1]).any(axis=1)])[: len(both)]
    seen = order[new]  # the first of equals, as the sort is stable
    weight = np.bincount(np.cumsum(new) - 1, np.where(back & winding, -1, 1)[order], len(seen)).astype(int)
    by_place = np.argsort(seen)
    return both[seen[by_place]], weight[by_place]


def sides(edges: np.ndarray, weight: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """How often the area is wound around left and right of the middle of each edge."""
    left, right = np.zeros(len(edges), int), np.zeros(len(edges), int)
    x1, y1, x2, y2 = edges.T
    rows = max(1, PAIRS // max(1, len(edges)))
    for upright in (False, True):
        of = np.flatnonzero((x1 == x2) == upright)
        for part in (of[k : k + rows] for k in range(0, len(of), rows)):
            mx, my = ((x1 + x2) / 2)[part, None], ((y1 + y2) / 2)[part, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                if upright:  # what lies west of its middle
                    west = ((y1 > my) != (y2 > my)) & (x1 + (my - y1) * (x2 - x1) / (y2 - y1) < mx)
                    left[part] = -(west @ (weight * np.sign(y2 - y1)).astype(int))
                    right[part] = left[part] - weight[part]
                else:  # what lies below its middle
                    at = y1 + (mx - x1) * (y2 - y1) / (x2 - x1)
                    below = ((x1 > mx) != (x2 > mx)) & (np.abs(at - my) > slack) & (at < my)
                    right[part] = below @ weight
                    left[part] = right[part] + weight[part]
    return left, right


def uncrossed(rings: list[list[tuple[float, float]]], rule: str = "even-odd") -> list[list[tuple[float, float]]]:
    """Closed simple rings with the even-odd area of the given ones, or with all that they wind around ("nonzero"):
    outer rings counter-clockwise, holes clockwise.

    All segments are cut where they meet. A piece with the inside on both of its sides or on none separates nothing and
    goes; every other one is turned so that the inside is on its left. Rings are walked by turning left as far as the
    pieces allow, so that they touch but never cross.
    """
    winding = {"even-odd": False, "nonzero": True}[rule]
    inside = (lambda n: n != 0) if winding else (lambda n: n % 2 != 0)
    segments = np.array([(*a, *b) for ring in rings for a, b in zip(ring, ring[1:], strict=False) if a != b], float).reshape(-1, 4)
    if not len(segments):
        return []
    # far from the origin the polygon is laid near it by whole numbers, so that its points keep their digits
    far = float(np.abs(segments).max()) or 1.0
    low, high = segments.reshape(-1, 2).min(axis=0), segments.reshape(-1, 2).max(axis=0)
    shift = np.where(np.minimum(np.abs(low), np.abs(high)) > high - low, np.floor(low), 0.0)
    segments = segments - np.tile(shift, 2)
    extent = float(np.abs(segments).max()) or 1.0
    digits = min(11 - int(np.ceil(np.log10(extent))), 14 - int(np.ceil(np.log10(far))))  # points closer than this are one

    edges, weight = pieces_of(segments, digits, winding)
    held = inside(weight)
    edges, weight = edges[held], weight[held]
    left, right = (inside(x) for x in sides(edges, weight, 10.0**-digits))
    onward = defaultdict(list)
    for (x1, y1, x2, y2), turned in zip((edges[left != right] + np.tile(shift, 2)).tolist(), right[left != right].tolist(), strict=True):
        a, b = (x1, y1), (x2, y2)
        onward[b if turned else a].append(a if turned else b)
    found = []
    for start in list(onward):
        while onward[start]:
            ring, here = [start], start
            before = None
            while True:
                choices = onward[here]
                if before is None:
                    after = choices[0]
                else:  # the sharpest turn to the left
                    came = atan2(before[1] - here[1], before[0] - here[0])
                    after = min(choices, key=lambda p: (came - atan2(p[1] - here[1], p[0] - here[0])) % (2 * pi) or 2 * pi)
                choices.remove(after)
                before, here = here, after
                ring.append(here)
                if here == start:
                    break
            found.append(ring)
    return found


def widened(rings: list[list[tuple[float, float]]], radius: float, corner: int = 32) -> list[list[tuple[float, float]]]:
    """The polygon and all within ``radius`` of it; circles are polygons of ``corner`` points on them.

    The polygon, a rectangle along each side and a circle around each point are united. Of a circle only the sector goes
    in that lies outside of the turn at its point, where both sides are as long as the radius: their rectangles cover
    the rest.
    """
    step = 2 * pi / corner
    simple = uncrossed(rings)
    parts = list(simple)
    for ring in simple:
        points = np.array(ring[:-1])
        after = np.roll(points, -1, axis=0) - points
        length = np.hypot(after[:, 0], after[:, 1])
        normal = np.column_stack([after[:, 1], -after[:, 0]]) / length[:, None] * radius
        before, ahead = np.roll(after, 1, axis=0), points + after
        for corners in np.stack([points + normal, ahead + normal, ahead - normal, points - normal, points + normal], axis=1).tolist():
            parts.append([(x, y) for x, y in corners])
        turn = np.arctan2(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0], (before * after).sum(axis=1))
        outer = np.where((turn > 0)[:, None], np.roll(normal, 1, axis=0), -normal)  # where the sector begins, counter-clockwise
        begin = np.arctan2(outer[:, 1], outer[:, 0]) / step
        long = np.minimum(length, np.roll(length, 1)) >= radius
        for (x, y), first, last, plain in zip(points.tolist(), np.floor(begin), np.ceil(begin + np.abs(turn) / step), long, strict=True):
            sector = plain and last - first < corner
            k = np.arange(first, last + 1) if sector else np.arange(corner)
            around = list(zip((x + radius * np.cos(k % corner * step)).tolist(), (y + radius * np.sin(k % corner * step)).tolist(), strict=True))
            parts.append([(x, y), *around, (x, y)] if sector else [*around, around[0]])
    return uncrossed(parts, "nonzero")


def _mended(df: DataFrame, rings: str, work: Callable[[list], list]) -> DataFrame:
    ship_package(df.sparkSession)

    @F.pandas_udf(RINGS)
    def mended(polygons: pd.Series) -> pd.Series:
        def one(polygon):
            plain = [[(float(p["x"]), float(p["y"])) for p in ring] for ring in polygon]
            return [[{"x": x, "y": y} for x, y in ring] for ring in work(plain)]

        return polygons.map(lambda polygon: None if polygon is None else one(polygon))

    # a small file is one partition, however long its polygons take
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.withColumn(rings, mended(F.col(rings)))


def buffered(df: DataFrame, radius: float, rings: str = "rings", corner: int = 32) -> DataFrame:
    """``df`` with the polygons widened by ``radius`` in all directions (G18); null stays null, and without area there is
    nothing to widen. Each polygon is widened by itself, in Arrow batches."""
    if radius <= 0:
        raise ValueError("the radius must be positive")
    return _mended(df, rings, lambda plain: widened(plain, radius, corner))


def uncrossed_rings(df: DataFrame, rings: str = "rings") -> DataFrame:
    """``df`` with simple rings in place of ``rings``; null stays null, rings without area leave nothing.

    Each polygon is mended by itself, in Arrow batches.
    """
    return _mended(df, rings, uncrossed)
