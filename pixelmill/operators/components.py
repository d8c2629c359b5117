"""Connected components of a link table, by contraction in random order; of cells in an array, by hooking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.session import work_table


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """vertex and component (the smallest vertex reachable) of every vertex of ``links(a, b)``.

    Each round orders the vertices by a hash of its own and moves every vertex to the first of its neighbours and
    itself, twice; links follow, and those within one vertex go. A vertex with a neighbour stays first among them with
    a chance of one half at most, so whatever the shape of the graph the links left shrink geometrically, and no label has
    to travel along a chain. Rounds are written tables; a lost executor costs one round at most.
    An empty table has no vertices; loops and repeated links do no harm.
    """
    both = work_table(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    moves: list[DataFrame] = []  # of the vertices with links in each round
    while not both.isEmpty():
        if len(moves) == max_rounds:
            raise RuntimeError(f"components did not settle within {max_rounds} rounds")
        mark = lambda c, n=len(moves): F.xxhash64(F.lit(n), F.col(c))
        near = both.groupBy(F.col("a").alias("vertex")).agg(F.min_by("b", mark("b")).alias("near"))
        ahead = F.struct(mark("near"), "near") < F.struct(mark("vertex"), "vertex")
        once = work_table(near.select("vertex", F.when(ahead, F.col("near")).otherwise(F.col("vertex")).alias("moved")), "moved")
        twice = work_table(once.join(once.toDF("moved", "above"), "moved").select("vertex", F.col("above").alias("moved")), "moved")
        moves.append(twice)
        both = both.join(twice.toDF("a", "to_a"), "a").join(twice.toDF("b", "to_b"), "b").where("to_a <> to_b")
        both = work_table(both.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "links")
    if not moves:
        return both.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    roots = moves.pop()
    while moves:  # where a vertex moved to, and where that went in later rounds
        roots = work_table(moves.pop().join(roots.toDF("moved", "root"), "moved", "left").select("vertex", F.coalesce("root", "moved").alias("moved")), "roots")
    least = roots.groupBy("moved").agg(F.min("vertex").alias("component"))
    return work_table(roots.join(least, "moved").select("vertex", "component"), "labels")


def cell_components(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """For each of some cells, in the order of their places, the position of the first cell of its component.

    Every root that is beside a smaller one hooks to the smallest; roots halve in two rounds at least.
    """
    place = np.full((row.max() - row.min() + 2, col.max() - col.min() + 2), -1)
    place[row - row.min(), col - col.min()] = np.arange(len(row))
    a, b = (np.concatenate(x) for x in zip((place[:, :-1].ravel(), place[:, 1:].ravel()), (place[:-1].ravel(), place[1:].ravel()), strict=True))
    linked = (a >= 0) & (b >= 0)
    a, b, root = a[linked], b[linked], np.arange(len(row))
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while not np.array_equal(above := root[root], root):
            root = above
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root
