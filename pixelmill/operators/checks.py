"""Run-time assertions: each reads the data once and stops with a message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.operators.grid import difference
from pixelmill.operators.legend import macrotype


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    if gone := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(gone)}")


def require_empty(df: DataFrame, what: str) -> None:
    """For anti-joins: shows a few of the rows that should not be there."""
    if rows := df.limit(5).collect():
        raise ValueError(f"{what}: {', '.join(str(r.asDict()) for r in rows)}")


def require_same_rows(before: DataFrame, after: DataFrame) -> None:
    """A lookup join must not change the row count."""
    n, m = before.count(), after.count()
    if n != m:
        raise ValueError(f"{n} rows became {m}")


def require_hierarchy(legend: DataFrame, n_classes: int = 53, n_l2: int = 18, n_l1: int = 7) -> None:
    """Class counts, unique codes, and level 1 as the tens of level 2."""
    row = legend.agg(
        F.count(F.lit(1)), F.count_distinct("classe"), F.count_distinct("cod_l2"), F.count_distinct("cod_l1"), F.count_if(macrotype() != F.col("cod_l1"))
    ).first()
    if tuple(row) != (n_classes, n_classes, n_l2, n_l1, 0):
        raise ValueError(f"legend does not hold: {tuple(row)}")


def require_values(df: DataFrame, value: str, expected: Sequence[int]) -> None:
    """Every expected class occurs in the raster."""
    held = {r[0] for r in df.select(value).where(F.col(value).isin(*expected)).distinct().collect()}
    if gone := sorted(set(expected) - held):
        raise ValueError(f"no cell of {gone}")


def require_overlap(old: DataFrame, new: DataFrame, value: str, most: float) -> None:
    """Old and new rasters agree on their overlap."""
    worst = difference(old, new, value).agg(F.max("diff")).first()[0]
    if worst is not None and worst >= most:
        raise ValueError(f"{value} differs by up to {worst}")
