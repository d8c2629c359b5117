"""Regular grids as pixel tables: rows (row, col, layers), one value object for the geometry."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions.projection import transformed
from pixelmill.session import work_table


@dataclass(frozen=True)
class GridSpec:
    """Left and top edge, cell size, and size in cells; rows count downwards (G4: equality is ==)."""

    left: float
    top: float
    dx: float
    dy: float
    n_rows: int
    n_cols: int
    srid: int = 32632

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """left, bottom, right, top."""
        return self.left, self.top - self.n_rows * self.dy, self.left + self.n_cols * self.dx, self.top

    def snapped(self, left: float, bottom: float, right: float, top: float, margin: float = 300.0) -> GridSpec:
        """The grid grown to hold the given bounds and a margin, its cells kept where they are.

        It never shrinks on any side.
        """
        mine = self.bounds
        west = max(0, math.ceil((mine[0] - (left - margin)) / self.dx))
        south = max(0, math.ceil((mine[1] - (bottom - margin)) / self.dy))
        east = max(0, math.ceil((right + margin - mine[2]) / self.dx))
        north = max(0, math.ceil((top + margin - mine[3]) / self.dy))
        return GridSpec(self.left - west * self.dx, self.top + north * self.dy, self.dx, self.dy, self.n_rows + north + south, self.n_cols + west + east, self.srid)


def template(spark: SparkSession, spec: GridSpec) -> DataFrame:
    """All cells of a grid."""
    cells = spark.range(spec.n_rows * spec.n_cols)
    return cells.select(F.expr(f"CAST(id DIV {spec.n_cols} AS INT)").alias("row"), F.expr(f"CAST(id % {spec.n_cols} AS INT)").alias("col"))


def on_template(df: DataFrame, spec: GridSpec) -> DataFrame:
    """Every cell of the grid, with nulls where ``df`` has no row: extends and crops at once."""
    return template(df.sparkSession, spec).join(df, ["row", "col"], "left")


def crop(df: DataFrame, first_row: int, last_row: int, first_col: int, last_col: int) -> DataFrame:
    """Cells of a window, bounds included, numbered from its corner."""
    inside = df.where(F.col("row").between(first_row, last_row) & F.col("col").between(first_col, last_col))
    return inside.withColumns({"row": F.col("row") - first_row, "col": F.col("col") - first_col})


def stack(layers: Sequence[DataFrame]) -> DataFrame:
    """Layers of one grid side by side (J9): one aggregation by cell, so one shuffle however many layers.

    A layer holds a cell once; cells that only some layers hold are null in the others.
    """
    names = list(dict.fromkeys(c for layer in layers for c in layer.columns if c not in ("row", "col")))
    long = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)
    return long.groupBy("row", "col").agg(*[F.max(c).alias(c) for c in names])


def mosaic(old: DataFrame, new: DataFrame, value: str) -> DataFrame:
    """The old value wherever there is one, else the new."""
    right = new.select("row", "col", F.col(value).alias("later"))
    return old.select("row", "col", value).join(right, ["row", "col"], "full_outer").select("row", "col", F.coalesce(value, "later").alias(value))


def prefer_filled(original: DataFrame, filled: DataFrame | None, value: str) -> DataFrame:
    """The gap-filled layer if there is one, over the original."""
    return original if filled is None else mosaic(filled, original, value)


def difference(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Absolute difference on the cells where both hold a value."""
    right = b.select("row", "col", F.col(value).alias("other"))
    both = a.select("row", "col", value).join(right, ["row", "col"]).where(F.col(value).isNotNull() & F.col("other").isNotNull())
    return both.select("row", "col", F.abs(F.col(value) - F.col("other")).alias("diff"))


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], buckets: int = 4096, few: int = 50_000) -> list[float | None]:
    """Quantiles with linear interpolation, as ``percentile`` gives them, without gathering all values.

    Ranges of values are counted, and only those that hold a wanted rank are counted again in finer ranges,
    until at most ``few`` values of a range, or equal ones, are left.
    """
    v = F.col(value).cast("double")
    held = df.where(v.isNotNull()).select(v.alias("v"))
    n, low, high = held.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * s for s in shares]
    found: dict[int, float] = {}
    todo = [(low, high, 0, n, sorted({k for p in places for k in (math.floor(p), math.ceil(p))}))]
    while todo:
        low, high, before, inside, ranks = todo.pop()
        if low == high:
            found |= dict.fromkeys(ranks, low)
            continue
        part = held.where(F.col("v").between(low, high))
        if inside <= few:
            values = sorted(r.v for r in part.collect())
            found |= {k: values[k - before] for k in ranks}
            continue
        bucket = F.least(F.floor((F.col("v") - low) / (high - low) * buckets), F.lit(buckets - 1)).alias("bucket")
        for r in sorted(part.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()):
            if wanted := [k for k in ranks if before <= k < before + r.n]:
                todo.append((r.low, r.high, before, r.n, wanted))
            before += r.n
    return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in places]


def drift(diff: DataFrame, above: float) -> DataFrame:
    """Cells, largest, median, 95th percentile, and share above a threshold in percent."""
    diff = work_table(diff.select("diff"), "differences")
    median, p95 = exact_quantiles(diff, "diff", (0.5, 0.95))
    return diff.agg(
        F.count(F.lit(1)).alias("n"),
        F.max("diff").alias("max_diff"),
        F.lit(median).cast("double").alias("median_diff"),
        F.lit(p95).cast("double").alias("p95_diff"),
        (F.avg((F.col("diff") > above).cast("double")) * 100).alias("pct_above"),
    )


def seam_gap(diff: DataFrame, first_col: int, last_col: int) -> DataFrame:
    """Mean difference on a strip of columns along a seam."""
    return diff.where(F.col("col").between(first_col, last_col)).agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean_gap"))


def layer_stats(df: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Smallest, mean and largest value and the nulls of each layer, in one scan (A4, A5)."""
    found = df.agg(
        *[f(c).alias(f"{name}_{c}") for c in layers for name, f in (("min", F.min), ("mean", F.avg), ("max", F.max))],
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in layers],
    )
    each = F.array(*[F.struct(F.lit(c).alias("layer"), *[F.col(f"{name}_{c}").cast("double").alias(f"{name}_value") for name in ("min", "mean", "max")], F.col(f"nulls_{c}").alias("n_null")) for c in layers])
    return found.select(F.explode(each).alias("s")).select("s.*")


def null_free(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns without any null, by one pass over the data."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] == 0]


def nearest(df: DataFrame, source: GridSpec, target: GridSpec) -> DataFrame:
    """Value of the source cell under each target cell's centre (G2), brought to the source's reference system."""
    x = target.left + (F.col("row_col.col") + 0.5) * target.dx
    y = target.top - (F.col("row_col.row") + 0.5) * target.dy
    x, y = transformed(x, y, target.srid, source.srid)
    cells = template(df.sparkSession, target).select(F.struct("row", "col").alias("row_col"))
    cells = cells.select("row_col", F.floor((source.top - y) / source.dy).cast("int").alias("row"), F.floor((x - source.left) / source.dx).cast("int").alias("col"))
    values = [c for c in df.columns if c not in ("row", "col")]
    return cells.join(df, ["row", "col"], "left").select("row_col.row", "row_col.col", *values)


def aligned(df: DataFrame, value: str, source: GridSpec, target: GridSpec) -> DataFrame:
    """The layer on the target grid: as it is if both grids are equal, else resampled."""
    return df.select("row", "col", value) if source == target else bilinear(df, value, source, target)


def bilinear(df: DataFrame, value: str, source: GridSpec, target: GridSpec) -> DataFrame:
    """Weighted mean of the four source cells around each target centre, brought to the source's reference system;
    nulls lend their weight (G3, G1, G5)."""
    x, y = transformed(target.left + (F.col("col") + 0.5) * target.dx, target.top - (F.col("row") + 0.5) * target.dy, target.srid, source.srid)
    x, y = (x - source.left) / source.dx - 0.5, (source.top - y) / source.dy - 0.5
    placed = template(df.sparkSession, target).withColumns({"x": x, "y": y}).withColumns({"x0": F.floor("x").cast("int"), "y0": F.floor("y").cast("int")})
    right, down = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    corners = [((1 - right if i == 0 else right) * (1 - down if j == 0 else down), i, j) for j in (0, 1) for i in (0, 1)]
    four = F.explode(F.array(*[F.struct((F.col("y0") + j).alias("sr"), (F.col("x0") + i).alias("sc"), w.alias("w")) for w, i, j in corners]))
    terms = placed.select("row", "col", four.alias("s")).select("row", "col", "s.*")
    held = df.select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col(value).alias("v")).where("v is not null")
    joined = terms.join(held, ["sr", "sc"], "left")
    weight = F.sum(F.when(F.col("v").isNotNull(), F.col("w")))
    return joined.groupBy("row", "col").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), weight).alias(value))
