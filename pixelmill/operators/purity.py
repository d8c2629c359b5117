"""Class-wise purity: distance of each pixel from its class centre, and an adaptive window on it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.session import sized

LEAST_ROWS = 50


def z_distance(df: DataFrame, class_col: str, predictors: Sequence[str]) -> DataFrame:
    """Adds z = sqrt(sum(((x - mean_c) / sd_c)^2)); a constant or null predictor adds nothing.

    Class moments are one aggregate joined back, broadcast while it is small; a class of any size is never one task's sort.
    """
    moments = df.groupBy(class_col).agg(
        *[F.avg(p).alias(f"mean_{p}") for p in predictors], *[F.stddev_samp(p).alias(f"sd_{p}") for p in predictors]
    )
    joined = df.join(sized(moments.withColumnRenamed(class_col, "moment_class"), "class-moments"), F.col(class_col).eqNullSafe(F.col("moment_class")))
    parts = [F.coalesce(F.pow(F.try_divide(F.col(p) - F.col(f"mean_{p}"), F.col(f"sd_{p}")), 2), F.lit(0.0)) for p in predictors]
    return joined.select(*[joined[c] for c in df.columns], F.sqrt(reduce(add, parts)).alias("z"))


def purity(df: DataFrame, class_col: str, predictors: Sequence[str], least_rows: int = LEAST_ROWS) -> DataFrame:
    """Adds z, t1, t2 and ``pure``: t1 < z < t2 with t = mean_z -/+ sd_z of the class.

    Both bounds are open, so pixels nearer to the centre than t1 go as well. Classes of fewer than
    ``least_rows`` pixels are kept whole.
    """
    with_z = z_distance(df, class_col, predictors)
    spread = with_z.groupBy(class_col).agg(F.avg("z").alias("mu_z"), F.stddev_samp("z").alias("sigma_z"), F.count(F.lit(1)).alias("n_pre"))
    spread = spread.select(
        F.col(class_col).alias("spread_class"), (F.col("mu_z") - F.col("sigma_z")).alias("t1"), (F.col("mu_z") + F.col("sigma_z")).alias("t2"), "n_pre"
    )
    joined = with_z.join(sized(spread, "class-spread"), F.col(class_col).eqNullSafe(F.col("spread_class")))
    inside = (F.col("z") > F.col("t1")) & (F.col("z") < F.col("t2"))
    return joined.select(*[with_z[c] for c in with_z.columns], "t1", "t2", F.when(F.col("n_pre") < least_rows, True).otherwise(F.coalesce(inside, F.lit(False))).alias("pure"))


def purity_loss(judged: DataFrame, class_col: str) -> DataFrame:
    """Pixels before and after, removed, and the share removed in percent."""
    counted = judged.groupBy(class_col).agg(F.count(F.lit(1)).alias("n_pre"), F.count_if("pure").alias("n_post"))
    removed = F.col("n_pre") - F.col("n_post")
    return counted.withColumns({"n_removed": removed, "pct_removed": F.round(100 * removed / F.col("n_pre"), 2)})
