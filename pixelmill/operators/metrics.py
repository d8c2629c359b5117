"""Accuracy metrics from the confusion table; nothing but grouped counts leaves the pixels."""

from __future__ import annotations

from collections.abc import Sequence
from math import atan, cos, pi, sin, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, pred: str, true: str, levels: Sequence[int]) -> DataFrame:
    """Counts for every pair of levels, zeros included: pred, true, n.

    Rows with a null or a label outside ``levels`` on either side are left out.
    """
    spark = df.sparkSession
    grid = spark.createDataFrame([(int(p), int(t)) for p in levels for t in levels], "pred int, true int")
    pairs = df.select(F.col(pred).cast("int").alias("pred"), F.col(true).cast("int").alias("true"))
    counts = pairs.groupBy("pred", "true").agg(F.count(F.lit(1)).alias("held"))
    return F.broadcast(grid).join(counts, ["pred", "true"], "left").select("pred", "true", F.coalesce("held", F.lit(0)).cast("long").alias("n"))


def class_counts(matrix: DataFrame) -> DataFrame:
    """Per class: n_true, n_pred, tp and the total n."""
    each = F.explode(F.array(F.struct(F.col("true").alias("k"), F.lit(1).alias("is_true")), F.struct(F.col("pred").alias("k"), F.lit(0).alias("is_true"))))
    sides = matrix.select("pred", "true", "n", each.alias("s"))
    counted = (
        sides.groupBy(F.col("s.k").alias("class"))
        .agg(
            F.sum(F.when(F.col("s.is_true") == 1, F.col("n")).otherwise(0)).alias("n_true"),
            F.sum(F.when(F.col("s.is_true") == 0, F.col("n")).otherwise(0)).alias("n_pred"),
            F.sum(F.when((F.col("s.is_true") == 1) & (F.col("pred") == F.col("true")), F.col("n")).otherwise(0)).alias("tp"),
        )
    )
    return counted.withColumn("n_all", F.sum("n_true").over(Window.partitionBy(F.lit(0))))  # one row per class


def class_rates(matrix: DataFrame) -> DataFrame:
    """Unrounded shares per class: ua, pa, spec, f1, ba, tss beside the counts (V3 to V8)."""
    tn = F.col("n_all") - F.col("n_true") - F.col("n_pred") + F.col("tp")
    rates = class_counts(matrix).withColumns(
        {
            "ua": F.col("tp") / F.greatest("n_pred", F.lit(1)),
            "pa": F.col("tp") / F.greatest("n_true", F.lit(1)),
            "spec": tn / F.greatest(F.col("n_all") - F.col("n_true"), F.lit(1)),
        }
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("ua") * F.col("pa"), F.col("ua") + F.col("pa")), F.lit(0.0))
    return rates.withColumns({"f1": f1, "ba": (F.col("pa") + F.col("spec")) / 2, "tss": F.col("pa") + F.col("spec") - 1})


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Report per class: counts, percentages of two digits, tss of four."""
    percent = [F.round(100 * F.col(c), 2).alias(c) for c in ("pa", "ua", "spec", "f1", "ba")]
    return class_rates(matrix).select("class", "n_true", "n_pred", *percent, F.round("tss", 4).alias("tss"))


def global_metrics(matrix: DataFrame) -> DataFrame:
    """One row: n, oa, ba, wa in percent, tss, gmean, kappa; rounded after aggregation.

    Classes without true samples count in the macro means with a recall of zero; the geometric mean takes
    only classes with true samples.
    """
    rates = class_rates(matrix)
    share = F.col("n_true") / F.col("n_all")
    held = F.when(F.col("n_true") > 0, F.col("pa"))
    sums = rates.agg(
        F.max("n_all").alias("n"),
        (F.sum("tp") / F.max("n_all")).alias("po"),
        F.sum(F.col("n_pred") * F.col("n_true") / (F.col("n_all") * F.col("n_all"))).alias("pe"),
        F.avg("ba").alias("ba"),
        F.sum(share * F.col("ua")).alias("wa"),
        F.avg("tss").alias("tss"),
        F.min(held).alias("lowest"),
        F.avg(F.when(held > 0, F.log(held))).alias("mean_log"),
    )
    gmean = F.when(F.col("lowest") > 0, F.exp("mean_log")).otherwise(0.0)
    return sums.select(
        "n",
        F.round(100 * F.col("po"), 2).alias("oa"),
        F.round(100 * F.col("ba"), 2).alias("ba"),
        F.round(100 * F.col("wa"), 2).alias("wa"),
        F.round("tss", 4).alias("tss"),
        F.round(gmean, 4).alias("gmean"),
        F.round(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")), 4).alias("kappa"),
    )


def t_within(t: float, df: int) -> float:
    """Chance that Student's t with ``df`` degrees of freedom stays within -t .. t: the finite trigonometric sum."""
    angle = atan(t / sqrt(df))
    total = term = cos(angle) if df % 2 else 1.0
    for k in range(3 if df % 2 else 2, df - 1, 2):
        term *= cos(angle) ** 2 * (k - 1) / k
        total += term
    if df % 2:
        return (angle + (sin(angle) * total if df > 1 else 0.0)) * 2 / pi
    return sin(angle) * total


def t_quantile(df: int, within: float = 0.95) -> float:
    """The bound that Student's t keeps with that chance, rounded to six digits."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if t_within(middle, df) < within else (low, middle)
    return round(high, 6)


def fold_band(per_fold: DataFrame, value: str, k: int = 5) -> DataFrame:
    """Mean and standard deviation over folds, and the t band of the mean."""
    half = F.lit(t_quantile(k - 1)) * F.col("sd") / F.sqrt(F.lit(float(k)))
    stats = per_fold.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return stats.select("mean", "sd", (F.col("mean") - half).alias("band_low"), (F.col("mean") + half).alias("band_high"))


def comparison(internal: DataFrame, transfer: DataFrame) -> DataFrame:
    """Cross-validated and transferred accuracy side by side: setting, oa, ba, wa, kappa."""
    columns = ["oa", "ba", "wa", "kappa"]
    both = [f.select(F.lit(name).alias("setting"), *columns) for name, f in (("internal", internal), ("transfer", transfer))]
    return both[0].unionByName(both[1])
