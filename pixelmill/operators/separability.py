"""Jeffries-Matusita separability of classes from their means and covariances."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.session import ship_package

RIDGE = 1e-6
ILL_CONDITIONED = 1e10


def class_moments(df: DataFrame, class_col: str, predictors: Sequence[str]) -> DataFrame:
    """One row per class: n, mean (array) and cov (array of the upper triangle, row by row).

    Incomplete rows are left out. Only these rows, one per class, leave the aggregation.
    """
    complete = df.dropna(subset=[class_col, *predictors])
    upper = [(a, b) for i, a in enumerate(predictors) for b in predictors[i:]]
    return complete.groupBy(F.col(class_col).alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(p) for p in predictors]).alias("mean"), F.array(*[F.covar_samp(a, b) for a, b in upper]).alias("cov")
    )


def full_matrix(upper: Sequence[float], p: int) -> np.ndarray:
    """The covariance; a ridge is added where it is ill-conditioned."""
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = upper
    m = m + np.triu(m, 1).T
    if not np.isfinite(m).all():
        return m
    ill = np.linalg.cond(m, 1) > ILL_CONDITIONED
    return m + RIDGE * np.eye(p) if ill else m


def jeffries_matusita(mean_a: np.ndarray, cov_a: np.ndarray, mean_b: np.ndarray, cov_b: np.ndarray) -> float:
    """2 (1 - exp(-B)) in 0 .. 2; NaN if the pooled covariance is singular (M1)."""
    pooled = (cov_a + cov_b) / 2
    if not np.isfinite(pooled).all():
        return float("nan")
    signs, logs = zip(*map(np.linalg.slogdet, (pooled, cov_a, cov_b)), strict=True)
    if min(signs) <= 0:
        return float("nan")
    gap = mean_a - mean_b
    bhattacharyya = gap @ np.linalg.solve(pooled, gap) / 8 + (logs[0] - (logs[1] + logs[2]) / 2) / 2
    return float(np.clip(2 * (1 - np.exp(-bhattacharyya)), 0, 2))


def jm_pairs(df: DataFrame, class_col: str, predictors: Sequence[str]) -> DataFrame:
    """class_a < class_b, n_a, n_b, jm rounded to four digits, and few, true where a class has fewer rows
    than predictors + 1 (M2, J8). Pairs are as many as the classes allow, not the pixels."""
    ship_package(df.sparkSession)
    moments = class_moments(df, class_col, predictors)
    a, b = (moments.select(*[F.col(c).alias(f"{c}_{s}") for c in moments.columns]) for s in "ab")
    pairs = a.join(F.broadcast(b), F.col("class_a") < F.col("class_b"))
    p = len(predictors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            jm = [
                jeffries_matusita(np.asarray(r.mean_a), full_matrix(r.cov_a, p), np.asarray(r.mean_b), full_matrix(r.cov_b, p))
                for r in batch.itertuples()
            ]
            yield batch[["class_a", "class_b", "n_a", "n_b"]].assign(jm=jm)

    found = pairs.mapInPandas(run, "class_a int, class_b int, n_a long, n_b long, jm double")
    few = F.least("n_a", "n_b") < p + 1
    return found.select("class_a", "class_b", "n_a", "n_b", F.round(F.nanvl("jm", F.lit(None)), 4).alias("jm"), few.alias("few"))


def jm_matrix(pairs: DataFrame) -> DataFrame:
    """The symmetric matrix, one row per class, null on the diagonal."""
    both = pairs.select(F.col("class_a").alias("class"), F.col("class_b").alias("other"), "jm").union(pairs.select("class_b", "class_a", "jm"))
    return both.groupBy("class").pivot("other").agg(F.first("jm"))
