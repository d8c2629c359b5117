"""Area of applicability: dissimilarity of new pixels from the training pixels in weighted predictor space."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pixelmill.functions.indices import complete
from pixelmill.operators.forest import forest, importance
from pixelmill.operators.sampling import proportional_quota, simple_sample
from pixelmill.session import ship_package
from pixelmill.sources.files import read_if_there

BLOCK = 64


@dataclass
class Space:
    """Training pixels in weighted standard units, and what scales and bounds a dissimilarity."""

    predictors: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray  # weight / standard deviation
    train: np.ndarray
    mean_distance: float = float("nan")
    threshold: float = float("nan")


def weights_of(importance: Mapping[str, float], predictors: Sequence[str]) -> list[float]:
    """Importance by predictor; a missing or negative one counts 0."""
    return [max(0.0, importance.get(p, 0.0)) for p in predictors]


def importance_rows(df: DataFrame, id_col: str, most: int = 50_000, seed: int = 50) -> DataFrame:
    """The bounded rows on which a missing importance is computed anew."""
    return simple_sample(df, id_col, most, seed)


def importance_weights(df: DataFrame, predictors: Sequence[str], target: str, id_col: str, path: str | None, mtry: int | None = None, seed: int = 50) -> list[float]:
    """Weights from the stored importances (columns predictor, importance) if there are any, else from a forest of
    200 trees on at most 50,000 rows (M21)."""
    spark = df.sparkSession
    stored = read_if_there(spark, path, required=False) if path else None
    if stored is None:
        rows = importance_rows(df.dropna(subset=[target, *predictors]), id_col, seed=seed)
        model = forest(predictors, target, mtry or max(1, int(len(predictors) ** 0.5)), 1, seed=seed).fit(rows)
        stored = importance(spark, model)
    return weights_of({r.predictor: float(r.importance) for r in stored.select("predictor", "importance").collect()}, predictors)


def training_space(df: DataFrame, predictors: Sequence[str], weights: Sequence[float], class_col: str, id_col: str, most: int = 15_000, seed: int = 50) -> Space:
    """Moments over all complete training rows, and a class-proportional sample of at most ``most`` of them."""
    rows = df.dropna(subset=list(predictors))
    moments = rows.agg(*[F.avg(p) for p in predictors], *[F.stddev_samp(p) for p in predictors]).first()
    p = len(predictors)
    mean, sd = np.array(moments[:p], float), np.array(moments[p:], float)
    scale = np.divide(np.asarray(weights, float), sd, out=np.zeros(p), where=sd > 0)
    sample = proportional_quota(rows, class_col, id_col, most, seed).orderBy(id_col).select(*[F.col(c).cast("double") for c in predictors])
    train = (np.array(sample.collect(), float).reshape(-1, p) - mean) * scale  # at most about ``most`` rows
    return Space(tuple(predictors), mean, scale, train)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0)


@dataclass
class BallIndex:
    """Points in balls around some of them, for exact nearest distances by the triangle inequality.

    Centres are chosen one by one, each the point farthest from those before; every point belongs to its nearest
    centre, and a ball keeps its points in the order of their distance to the centre.
    """

    points: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    first: np.ndarray  # where the points of each ball begin, and the end
    depth: np.ndarray  # distance of each point to its centre

    @classmethod
    def of(cls, points: np.ndarray, balls: int | None = None) -> BallIndex:
        balls = min(len(points), balls or 2 * int(np.ceil(np.sqrt(len(points)))))
        chosen, near = [], np.full(len(points), np.inf)
        owner = np.zeros(len(points), int)
        for k in range(balls):
            chosen.append(int(near.argmax()) if k else int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin()))
            gap = ((points - points[chosen[-1]]) ** 2).sum(axis=1)
            owner[gap < near] = k
            near = np.minimum(near, gap)
            if not near.any():
                break
        order = np.lexsort((near, owner))
        first = np.searchsorted(owner[order], np.arange(len(chosen) + 1))
        depth = np.sqrt(near[order])
        radii = np.array([depth[a:b].max(initial=0.0) for a, b in zip(first, first[1:], strict=False)])
        return cls(points[order], points[chosen], radii, first, depth)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, int]:
        """The distance of each query to its nearest point, and how many distances were computed for all of them.

        Balls are taken in the order of how near they may come, so most are never opened; of an opened ball only the
        points are compared whose distance to the centre differs from the query's by less than the best so far.
        """
        if not len(self.points):
            return np.full(len(queries), np.nan), 0
        to_centre = np.sqrt(squared_distances(queries, self.centres))
        bound = to_centre - self.radii
        slack = 1e-9 * (1 + np.abs(self.points).max())  # against rounding: never passes over a nearer point
        best, used = to_centre.min(axis=1), to_centre.size
        order = np.argsort(bound, axis=1)
        waiting = np.arange(len(queries))
        for step in range(order.shape[1]):
            waiting = waiting[bound[waiting, order[waiting, step]] <= best[waiting] + slack]
            if not len(waiting):
                break
            ball = order[waiting, step]
            for b in np.unique(ball).tolist():
                some = waiting[ball == b]
                begin, end = self.first[b], self.first[b + 1]
                depth, away = self.depth[begin:end], to_centre[some, b]
                low = begin + int(np.searchsorted(depth, (away - best[some]).min() - slack))
                high = begin + int(np.searchsorted(depth, (away + best[some]).max() + slack, side="right"))
                if low < high:
                    best[some] = np.minimum(best[some], np.sqrt(squared_distances(queries[some], self.points[low:high]).min(axis=1)))
                    used += len(some) * (high - low)
        return best, used


def training_distances(df: DataFrame, space: Space) -> DataFrame:
    """Per training pixel: the distance to its nearest other, and the sum of its distances to all."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(space)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = shared.value.train
        for batch in batches:
            for first in batch["id"]:
                part = x[first : first + BLOCK]
                d = np.sqrt(squared_distances(part, x))
                own = np.arange(len(part))
                d[own, first + own] = 0
                total = d.sum(axis=1)
                d[own, first + own] = np.inf
                yield pd.DataFrame({"i": first + own, "nearest": d.min(axis=1), "total": total})

    return spark.range(0, len(space.train), BLOCK).mapInPandas(run, "i long, nearest double, total double")


def fit_space(df: DataFrame, space: Space, threshold: str = "whisker") -> Space:
    """Sets the mean distance of training pairs and the threshold on the training dissimilarity.

    whisker: the largest dissimilarity within 1.5 interquartile ranges above the third quartile; max: the
    largest of all.
    """
    n = len(space.train)
    distances = training_distances(df, space)
    mean_distance = distances.agg(F.sum("total")).first()[0] / (n * (n - 1))
    di = distances.select((F.col("nearest") / mean_distance).alias("di"))
    q1, q3 = di.agg(F.percentile("di", 0.25), F.percentile("di", 0.75)).first()
    bound = float("inf") if threshold == "max" else q3 + 1.5 * (q3 - q1)
    most = di.where(F.col("di") <= bound).agg(F.max("di")).first()[0]
    return Space(space.predictors, space.mean, space.scale, space.train, mean_distance, most)


def dissimilarity(df: DataFrame, space: Space) -> DataFrame:
    """Adds di and aoa (1 where di <= threshold); both null for incomplete rows.

    The training sample is broadcast as an index of balls, bounded by the sample's own cap; a pixel is compared with the
    points of the balls that may hold its nearest one.
    """
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((space, BallIndex.of(space.train)))
    whole = df.withColumn("di_whole", complete(space.predictors))
    names = list(space.predictors)
    schema = StructType([*df.schema.fields, StructField("di", DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, index = shared.value
        for batch in batches:
            di = np.full(len(batch), np.nan)
            at = np.flatnonzero(batch["di_whole"].to_numpy(bool))
            x = (batch[names].to_numpy(float)[at] - s.mean) * s.scale
            di[at] = index.nearest(x)[0] / s.mean_distance
            yield batch.drop(columns="di_whole").assign(di=di)

    judged = whole.mapInPandas(run, schema).withColumn("di", F.nanvl("di", F.lit(None)))
    return judged.withColumn("aoa", (F.col("di") <= space.threshold).cast("int"))


def shares(judged: DataFrame) -> DataFrame:
    """Pixels inside and outside, and their shares in percent; an absent side counts 0."""
    inside, outside = F.count_if(F.col("aoa") == 1), F.count_if(F.col("aoa") == 0)
    found = judged.agg(inside.alias("n_inside"), outside.alias("n_outside"))
    return found.withColumn("pct_inside", F.coalesce(F.round(F.try_divide(100 * F.col("n_inside"), F.col("n_inside") + F.col("n_outside")), 2), F.lit(0.0)))
