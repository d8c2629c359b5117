"""Seasonal composites of masked observations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.functions.indices import clear


@dataclass(frozen=True)
class Season:
    """First and last day, both included."""

    name: str
    first: str
    last: str

    def holds(self, ts: Column) -> Column:
        return (ts >= F.to_timestamp_ntz(F.lit(self.first))) & (ts < F.to_timestamp_ntz(F.lit(self.last)) + F.expr("INTERVAL 1 DAY"))


#: The seasons of the mapped year.
SEASONS = (
    Season("MAM", "2019-03-01", "2019-05-31"),
    Season("JJA", "2019-06-01", "2019-08-31"),
    Season("SON", "2019-09-01", "2019-11-30"),
    Season("DJF", "2018-12-01", "2019-02-28"),
)


def in_season(obs: DataFrame, season: Season, ts: str = "ts") -> DataFrame:
    """Observations of one season; the bounds reach the scan."""
    return obs.where(season.holds(F.col(ts)))


def seasonal_median(obs: DataFrame, keys: Sequence[str], bands: Sequence[str], scene_class: str = "scl") -> DataFrame:
    """Exact median of the clear observations of each key and band; null where none is clear.

    Masking, grouping and all bands are one aggregation, so observations are shuffled once.
    """
    return obs.groupBy(*keys).agg(*[F.median(clear(F.col(b), F.col(scene_class))).alias(b) for b in bands])


def clear_counts(obs: DataFrame, keys: Sequence[str], scene_class: str = "scl") -> DataFrame:
    """Observations and clear observations of each key (A5)."""
    n_clear = F.count(clear(F.lit(1), F.col(scene_class)))
    return obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"), n_clear.alias("n_clear"))
