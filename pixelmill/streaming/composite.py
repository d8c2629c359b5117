"""Counts of clear observations from a stream of arriving scenes.

Exact medians need all observations of a season, so composites stay a batch job; what a stream can tell
early is which pixels already have enough clear looks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.functions.indices import clear


def clear_looks(obs: DataFrame, window: str = "8 days", late: str = "2 days", ts: str = "ts") -> DataFrame:
    """Per pixel and window: observations and clear observations; rows later than ``late`` are dropped."""
    timed = obs.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", late)
    return timed.groupBy("pixel", F.window("event_time", window)).agg(
        F.count(F.lit(1)).alias("n_obs"), F.count(clear(F.lit(1), F.col("scl"))).alias("n_clear")
    )
